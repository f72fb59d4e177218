"""Token ids as fixed-width bit-packed files.

A file holds the ids of consecutive documents, each id in the fewest bits that the vocabulary needs.  Layout, little
endian: magic ``SLIDBITS``, then as unsigned 64-bit numbers the bits of an id, ids of a block, documents, ids and blocks;
then the documents' ids (signed), the documents' first ids within the file with the total as last entry, and the blocks'
byte offsets within the payload with its length as last entry; then the payload, each block padded to whole bytes.
Block offsets let numpy unpack any range of ids from the few blocks that hold it, without reading the rest.

Documents are ordered by id across files: rows are range-partitioned and sorted by id, rows of the same id (or none) by
place in the table, before they are tokenized, so each task writes the files of its range, however many rows share an
id.  Nulls come first.  A retried task writes the same file again and renames it into place.  Files are read back in as
many tasks as there are files.

Defined results: a null or empty text has its end id alone; rows that repeat are documents of their own; an empty table
writes no file and reads back empty; extra columns are ignored.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sedgeline.llm import scratch, tokens

MAGIC = b"SLIDBITS"
BLOCK_IDS = 4096
FILE_IDS = 16 << 20
NULL_ID = -(1 << 63)
_HEAD = struct.Struct("<8s5Q")


def bits_for(vocab: int) -> int:
    """Bits that hold every id below ``vocab``."""
    return max(1, (vocab - 1).bit_length())


def pack_bits(ids: np.ndarray, bits: int) -> bytes:
    if bits in (8, 16, 32):
        return ids.astype(f">u{bits // 8}").tobytes()
    each = np.unpackbits(ids.astype(">u4").view(np.uint8).reshape(-1, 4), axis=1)[:, 32 - bits :]
    return np.packbits(each.ravel()).tobytes()


def unpack_bits(raw: bytes, n: int, bits: int) -> np.ndarray:
    if bits in (8, 16, 32):
        return np.frombuffer(raw, f">u{bits // 8}", n).astype("<u4")
    each = np.zeros((n, 32), np.uint8)
    each[:, 32 - bits :] = np.unpackbits(np.frombuffer(raw, np.uint8), count=n * bits).reshape(n, bits)
    return np.packbits(each, axis=1).view(">u4").ravel().astype("<u4")


def encode_file(doc_ids: list[int | None], docs: list[np.ndarray], bits: int, block: int = BLOCK_IDS) -> bytes:
    lengths = np.array([len(d) for d in docs], np.uint64)
    ids = np.concatenate(docs) if docs else np.zeros(0, "<u4")
    blocks = [pack_bits(ids[i : i + block], bits) for i in range(0, len(ids), block)]
    starts = np.concatenate(([0], np.cumsum(lengths, dtype=np.uint64))).astype("<u8")
    offsets = np.concatenate(([0], np.cumsum([len(b) for b in blocks], dtype=np.uint64))).astype("<u8")
    names = np.array([NULL_ID if d is None else d for d in doc_ids], "<i8")
    head = _HEAD.pack(MAGIC, bits, block, len(docs), len(ids), len(blocks))
    return b"".join((head, names.tobytes(), starts.tobytes(), offsets.tobytes(), *blocks))


class IdFile:
    """Random access to one file; only the index is held, blocks are read when asked for."""

    def __init__(self, uri: str):
        self.uri = uri
        magic, self.bits, self.block, n, self.n_ids, blocks = _HEAD.unpack(scratch.get(uri, 0, _HEAD.size))
        if magic != MAGIC:
            raise ValueError(f"{uri} is not an id file")
        raw = scratch.get(uri, _HEAD.size, 8 * (2 * n + 1 + blocks + 1))
        self.doc_ids = np.frombuffer(raw, "<i8", n)
        self.starts = np.frombuffer(raw, "<u8", n + 1, 8 * n).astype(np.int64)
        self.offsets = np.frombuffer(raw, "<u8", blocks + 1, 8 * (2 * n + 1)).astype(np.int64)
        self.payload = _HEAD.size + len(raw)

    def ids(self, start: int, stop: int) -> np.ndarray:
        """Ids ``start`` to ``stop`` of the file."""
        if start >= stop:
            return np.zeros(0, "<u4")
        a, b = start // self.block, -(-stop // self.block)
        raw = scratch.get(self.uri, self.payload + int(self.offsets[a]), int(self.offsets[b] - self.offsets[a]))
        parts = []
        for k in range(a, b):
            n = min(self.block, self.n_ids - k * self.block)
            parts.append(unpack_bits(raw[self.offsets[k] - self.offsets[a] : self.offsets[k + 1] - self.offsets[a]], n, self.bits))
        return np.concatenate(parts)[start - a * self.block : stop - a * self.block]


def write_id_files(docs: DataFrame, folder: str, tokenizer: str, style: str, end_id: int, id_col: str = "doc_id", text_col: str = "text", file_ids: int = FILE_IDS) -> DataFrame:
    """Tokenize and write; returns the list of files ``part, file_no, path, n_docs, n_ids`` (in scratch space)."""
    vocab = tokens.encoder(tokenizer, style).vocab

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, part = tokens.encoder(tokenizer, style), TaskContext.get().partitionId()
        names, held, size, files = [], [], 0, []

        def flush() -> None:
            nonlocal names, held, size
            if held:
                path = f"{folder}/ids-{part:06d}-{len(files):06d}.bits"
                scratch.put(path, encode_file(names, held, bits_for(vocab)))
                files.append((part, len(files), path, len(held), size))
            names, held, size = [], [], 0

        for b in batches:
            for doc, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                ids = np.append(enc.ids(text.as_py()), enc.dtype.type(end_id))
                if size and size + len(ids) > file_ids:
                    flush()
                names.append(doc)
                held.append(ids)
                size += len(ids)
        flush()
        yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*files, strict=True) if files else ((),) * 5, (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64()), strict=True)], names=["part", "file_no", "path", "n_docs", "n_ids"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), F.monotonically_increasing_id().alias("rid"))
    ranged = rows.repartitionByRange("doc_id", "rid").sortWithinPartitions("doc_id", "rid").drop("rid")
    return scratch.table(ranged.mapInArrow(write, "part long, file_no long, path string, n_docs long, n_ids long"), "idfiles")


def read_id_files(files: DataFrame) -> DataFrame:
    """From a list of files, per document: ``doc_id, start`` (ids of all documents before it), ``n_tokens, ids_crc32``."""
    parts = files.groupBy("part").agg(F.sum("n_ids").alias("ids"))
    before = F.sum("ids").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))  # a row for each task that wrote
    parts = parts.select("part", F.coalesce(before, F.lit(0)).alias("part_base"))
    within = F.sum("n_ids").over(Window.partitionBy("part").orderBy("file_no").rowsBetween(Window.unboundedPreceding, -1))
    based = files.withColumn("within", F.coalesce(within, F.lit(0))).join(parts, "part").select("path", (F.col("part_base") + F.col("within")).alias("base"))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, base in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                f = IdFile(path)
                step = max(1, (1 << 22) // max(1, f.n_ids // max(1, len(f.doc_ids))))  # about 4 million ids at a time
                for i in range(0, len(f.doc_ids), step):
                    starts = f.starts[i : i + step + 1]
                    ids = f.ids(int(starts[0]), int(starts[-1]))
                    crc = [zlib.crc32(ids[x - starts[0] : y - starts[0]].tobytes()) for x, y in zip(starts[:-1], starts[1:], strict=True)]
                    names = f.doc_ids[i : i + step]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(names, mask=names == NULL_ID), pa.array(starts[:-1] + base), pa.array(np.diff(starts)), pa.array(crc, pa.int64())],
                        names=["doc_id", "start", "n_tokens", "ids_crc32"],
                    )

    return scratch.spread(based, "path", scratch.file_count(files)).mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")

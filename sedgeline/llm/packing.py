"""Packing token sequences: first-fit decreasing over a tournament tree of bin capacities.

Documents are tokenized once, into a written table of pieces of at most ``LENGTH`` tokens.  A full piece is a sequence by
itself and is not moved again.  What is left is one shorter piece a document at most; these are dealt at random (by a
keyed hash of row and id) into groups of about ``GROUP_DOCS`` documents.  Each group is packed on its own: pieces by
falling length, each into the first sequence with room, which the tree finds in the logarithm of the number of
sequences.  So a group is bounded by the parameters, ``GROUP_DOCS`` pieces of less than ``LENGTH`` tokens, however long the
documents are and whatever ids they share.

Defined results: a null text is empty and still has its end token.  Null ids and rows that repeat or share an id are
packed each on its own.  An empty table gives an empty table.  Extra columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sedgeline.llm import scratch, tokens
from sedgeline.llm.scratch import small_batches

LENGTH = 2048
GROUP_DOCS = 4096
END_ID = 1
SEED = 5


class CapacityTree:
    """Tournament tree over bins: each node holds the largest room below it."""

    def __init__(self, bins: int, room: int):
        self.leaves = 1 << max(0, bins - 1).bit_length()
        self.most = [0] * (2 * self.leaves)
        self.most[self.leaves : self.leaves + bins] = [room] * bins
        for i in range(self.leaves - 1, 0, -1):
            self.most[i] = max(self.most[2 * i], self.most[2 * i + 1])

    def place(self, size: int) -> tuple[int, int]:
        """Take ``size`` from the first bin with room: the bin and the room it had."""
        most, i = self.most, 1
        while i < self.leaves:
            i *= 2
            if most[i] < size:
                i += 1
        had, at = most[i], i - self.leaves
        most[i] = had - size
        while i > 1:
            i //= 2
            left, right = most[2 * i], most[2 * i + 1]
            best = left if left > right else right
            if most[i] == best:
                break
            most[i] = best
        return at, had


def first_fit_decreasing(sizes: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of each size.  ``sizes`` must fall and lie within 1 and ``length``."""
    bins, offsets = np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64)
    full = int(np.searchsorted(-sizes, -length, side="right"))  # full pieces fill a bin each
    bins[:full] = np.arange(full)
    tree = CapacityTree(max(1, len(sizes) - full), length)
    for i, s in enumerate(sizes[full:].tolist(), start=full):
        at, had = tree.place(s)
        bins[i], offsets[i] = full + at, length - had
    return bins, offsets


def pack_group(pieces: pd.DataFrame, length: int = LENGTH) -> pd.DataFrame:
    """Adds ``bin`` and ``offset`` to rows with ``doc_id, start, length``."""
    pieces = pieces.sort_values(["length", "doc_id", "start", "rid"], ascending=[False, True, True, True], ignore_index=True)
    pieces["bin"], pieces["offset"] = first_fit_decreasing(pieces["length"].to_numpy(), length)
    return pieces


_PIECE = {"doc_id": pa.int64(), "rid": pa.int64(), "start": pa.int64(), "length": pa.int64(), "ids_crc32": pa.int64(), "doc_tokens": pa.int64(), "full": pa.int64(), "ids": pa.binary()}


def _pieces(path: str, style: str, end_id: int, length: int, keep_ids: bool):
    """Rows to pieces; ``full`` numbers the task's full pieces and is null for others."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, full = tokens.encoder(path, style), TaskContext.get().partitionId() << 33
        for b in small_batches(batches):
            out: dict[str, list] = {k: [] for k in _PIECE}
            for doc, rid, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), strict=True):
                narrow = np.append(enc.ids(text.as_py()), enc.dtype.type(end_id))
                ids = narrow.astype("<u4")
                for start in range(0, len(ids), length):
                    piece = ids[start : start + length]
                    whole, raw = len(piece) == length, narrow[start : start + length].tobytes() if keep_ids else None
                    for k, v in zip(out, (doc, rid, start, len(piece), zlib.crc32(piece.tobytes()), len(ids), full if whole else None, raw), strict=True):
                        out[k].append(v)
                    full += whole
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(out.values(), _PIECE.values(), strict=True)], names=list(out))

    return run


def packed_pieces(docs: DataFrame, tokenizer: str, style: str = "spaced", id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH,
                  end_id: int = END_ID, group_docs: int = GROUP_DOCS, seed: int = SEED, keep_ids: bool = True) -> DataFrame:
    """One row per piece: ``doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset`` and, if asked, ``ids``,
    which in the order of ``sequence_id, offset`` are the packed sequences: little-endian unsigned numbers of 16 bits, or
    of 32 if the vocabulary has more than 65536 entries (checksums are always those of 32)."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.monotonically_increasing_id().alias("rid"), F.col(text_col).alias("text"))
    schema = "doc_id long, rid long, start long, length long, ids_crc32 long, doc_tokens long, full long, ids binary"
    cut = scratch.table(rows.mapInArrow(_pieces(tokenizer, style, end_id, length, keep_ids), schema), "pieces")
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "ids"]
    # full pieces: numbers from 2 ** 62 on, which no group reaches
    alone = cut.where("full is not null").withColumn("sequence_id", F.col("full") + F.lit(1 << 62)).withColumn("offset", F.lit(0).cast("long")).select(*names)
    rest = cut.where("full is null").drop("full")
    groups = max(1, -(-rest.count() // group_docs))
    dealt = rest.withColumn("group", F.pmod(F.xxhash64("doc_id", "rid", F.lit(seed)), F.lit(groups)))

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pack_group(pdf, length)
        pdf["sequence_id"] = pdf["group"] * (1 << 24) + pdf["bin"]
        return pdf[names]

    packed = dealt.groupBy("group").applyInPandas(pack, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, ids binary")
    both = packed.unionByName(alone)
    return both if keep_ids else both.drop("ids")

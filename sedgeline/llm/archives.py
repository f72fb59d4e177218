"""ARC archives to WARC.

ARC is the older format: each record is one header line (its fields depend on the version that the archive's first
record states) and as many bytes as that line declares.  The converter parses these lines and lengths and gives each
record what WARC asks for: a record id (a name-based UUID of archive and offset, so reruns agree), the timestamp in ISO
form, a type, and SHA-1 digests of block and payload in base32.  Blocks with an HTTP status line are ``response``
records, all others (``dns:``, ``ftp:``) ``resource`` records whose whole block is the payload.

Payloads that occur again become ``revisit`` records of the first one: that with the smallest rank (page id, from the
index that :func:`write_arcs` returns beside the archives), then by archive and offset.  Which records those are comes
from one pass over the archives that reads headers and digests; digests are grouped with map-side aggregation, and only
the list of a file's own revisits (a row for each repeated record) moves to the task that converts it.  Each pass runs
in as many tasks as there are files.  Archives are read and written as streams, a record at a time, under a name of
their own, whole or not at all, in the shared folder.

Defined results: a null html is an empty payload; a null url becomes ``urn:page:<id>`` and white space in urls is
percent-encoded; a null page id ranks last and reads back as null.  Rows with the same id and payload: one is the
response (the first by place), the others revisit it.  An empty table gives an empty table.  Extra columns are ignored.
Of foreign archives: header lines are bytes, any line may lack its value or hold signs of any charset; bytes where no
header line can be read, up to the next that can, are kept as a ``metadata`` record marked as truncated, and so is the
part that is left of a record whose declared length goes beyond the file's end (in its own type).  An archive without a
version block is read as version 1.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import re
import uuid
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from typing import BinaryIO

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sedgeline.llm import scratch

LEAST_BYTES = 0  # payloads from this size on are revisited
FILE_BYTES = 32 << 20  # of an ARC file
DATE = "20240101000000"
LEVEL = 1
#: Header fields of the two versions of ARC, in order.
FIELDS = {
    1: ("url", "ip", "date", "mime", "length"),
    2: ("url", "ip", "date", "mime", "result", "checksum", "location", "offset", "filename", "length"),
}
LONGEST_LINE = 1 << 20
_STATUS_LINE = re.compile(rb"HTTP/[0-9.]+ ")
_HTTP_END = re.compile(rb"\r?\n\r?\n")
_SPACE = re.compile(r"[\s%]")


@dataclass(frozen=True)
class ArcRecord:
    url: str
    ip: str
    date: str
    mime: str
    offset: int
    block: bytes
    damage: str | None = None  # null, "cut" (less than the declared length is there) or "skipped" (no header line)


def sha1(data: bytes) -> str:
    """Bare upper-case base32 SHA-1."""
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


# --- ARC


def arc_record(name: str, url: str, block: bytes, version: int, date: str = DATE, mime: str = "text/html") -> bytes:
    """A header line, the block and an empty line."""
    extra = {1: "", 2: f"200 - - 0 {name} "}[version]
    return f"{url} 0.0.0.0 {date} {mime} {extra}{len(block)}\n".encode() + block + b"\n"


def version_block(name: str, version: int, date: str = DATE) -> bytes:
    """The record that an ARC file starts with."""
    names = {1: "URL IP-address Archive-date Content-type Archive-length", 2: "URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length"}
    return arc_record(name, f"filedesc://{name}", f"{version} 0 sedgeline\n{names[version]}\n".encode(), version, date, "text/plain")


def arc_file(name: str, records: list[tuple[str, bytes]], version: int = 1, date: str = DATE) -> bytes:
    """An ARC file: version block, then a header line, block and empty line for each (url, block)."""
    return b"".join([version_block(name, version, date), *(arc_record(name, url, block, version, date) for url, block in records)])


def _header(line: bytes, version: int) -> dict[str, str] | None:
    """Fields of a header line; null if it is none.  The url is what is left of the fields that can't hold a space."""
    fields = FIELDS[version]
    parts = line.decode("latin-1").rstrip("\r\n").rsplit(" ", len(fields) - 1)
    found = dict(zip(fields, parts, strict=False))
    good = len(parts) == len(fields) and ":" in parts[0] and found["length"].isdecimal() and found["length"].isascii() and re.fullmatch("[0-9]{8,17}", found["date"])
    return found if good else None


def read_arc(data: bytes | BinaryIO) -> Iterator[ArcRecord]:
    """Records of an ARC file after its version block, by declared lengths."""
    source = io.BytesIO(data) if isinstance(data, bytes) else data
    version, at, skipped, skipped_at = 1, 0, b"", 0

    def damaged() -> Iterator[ArcRecord]:
        if skipped.strip():
            yield ArcRecord(f"urn:damaged:{skipped_at}", "0.0.0.0", DATE, "application/octet-stream", skipped_at, skipped, "skipped")

    while line := source.readline(LONGEST_LINE):
        here, at = at, at + len(line)
        first = here == 0
        if not skipped and not line.strip():
            continue
        found = _header(line, version) or (_header(line, 2) if first else None)
        if found is None:
            skipped_at = skipped_at if skipped else here
            skipped += line
            if len(skipped) > LONGEST_LINE:
                yield from damaged()
                skipped = b""
            continue
        yield from damaged()
        skipped, size = b"", int(found["length"])
        block = source.read(size)
        at += len(block)
        if first and found["url"].startswith("filedesc:"):
            stated = block.split(b" ", 1)[0]
            version = int(stated) if stated in (b"1", b"2") else 1
            continue
        yield ArcRecord(found["url"], found["ip"], found["date"], found["mime"], here, block, "cut" if len(block) < size else None)
    yield from damaged()


def http_block(payload: bytes) -> bytes:
    return f"HTTP/1.0 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode() + payload


def split_block(block: bytes) -> tuple[bytes, bytes]:
    """HTTP head (with the empty line) and payload; all is payload if there is no status line, all is head without an
    empty line."""
    if not _STATUS_LINE.match(block):
        return b"", block
    end = _HTTP_END.search(block)
    stop = end.end() if end else len(block)
    return block[:stop], block[stop:]


# --- WARC


def warc_record(fields: dict[str, str | int], block: bytes) -> bytes:
    """One gzip member, compressed for itself, so that records can be read singly."""
    head = "".join(f"{k}: {v}\r\n" for k, v in (fields | {"Content-Length": len(block)}).items())
    return gzip.compress(f"WARC/1.1\r\n{head}\r\n".encode() + block + b"\r\n\r\n", LEVEL, mtime=0)


def read_warc(data: bytes | BinaryIO) -> Iterator[tuple[dict[str, str], bytes]]:
    """Header fields and block of each record of a compressed file, one at a time."""
    with gzip.GzipFile(fileobj=io.BytesIO(data) if isinstance(data, bytes) else data) as packed, io.BufferedReader(packed, 1 << 20) as source:
        while version := source.readline():
            if not version.startswith(b"WARC/1."):
                raise ValueError(f"not a WARC record: {version[:40]!r}")
            fields = {}
            while (line := source.readline()).strip():
                k, _, v = line.decode("utf-8", "replace").rstrip("\r\n").partition(":")
                fields[k] = v.strip()
            block = source.read(int(fields["Content-Length"]))
            if source.read(4) != b"\r\n\r\n":
                raise ValueError("a record's length is not the declared one")
            yield fields, block


def iso(date: str) -> str:
    """ARC dates have 14 digits; shorter ones stand for the first moment, longer ones are cut to seconds."""
    d = (date + "000000")[:14]
    return f"{d[:4]}-{d[4:6]}-{d[6:8]}T{d[8:10]}:{d[10:12]}:{d[12:14]}Z"


def record_id(name: str, offset: int) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{name}#{offset}')}>"


def warc_of_arc(name: str, records: Iterable[ArcRecord], refers: dict[int, tuple[str, str]]) -> Iterator[bytes]:
    """WARC records of an ARC file's.  ``refers``: by offset, what a record revisits (record id, url)."""
    yield warc_record({"WARC-Type": "warcinfo", "WARC-Record-ID": record_id(name, 0), "WARC-Date": iso(DATE), "Content-Type": "application/warc-fields"}, f"software: sedgeline\r\nisPartOf: {name}\r\n".encode())
    for r in records:
        head, payload = split_block(r.block)
        fields: dict[str, str | int] = {
            "WARC-Type": "metadata" if r.damage == "skipped" else "response" if head else "resource", "WARC-Record-ID": record_id(name, r.offset), "WARC-Target-URI": r.url, "WARC-Date": iso(r.date),
            "WARC-IP-Address": r.ip, "WARC-Payload-Digest": f"sha1:{sha1(payload)}", "WARC-Identified-Payload-Type": r.mime, "Content-Type": "application/http; msgtype=response" if head else r.mime, "Payload-Length": len(payload),
        }
        if r.damage:
            fields["WARC-Truncated"] = "unspecified"
        block = r.block
        if r.offset in refers:
            to, url = refers[r.offset]
            fields |= {"WARC-Type": "revisit", "WARC-Profile": "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", "WARC-Refers-To": to, "WARC-Refers-To-Target-URI": url}
            block = head
        fields["WARC-Block-Digest"] = f"sha1:{sha1(block)}"
        yield warc_record(fields, block)


# --- Spark

INDEX = "name string, at long, record_id string, page_id long"


def write_arcs(pages: DataFrame, folder: str, file_bytes: int = FILE_BYTES) -> DataFrame:
    """Pages (``page_id, url, html``) to ARC files of versions 1 and 2 by turns; returns their index, a row for each
    record: ``name, at, record_id, page_id``."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, files = TaskContext.get().partitionId(), 0
        rows = iter((page, url, html) for b in scratch.small_batches(batches) for page, url, html in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), strict=True))
        row = next(rows, None)
        while row is not None:
            name, version = f"pages-{part:06d}-{files:06d}.arc.gz", 1 + (part + files) % 2
            index: list[tuple] = []
            with scratch.writing(f"{folder}/{name}") as out, gzip.GzipFile(fileobj=out, mode="wb", compresslevel=LEVEL, mtime=0) as packed:
                at = packed.write(version_block(name, version))
                while row is not None and at < file_bytes:
                    page, url, html = row
                    address = _SPACE.sub(lambda m: "".join(f"%{x:02X}" for x in m[0].encode()), url) if url else f"urn:page:{page}"
                    index.append((name, at, record_id(name, at), page))
                    at += packed.write(arc_record(name, address if ":" in address else f"urn:{address}", http_block((html.as_py() or "").encode("utf-8", "replace")), version))
                    row = next(rows, None)
            files += 1
            types = (pa.string(), pa.int64(), pa.string(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*index, strict=True), types, strict=True)], names=["name", "at", "record_id", "page_id"])

    rows = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string"))
    return scratch.table(rows.mapInArrow(write, INDEX), "arcs")


def _records(folder: str, name: str) -> Iterator[ArcRecord]:
    """An archive's records, packed or plain: its first two bytes tell."""
    with scratch.opened(f"{folder}/{name}") as raw, io.BufferedReader(raw, 1 << 20) as plain:
        if plain.peek(2)[:2] == b"\x1f\x8b":
            with gzip.GzipFile(fileobj=plain) as packed, io.BufferedReader(packed, 1 << 20) as source:
                yield from read_arc(source)
        else:
            yield from read_arc(plain)


def arc_digests(names: DataFrame, folder: str) -> DataFrame:
    """``name, at, record_id, url, digest, size`` of each record of the ARC files."""
    types = {"name": pa.string(), "at": pa.int64(), "record_id": pa.string(), "url": pa.string(), "digest": pa.string(), "size": pa.int64()}

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for name in (n for b in batches for n in b.column(0).to_pylist()):
            rows = []
            for r in _records(folder, name):
                payload = split_block(r.block)[1]
                rows.append((name, r.offset, record_id(name, r.offset), r.url, sha1(payload), len(payload)))
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*rows, strict=True) if rows else [()] * 6, types.values(), strict=True)], names=list(types))

    return names.mapInArrow(read, "name string, at long, record_id string, url string, digest string, size long")


def revisits(digests: DataFrame, least_bytes: int = LEAST_BYTES) -> DataFrame:
    """From ``name, at, record_id, url, digest, size, rank``: ``name, at, to`` for every record whose payload another one
    of smaller rank (null is last) or place has."""
    order = F.struct(F.col("rank").isNull(), "rank", "name", "at")
    usable = digests.where(F.col("size") >= least_bytes)
    first = usable.groupBy("digest", "size").agg(F.min(F.struct(order.alias("o"), "record_id", "url")).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
    again = usable.join(first, ["digest", "size"]).where(F.col("record_id") != F.col("first.record_id"))
    return again.select("name", "at", F.struct("first.record_id", "first.url").alias("to"))


def convert_arcs(names: DataFrame, folder: str, least_bytes: int = LEAST_BYTES, index: DataFrame | None = None) -> DataFrame:
    """ARC files of ``folder`` (``name``) to WARC files beside them; returns the names of those.  ``index`` may rank records."""
    tasks = scratch.file_count(names)
    digests = arc_digests(scratch.spread(names, "name", tasks), folder)
    if index is None:
        digests = digests.withColumn("rank", F.lit(None).cast("long"))
    else:
        digests = digests.join(index.select("record_id", F.col("page_id").alias("rank")), "record_id", "left")
    own = revisits(scratch.table(digests, "arc-digests"), least_bytes).groupBy("name").agg(F.collect_list(F.struct("at", "to")).alias("refers"))  # of one file

    def convert(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name, refers in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                found = {r["at"]: (r["to"]["record_id"], r["to"]["url"]) for r in refers.as_py() or []}
                warc = f"{name.removesuffix('.gz').removesuffix('.arc')}.warc.gz"
                with scratch.writing(f"{folder}/{warc}") as out:
                    for record in warc_of_arc(name, _records(folder, name), found):
                        out.write(record)
                yield pa.RecordBatch.from_arrays([pa.array([warc])], names=["name"])

    files = scratch.spread(names.join(own, "name", "left").select("name", "refers"), "name", tasks)
    return scratch.table(files.mapInArrow(convert, "name string"), "warcs")


def read_warcs(names: DataFrame, folder: str) -> DataFrame:
    """Per record: ``record_id, payload_bytes, payload_digest, record_type, refers_to`` (a record id), ``url, payload``
    (null for revisits)."""
    types = {"record_id": pa.string(), "payload_bytes": pa.int64(), "payload_digest": pa.string(), "record_type": pa.string(), "refers_to": pa.string(), "url": pa.string(), "payload": pa.binary()}

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for name in (n for b in batches for n in b.column(0).to_pylist()):
            rows, size = [], 0
            with scratch.opened(f"{folder}/{name}") as source:
                for f, block in read_warc(source):
                    if f["WARC-Type"] == "warcinfo":
                        continue
                    payload = split_block(block)[1] if f["WARC-Type"] != "revisit" else None
                    if payload is not None and sha1(payload) != f["WARC-Payload-Digest"][5:]:
                        raise ValueError(f"{name}: payload of {f['WARC-Record-ID']} is damaged")
                    rows.append((f["WARC-Record-ID"], int(f["Payload-Length"]), f["WARC-Payload-Digest"][5:], f["WARC-Type"], f.get("WARC-Refers-To"), f["WARC-Target-URI"], payload))
                    size += len(payload or b"")
                    if size > 8 << 20:
                        yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*rows, strict=True), types.values(), strict=True)], names=list(types))
                        rows, size = [], 0
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*rows, strict=True), types.values(), strict=True)], names=list(types))

    dealt = scratch.spread(names, "name", scratch.file_count(names))
    return dealt.mapInArrow(read, "record_id string, payload_bytes long, payload_digest string, record_type string, refers_to string, url string, payload binary")


def archive_pages(pages: DataFrame, folder: str, least_bytes: int = LEAST_BYTES) -> DataFrame:
    """Pages to ARC, ARC to WARC, and the WARC files read back: ``page_id, payload_bytes, payload_digest, record_type,
    refers_to`` (a page id), ``url, payload``.  The index tells which records are which pages'."""
    index = write_arcs(pages, folder)
    names = scratch.table(index.select("name").distinct(), "arc-names")
    found = read_warcs(convert_arcs(names, folder, least_bytes, index), folder).withColumnRenamed("refers_to", "to")
    ids = index.select("record_id", "page_id")
    firsts = index.select(F.col("record_id").alias("to"), F.col("page_id").alias("refers_to"))
    return found.join(ids.hint("merge"), "record_id").join(firsts.hint("merge"), "to", "left").select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url", "payload")

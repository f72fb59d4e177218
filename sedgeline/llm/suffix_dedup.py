"""Suffix-array dedup: remove each byte covered by a ``LENGTH``-byte string that also starts earlier.

Sorting every suffix of a large corpus would move each of its bytes many times.  Nearly all of them are unique, and
that can be told without them:

1. *Slices.*  A string of ``LENGTH`` bytes is assigned to an anchor, the smallest hash of its ``ANCHOR``-byte parts (the
   leftmost of equals).  Equal strings have equal anchors.  Neighbouring strings mostly share theirs, so a document is
   a sequence of slices, each a run of strings with the same anchor.  A slice goes to the shuffle as two hashes
   (anchor, content), its document and place, about 25 bytes for 40 of text.  Copies of a slice within a task are
   repeats wherever the first one is, so only one of them goes on: very frequent passages are collapsed map-side.
2. *Grouping.*  Anchors are the keys.  Of slices with equal content all but the earliest are repeats.  Anchors with one
   content are done; the others (borders of repeated passages) go on, one slice for each content.
3. *Suffix arrays.*  The bytes of these slices are fetched and dealt, by anchor, to groups of bounded size.  Each group
   builds a suffix array by two-stage sorting; runs of adjacent common prefixes of ``LENGTH`` or more bytes are the sets
   of equal strings, whose earliest place stays.
4. *Hot anchors.*  A frequent passage has as many different borders as places.  Anchors that a Misra-Gries sketch finds
   frequent are spread over the shuffle by content.  Those that then still have more contents than a group may hold
   are sorted in two steps: suffix arrays over chunks of their slices find what repeats within a chunk, and of each
   chunk the first places of its different strings are dealt by a further bucket, the string's own bytes, to groups of
   bounded size with a suffix array each.  So equal strings meet however frequent they are, a string comes but once from
   each chunk, and every size goes through suffix arrays.
5. The repeats' ranges are joined to the documents and cut out.

Defined results: bytes are those of UTF-8; a null text is empty; order is by id, then place; a null id is smaller than
any other; among rows with the same id, or none, a hash of the text decides, and rows with the same id and text count as
one document (they repeat nothing of each other), each getting its result.  An empty table gives an empty table.  Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sedgeline.llm import scratch
from sedgeline.llm.suffix_sort import common_prefix_reaches, suffix_array

LENGTH = 100
ANCHOR = 24
SEGMENT = 1 << 20  # bytes of a document that are scanned at a time
TASK_SLICES = 1 << 19  # slices among which a task looks for copies at a time
HOT_SLICES, HOT_SHARE, HOT_MOST = 500, 1 << 13, 10_000_000  # an anchor is split from this share of all slices on, within these bounds
GROUP_SLICES, GROUP_MOST = 5_000, 20_000  # slices of a suffix array (about 130 bytes each) by design; anchors with more are spread
TASK_ROWS, TASK_GROUPS = 500_000, 200  # slices and suffix arrays for each task of the shuffles
SKETCH_ITEMS, MAX_HOT = 1 << 16, 4096
_ODD = [np.uint64(c) for c in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xFF51AFD7ED558CCD)]


def anchors(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Slices of up to ``SEGMENT`` strings: hash of the anchor, first string, number of strings."""
    n, windows = len(data), len(data) - LENGTH + 1
    w = np.ndarray((n - 7,), "<u8", data, strides=(1,))
    x = w[: n - ANCHOR + 1] * _ODD[0]
    x ^= x >> np.uint64(31)
    x += w[8 : n - ANCHOR + 9] * _ODD[1]
    x ^= x >> np.uint64(29)
    x += w[16 : n - ANCHOR + 17] * _ODD[2]
    x ^= x >> np.uint64(32)
    x *= _ODD[3]
    # the low bits give way to the place, so that the least key is the leftmost least hash
    key = (x & np.uint64(~(2 * SEGMENT - 1) & 0xFFFFFFFFFFFFFFFF)) | np.arange(len(x), dtype=np.uint64)
    span, reach = LENGTH - ANCHOR + 1, 1
    while 2 * reach <= span:
        key = np.minimum(key[:-reach], key[reach:])
        reach *= 2
    if span > reach:
        key = np.minimum(key[: windows], key[span - reach : span - reach + windows])
    place = (key[:windows] & np.uint64(2 * SEGMENT - 1)).astype(np.int64)
    first = np.concatenate(([0], np.flatnonzero(place[1:] != place[:-1]) + 1))
    return x[place[first]], first, np.diff(np.append(first, windows))


SLICE = "key long, anchor long, content long, doc_id long, tag long, start long, n long, kind int"
_NAMES = [c.split()[0] for c in SLICE.split(", ")]
REPEAT, OPEN, SPLIT = 0, 1, 2  # kinds: known repeat, yet to be compared, the same of a hot anchor


def _slices(hot: frozenset[int]):
    hot_anchors = np.array(sorted(hot), np.int64)

    def flush(parts: list[tuple]) -> pa.RecordBatch:
        anchor, content, doc, tag, start, n, null = (np.concatenate([p[i] for p in parts]) for i in range(7))
        order = np.lexsort((start, tag, doc, ~null, content, anchor))
        a, c = anchor[order], content[order]
        copy = np.zeros(len(order), bool)
        copy[order[1:]] = (a[1:] == a[:-1]) & (c[1:] == c[:-1])
        again = np.zeros(len(order), bool)  # the same place of a repeated row
        again[order[1:]] = copy[order[1:]] & np.logical_and.reduce([x[order[1:]] == x[order[:-1]] for x in (doc, tag, start, null)])
        copy &= ~again
        # neighbouring copies of a document become one range
        i = np.flatnonzero(copy)
        i = i[np.lexsort((start[i], tag[i], doc[i], ~null[i]))]
        joins = np.zeros(len(i), bool)
        joins[1:] = (doc[i[1:]] == doc[i[:-1]]) & (tag[i[1:]] == tag[i[:-1]]) & (null[i[1:]] == null[i[:-1]]) & (start[i[1:]] == start[i[:-1]] + n[i[:-1]])
        heads = np.flatnonzero(~joins)
        n[i[heads]] = np.add.reduceat(n[i], heads) if len(i) else n[i]
        alone = np.flatnonzero(~copy & ~again)
        rows = np.concatenate((alone, i[heads]))
        kind = np.where(np.isin(anchor[rows], hot_anchors), SPLIT, OPEN).astype(np.int32)
        kind[len(alone) :] = REPEAT
        key = np.where(kind == OPEN, anchor[rows], content[rows])
        columns = [pa.array(key), *(pa.array(x[rows]) for x in (anchor, content)), pa.array(doc[rows], mask=null[rows]), *(pa.array(x[rows]) for x in (tag, start, n)), pa.array(kind)]
        return pa.RecordBatch.from_arrays(columns, names=_NAMES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, held = [], 0
        for b in batches:
            for doc, tag, text in zip(b.column(0), b.column(1).to_pylist(), b.column(2), strict=True):
                data, doc = (text.as_py() or "").encode("utf-8", "replace"), doc.as_py()
                for at in range(0, max(0, len(data) - LENGTH + 1), SEGMENT):
                    part = data[at : at + SEGMENT + LENGTH - 1]
                    anchor, first, n = anchors(part)
                    content = np.array([xxhash.xxh3_64_intdigest(part[i:j]) for i, j in zip(first.tolist(), (first + n + LENGTH - 1).tolist(), strict=True)], np.uint64)
                    size = len(first)
                    parts.append((anchor.view(np.int64), content.view(np.int64), np.full(size, doc or 0), np.full(size, tag), first + at, n, np.full(size, doc is None)))
                    held += size
                    if held >= TASK_SLICES:
                        yield flush(parts)
                        parts, held = [], 0
        if parts:
            yield flush(parts)

    return run


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by key, kind, anchor, content and place, to what is known of them.

    Only the first slice of each content is still open, and of an anchor with one content not even that."""
    last = None  # key, kind, anchor, content and place of the row before
    waiting = None  # first slice of the current anchor, as long as it has one content
    for b in batches:
        if not b.num_rows:
            continue
        key, anchor, content, kind, tag, start = (b.column(_NAMES.index(c)).to_numpy(zero_copy_only=False) for c in ("key", "anchor", "content", "kind", "tag", "start"))
        ids = b.column(_NAMES.index("doc_id"))
        doc, null = ids.fill_null(0).to_numpy(zero_copy_only=False), ids.is_null().to_numpy(zero_copy_only=False)
        same_anchor, same = np.zeros(len(key), bool), np.zeros(len(key), bool)
        same_anchor[1:] = (key[1:] == key[:-1]) & (kind[1:] == kind[:-1]) & (anchor[1:] == anchor[:-1])
        same_anchor[0] = last is not None and last[:3] == (key[0], kind[0], anchor[0])
        same[1:] = content[1:] == content[:-1]
        same[0] = last is not None and last[3] == content[0]
        same &= same_anchor & (kind != REPEAT)
        again = same.copy()  # the same place of a repeated row
        for k, x in enumerate((doc, tag, start, null)):
            again[1:] &= x[1:] == x[:-1]
            again[0] &= last is not None and last[4 + k] == x[0]
        last = tuple(x[-1] for x in (key, kind, anchor, content, doc, tag, start, null))
        out = np.where(same, REPEAT, kind)
        group = np.cumsum(~same_anchor)  # 0: the anchor of the batch before goes on
        heads = np.flatnonzero(~same & (kind == OPEN))
        counts = np.bincount(group[heads], minlength=group[-1] + 1)
        carried = waiting is not None and not same_anchor[0]
        if carried:
            waiting = None
        goes_on = group[heads] == 0
        if goes_on.any() and waiting is not None and waiting is not True:
            yield waiting
            waiting = True
        drop = again
        alone = heads[(counts[group[heads]] == 1) & ~goes_on]
        drop[alone] = True
        end = group[-1]
        if not (end == 0 and waiting is not None):  # the batch's last anchor may go on in the next one
            tail = heads[group[heads] == end]
            waiting = None if not len(tail) else b.slice(int(tail[0]), 1) if len(tail) == 1 else True
        kept = np.flatnonzero(~drop)
        if len(kept):
            columns = list(b.columns)
            columns[_NAMES.index("kind")] = pa.array(out.astype(np.int32))
            yield pa.RecordBatch.from_arrays(columns, names=_NAMES).take(pa.array(kept))


def _fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of a document with its slices to the slices' bytes."""
    names = ["group", "doc_id", "tag", "start", "bytes"]
    for b in scratch.small_batches(batches, 64):
        out: list[list] = [[] for _ in names]
        for doc, tag, text, wanted in zip(*(c.to_pylist() for c in b.columns), strict=True):
            data = (text or "").encode("utf-8", "replace")
            for s in wanted:
                for c, v in zip(out, (s["group"], doc, tag, s["start"], data[s["start"] : s["start"] + s["n"] + LENGTH - 1]), strict=True):
                    c.append(v)
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.binary() if k == "bytes" else pa.int64()) for c, k in zip(out, names, strict=True)], names=names)


def repeated_strings(slices: list[bytes]) -> np.ndarray:
    """Of slices in their order: for each byte of their concatenation, whether a repeated string starts there."""
    sizes = np.array([len(s) for s in slices], np.int64)
    raw = np.frombuffer(b"\0".join([*slices, b""]), np.uint8)
    t = raw.astype(np.int16) + 1
    ends = np.cumsum(sizes + 1) - 1
    t[ends] = 0
    room = np.repeat(ends, sizes + 1) - np.arange(len(t))
    order = suffix_array(t, LENGTH, room >= LENGTH)
    order = order[room[order] >= LENGTH]
    hit = np.zeros(len(t), bool)
    if len(order):
        new = np.concatenate(([True], ~common_prefix_reaches(raw, order[:-1], order[1:], LENGTH)))
        heads = np.flatnonzero(new)
        hit[order] = True
        hit[np.minimum.reduceat(order, heads)] = False
    return hit


def _ranges(hit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    edge = np.diff(np.concatenate(([0], hit.view(np.int8), [0])))
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def _in_order(pdf: pd.DataFrame) -> tuple[pd.DataFrame, list[bytes], np.ndarray]:
    """Slices by place, their bytes, and where each begins in the bytes joined by single separators."""
    pdf = pdf.sort_values(["doc_id", "tag", "start"], na_position="first", ignore_index=True)
    slices = [bytes(x) for x in pdf["bytes"]]
    return pdf, slices, np.cumsum([0] + [len(s) + 1 for s in slices])[:-1]


def _places(pdf: pd.DataFrame, base: np.ndarray, starts: np.ndarray, n: np.ndarray) -> pd.DataFrame:
    """Places in the joined bytes as ``doc_id, tag, start, n``."""
    row = np.searchsorted(base, starts, side="right") - 1
    out = pdf.loc[row, ["doc_id", "tag", "start"]].reset_index(drop=True)
    out["start"] += starts - base[row]
    out["n"] = n
    return out


def _suffix_group(pdf: pd.DataFrame) -> pd.DataFrame:
    pdf, slices, base = _in_order(pdf)
    starts, stops = _ranges(repeated_strings(slices))
    return _places(pdf, base, starts, stops - starts)


SPREAD = "bucket long, doc_id long, tag long, start long, n long, bytes binary"


def _spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Chunks of slices (``doc_id, tag, start, bytes``) to ``SPREAD``: what repeats within a chunk (bucket and bytes null)
    and the first places of its different strings, each with the bucket that its bytes lead to."""
    types = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary())

    def flush(held: list[pd.DataFrame]) -> Iterator[pa.RecordBatch]:
        pdf, slices, base = _in_order(pd.concat(held, ignore_index=True))
        hit = repeated_strings(slices)
        starts, stops = _ranges(hit)
        known = _places(pdf, base, starts, stops - starts)
        joined = b"\0".join([*slices, b""])
        first = np.concatenate([np.arange(b, b + max(0, len(x) - LENGTH + 1)) for b, x in zip(base, slices, strict=True)])
        first = first[~hit[first]]
        fresh = _places(pdf, base, first, np.ones(len(first), np.int64))
        fresh["bytes"] = [joined[p : p + LENGTH] for p in first.tolist()]
        fresh["bucket"] = np.array([xxhash.xxh3_64_intdigest(x) for x in fresh["bytes"]], np.uint64).view(np.int64)
        for part in (known.assign(bucket=None, bytes=None), fresh):
            if len(part):
                yield pa.RecordBatch.from_arrays([pa.array(part[c], t, from_pandas=True) for c, t in zip(("bucket", "doc_id", "tag", "start", "n", "bytes"), types, strict=True)], names=["bucket", "doc_id", "tag", "start", "n", "bytes"])

    held, n = [], 0
    for b in scratch.small_batches(batches, GROUP_SLICES):
        if b.num_rows:
            held.append(b.to_pandas(types_mapper={pa.int64(): pd.Int64Dtype()}.get))
            n += b.num_rows
        if n >= GROUP_SLICES:
            yield from flush(held)
            held, n = [], 0
    if held:
        yield from flush(held)


def _in_groups(slices: DataFrame, groups: int) -> DataFrame:
    """Repeats by a suffix array for each ``group``, in as many tasks as the number of groups asks for."""
    tasks = max(int(slices.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-groups // TASK_GROUPS))
    return slices.repartition(tasks, "group").groupBy("group").applyInPandas(_suffix_group, "doc_id long, tag long, start long, n long")


def repeat_ranges(docs: DataFrame, twins: bool) -> DataFrame:
    """From ``doc_id, tag, text``, places of repeated strings: ``doc_id, tag, start, n`` (``n`` strings from byte ``start``).
    ``twins``: whether rows may share id and text."""
    sketch = docs.mapInArrow(_slices(frozenset()), SLICE).where(F.col("kind") == OPEN).agg(F.expr(f"approx_top_k(anchor, {MAX_HOT}, {SKETCH_ITEMS})").alias("top"), F.count(F.lit(1)).alias("slices")).first()
    often = min(max(HOT_SLICES, sketch["slices"] // HOT_SHARE), HOT_MOST)
    hot = frozenset(r["item"] for r in (sketch["top"] or []) if r["count"] >= often)  # at most MAX_HOT numbers
    tasks = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-sketch["slices"] // TASK_ROWS))
    found = docs.mapInArrow(_slices(hot), SLICE).repartition(tasks, "key").sortWithinPartitions("key", "kind", "anchor", "content", "doc_id", "tag", "start")
    found = scratch.table(found.mapInArrow(_compare, SLICE), "slices")
    repeats = found.where(F.col("kind") == REPEAT).select("doc_id", "tag", "start", "n")
    # what is still open is dealt by anchor to groups of about GROUP_SLICES; only larger anchors are spread
    rest = found.where(F.col("kind") != REPEAT)
    sizes = rest.groupBy("kind", "anchor").agg(F.count(F.lit(1)).alias("slices")).where("slices > 1")
    groups = max(1, -(-rest.count() // GROUP_SLICES))
    hot_sizes = F.broadcast(sizes.where(F.col("kind") == SPLIT).drop("kind"))  # at most MAX_HOT rows
    open_ = rest.where(F.col("kind") == SPLIT).join(hot_sizes, "anchor").unionByName(rest.where(F.col("kind") == OPEN).join(sizes.where(F.col("kind") == OPEN).drop("kind"), "anchor"))
    open_ = open_.withColumn("group", F.when(F.col("slices") > GROUP_MOST, F.lit(-1)).otherwise(F.pmod(F.xxhash64("anchor"), F.lit(groups))))
    wanted = open_.groupBy("doc_id", "tag").agg(F.collect_list(F.struct("group", "start", "n")).alias("wanted"))  # a document's own
    same = docs["doc_id"].eqNullSafe(wanted["doc_id"]) & (docs["tag"] == wanted["tag"])
    fetched = docs.join(wanted, same).select(docs["doc_id"], docs["tag"], "text", "wanted").mapInArrow(_fetch, "group long, doc_id long, tag long, start long, bytes binary")
    fetched = scratch.table(fetched.distinct() if twins else fetched, "borders")
    arrays = _in_groups(fetched.where("group >= 0"), groups)
    spread = scratch.table(fetched.where("group < 0").select("doc_id", "tag", "start", "bytes").mapInArrow(_spread, SPREAD), "spread")
    buckets = max(1, -(-spread.where("bucket is not null").count() // GROUP_SLICES))
    strings = spread.where("bucket is not null").select(F.pmod("bucket", F.lit(buckets)).alias("group"), "doc_id", "tag", "start", "bytes")
    return reduce(DataFrame.unionByName, [repeats, arrays, spread.where("bucket is null").select("doc_id", "tag", "start", "n"), _in_groups(strings, buckets)])


def _has_twins(docs: DataFrame) -> bool:
    """Whether ids don't tell the rows apart."""
    return bool(docs.groupBy("doc_id").count().where("count > 1 or doc_id is null").limit(1).count())


def cut_ranges(data: bytes, ranges: list[tuple[int, int]]) -> tuple[bytes, list[tuple[int, int]]]:
    """What remains of ``data`` without the bytes under strings that start at ``start .. start + n``; the removed runs."""
    runs: list[list[int]] = []
    for start, n in sorted(ranges):
        stop = start + n + LENGTH - 1
        if runs and start <= runs[-1][1]:
            runs[-1][1] = max(runs[-1][1], stop)
        else:
            runs.append([start, stop])
    kept, at = [], 0
    for a, b in runs:
        kept.append(data[at:a])
        at = b
    return b"".join([*kept, data[at:]]), [(a, b) for a, b in runs]


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in scratch.small_batches(batches):
        out = []
        for text, ranges in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
            data = (text or "").encode("utf-8", "replace")
            kept, runs = cut_ranges(data, [(r["start"], r["n"]) for r in ranges or []])
            out.append((len(data), len(data) - len(kept), len(runs), hashlib.sha256(kept).hexdigest(), kept))
        columns = list(zip(*out, strict=True)) if out else [()] * 5
        types = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary())
        yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(list(c), t) for c, t in zip(columns, types, strict=True))], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: ``doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept`` (the remaining bytes)."""
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    twins = _has_twins(docs)
    docs = docs.select("doc_id", (F.xxhash64("text") if twins else F.lit(0).cast("long")).alias("tag"), "text")
    ranges = repeat_ranges(docs, twins).groupBy("doc_id", "tag").agg(F.collect_list(F.struct("start", "n")).alias("ranges"))  # a document's own
    same = docs["doc_id"].eqNullSafe(ranges["doc_id"]) & (docs["tag"] == ranges["tag"])
    joined = docs.join(ranges, same, "left").select(docs["doc_id"], "text", "ranges")
    return joined.mapInArrow(_cut, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")

"""Sharding by sampled splitters: shards of nearly equal bytes, each a range of the key order.

The key of a row is the hash of its text, then that of its id, then the row's number, so equal texts are neighbours and
lie in one shard unless their group is too large for that.

1. One pass writes a narrow table of keys, sizes and checksums; no text moves.
2. Keys are drawn with a chance that grows with the row's size (and, for half of it, with its share of the row count, so
   that crowds of tiny rows are split too).  Weighted quantiles of the draw are the splitters, each put at the start of
   its group of equal texts.
3. All rows are counted by range.  A range of over twice the mean bytes or rows is drawn from again, by itself, and
   subdivided; a range that holds one group only is subdivided within it.  Rounds go on until no range is overfull.
4. Consecutive ranges go to the shard in which their middle byte falls: a shard departs from the mean by a range at most.
   A row's slot is its place in its range after the rows of the shard's earlier ranges.

There are ``LEAST`` to ``MOST`` ranges and about twice as many splitters at most, by the number of rows: the driver and
the tasks hold those and nothing else, and no task gets more than twice a range's mean of bytes or rows, unless one row
is larger.  Draws are by hash, so a retried task draws the same.

Defined results: a null text has no bytes (size 1, checksum 0) and equals an empty one.  Null ids are keys like others;
rows that repeat, id and text alike, have slots of their own, in any order.  A document is never cut, so one that is
larger than a shard's share makes that shard larger.  Fewer rows than shards leave shards without rows; an empty table
gives an empty table.  Other columns are ignored by :func:`sharded` and pass through :func:`write_shards`.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sedgeline.llm import scratch

SHARDS, LEAST, MOST, ROWS_A_RANGE, DRAWS, ROUNDS = 8, 1024, 65_536, 1_000_000, 8, 64
LAW = "bytes"
LOWEST = -(2**63)
KEY = ("h", "t", "rid")
Key = tuple[int, int, int]


def _bytes(*columns: np.ndarray) -> np.ndarray:
    """Keys as byte strings that sort like the tuples of their longs."""
    wide = np.stack([c.astype(np.int64).view(np.uint64) ^ np.uint64(1 << 63) for c in columns], axis=1).astype(">u8")
    return np.ascontiguousarray(wide).view(f"S{8 * len(columns)}").ravel()


def _ranges(batch: pa.RecordBatch, splitters: np.ndarray) -> np.ndarray:
    """The range of each row: the number of splitters that are not above its key."""
    return np.searchsorted(splitters, _bytes(*[batch.column(c).to_numpy(zero_copy_only=False) for c in KEY]), side="right")


def _packed(splitters: list[Key]) -> np.ndarray:
    return _bytes(*np.array(splitters, dtype=np.int64).reshape(-1, 3).T)


def _counted(rows: DataFrame, splitters: list[Key]) -> dict[int, tuple[int, int, Key, Key]]:
    """By range: bytes, rows, smallest and largest key."""
    cuts = _packed(splitters)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array(_ranges(b, cuts), pa.int32()), *[b.column(c) for c in (*KEY, "size")]], names=["range", *KEY, "size"])

    key = F.struct(*KEY)
    found = rows.select(*KEY, "size").mapInArrow(work, "range int, h long, t long, rid long, size long").groupBy("range").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("n"), F.min(key).alias("low"), F.max(key).alias("high"))
    return {r.range: (r.bytes, r.n, tuple(r.low), tuple(r.high)) for r in found.collect()}  # at most a row for each range


def _drawn(rows: DataFrame, splitters: list[Key], rates: dict[int, tuple[float, float]], seed: int) -> dict[int, list[tuple[Key, float]]]:
    """Drawn keys with their weights, in order, of each range that has rates: expected draws a byte and a row."""
    cuts, by_byte, by_row = _packed(splitters), np.zeros(len(splitters) + 1), np.zeros(len(splitters) + 1)
    for k, (a, b) in rates.items():
        by_byte[k], by_row[k] = a, b

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = _ranges(b, cuts)
            chance = by_byte[at] * b.column("size").to_numpy() + by_row[at]
            hit = np.flatnonzero(b.column("u").to_numpy() < chance)
            taken = b.take(pa.array(hit))
            yield pa.RecordBatch.from_arrays([pa.array(at[hit], pa.int32()), *[taken.column(c) for c in KEY], pa.array(np.maximum(chance[hit], 1.0))], names=["range", *KEY, "weight"])

    uniform = F.shiftrightunsigned(F.xxhash64(*KEY, F.lit(seed)), 11) / F.lit(float(1 << 53))
    out: dict[int, list[tuple[Key, float]]] = {}
    for r in rows.select(*KEY, "size", uniform.alias("u")).mapInArrow(work, "range int, h long, t long, rid long, weight double").toLocalIterator():
        out.setdefault(r.range, []).append(((r.h, r.t, r.rid), r.weight))
    return {k: sorted(v) for k, v in out.items()}


def _cuts(drawn: list[tuple[Key, float]], pieces: int, within: bool) -> set[Key]:
    """Keys that cut the drawn weight into about so many pieces: any key within a group of equal texts, else starts of
    groups, and the ends of those that weigh a piece by themselves."""
    weights = np.cumsum([w for _, w in drawn])
    at = np.unique(np.searchsorted(weights, weights[-1] * np.arange(1, pieces) / pieces, side="left"))
    if within:
        return {drawn[k][0] for k in at}
    groups: dict[int, float] = {}
    for (h, _, _), w in drawn:
        groups[h] = groups.get(h, 0.0) + w
    return {_start(drawn[k][0][0]) for k in at} | {_start(h + 1) for h, w in groups.items() if w * pieces >= weights[-1] and h < -LOWEST - 1}


def _start(h: int) -> Key:
    return h, LOWEST, LOWEST


def splitters_of(rows: DataFrame, least: int = LEAST, most: int = MOST) -> tuple[list[Key], dict[int, tuple[int, int, Key, Key]]]:
    """Splitters in order and the counts of the ranges between them; ``rows`` has ``h, t, rid, size``."""
    total = rows.agg(F.coalesce(F.sum("size"), F.lit(0)).alias("bytes"), F.count(F.lit(1)).alias("n")).first()
    if not total.n:
        return [], {}
    wanted = min(most, max(least, total.n // ROWS_A_RANGE))
    rate = wanted * DRAWS / 2
    splitters: list[Key] = []
    first = _drawn(rows, [], {0: (rate / total.bytes, rate / total.n)}, 0).get(0)
    fresh = _cuts(first, wanted, False) if first else set()
    counts: dict[int, tuple[int, int, Key, Key]] = {}
    for turn in range(1, ROUNDS):
        splitters = sorted({*splitters, *fresh})
        counts = _counted(rows, splitters)
        share = {k: max(b * wanted / total.bytes, n * wanted / total.n) for k, (b, n, _, _) in counts.items() if n > 1}
        full = {k: x for k, x in share.items() if x > 2}
        if not full:
            break
        rates = {k: (DRAWS * x / 2 / counts[k][0], DRAWS * x / 2 / counts[k][1]) for k, x in full.items()}
        drawn, fresh = _drawn(rows, splitters, rates, turn), set()
        for k, x in full.items():
            _, _, low, high = counts[k]
            within = low[0] == high[0]  # one group of equal texts
            start = low if within else _start(low[0])
            found = {key for key in (_cuts(drawn[k], int(x) + 1, within) if k in drawn else ()) if start < key <= high}
            fresh |= found or {high if within else _start(low[0] + 1)}
    return splitters, counts


def keyed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, size, text_crc32`` and the key of each row, written once."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    return scratch.table(
        docs.select(F.col(id_col).alias("doc_id"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.xxhash64(text).alias("h"), F.xxhash64(F.col(id_col)).alias("t"), F.monotonically_increasing_id().alias("rid")),
        "keys",
    )


def placed(rows: DataFrame, shards: int = SHARDS, least: int = LEAST, most: int = MOST) -> DataFrame:
    """``rows`` of :func:`keyed` with ``shard`` and ``slot``."""
    splitters, counts = splitters_of(rows, least, most)
    total = sum(b for b, *_ in counts.values())
    shard, base = np.zeros(len(splitters) + 1, dtype=np.int32), np.zeros(len(splitters) + 1, dtype=np.int64)
    before, filled = 0, [0] * shards
    for k in sorted(counts):
        size, n = counts[k][:2]
        shard[k] = min(shards - 1, (2 * before + size) * shards // (2 * total))
        base[k] = filled[shard[k]]
        filled[shard[k]] += n
        before += size
    cuts = _packed(splitters)
    names = rows.columns

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = _ranges(b, cuts)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(at, pa.int32()), pa.array(shard[at]), pa.array(base[at])], names=[*names, "range", "shard", "base"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    ranged = rows.mapInArrow(work, f"{kinds}, range int, shard int, base long")
    place = F.row_number().over(Window.partitionBy("range").orderBy(*KEY))
    return ranged.withColumn("slot", F.col("base") + place - 1).drop("range", "base")


def sharded(docs: DataFrame, shards: int = SHARDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: ``doc_id, size, text_crc32, law, shard, slot, grown_shard``."""
    rows = placed(keyed(docs, id_col, text_col), shards)
    return rows.select("doc_id", "size", "text_crc32", F.lit(LAW).alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def write_shards(docs: DataFrame, path: str, shards: int = SHARDS, id_col: str = "doc_id", text_col: str = "text", files_a_shard: int = 16) -> str:
    """Write the rows of ``docs``, with their slots, below ``path/__shard=N``; a shard's files are ranges of its slots."""
    rows = scratch.numbered(docs, "__row", "numbered")
    text = F.coalesce(F.col(text_col), F.lit(""))
    keys = rows.select(F.col("__row").alias("rid"), (F.octet_length(text) + 1).cast("long").alias("size"), F.xxhash64(text).alias("h"), F.xxhash64(F.col(id_col)).alias("t"))
    places = placed(scratch.table(keys, "keys"), shards).select(F.col("rid").alias("__row"), F.col("shard").alias("__shard"), F.col("slot").alias("__slot"))
    out = rows.join(places, "__row").drop("__row").repartitionByRange(shards * files_a_shard, "__shard", "__slot").sortWithinPartitions("__shard", "__slot")
    out.write.partitionBy("__shard").parquet(path)
    return path

"""Mixing sources to target weights.

Each source's words (the tokens here) are packed, document after document, into blocks of ``BLOCK_WORDS``; the last
block of a source is short.  Every output shard draws how many blocks it takes of each source from a multinomial over
what the sources still owe, so the shards differ at random and the totals come out at the targets.  The j-th slot of a
source is mapped through a keyed pseudorandom permutation of the source's block numbers, one permutation an epoch, and
slots and blocks are joined by block number.  The last slot of a source is cut to the word.

Nothing but one row per source (at most ``MOST_SOURCES``) and one per source and shard is on the driver.  Shards grow with the
mix up to ``MOST_SHARDS``; the slots of a shard and source are numbered in runs of ``RUN_SLOTS``.  Where a document starts within its source comes from
sums over hash ranges of the source's rows, so a source with a third of all rows is spread over ``RANGES`` groups and
more where rows ask for it; rows that share an id (or have none) are spread by their texts.

Defined results: a null text has no words; a null source is a source of its own, last in order; sources are ordered by
code point and weigh 3, 1, 2, repeating.  Null ids and repeated rows are rows of their own, in the report and in the
mix.  An empty table gives an empty mix.  Extra columns are ignored, or kept with the pieces, whatever their names.
More sources than ``MOST_SOURCES`` are an error: their shares would not be weights but single documents.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from sedgeline.llm import scratch

WEIGHTS = (3, 1, 2)
SHARE = 1.5
MOST_REPEATS = 2
BLOCK_WORDS = 512
SHARDS, MOST_SHARDS, SHARD_SLOTS = 64, 4096, 1 << 16  # shards of about that many slots, at least and at most
RUN_SLOTS = 1 << 16
MOST_SOURCES = 100_000
SEED = 17
RANGES = 256
RANGE_ROWS = 50_000
WORD = r"[^\x20\x09-\x0D]+"


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: dict[str | None, int], weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: float = MOST_REPEATS) -> dict[str | None, float]:
    """Words to take of each source: ``share`` of all words split by weight, none above ``most`` times its size."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    left, open_, out = share * sum(sizes.values()), set(order), {}
    while open_:
        unit = left / sum(weight[s] for s in open_)
        full = {s for s in open_ if unit * weight[s] >= most * sizes[s]}
        if not full:
            return out | {s: unit * weight[s] for s in open_}
        out |= {s: float(most * sizes[s]) for s in full}
        left -= sum(most * sizes[s] for s in full)
        open_ -= full
    return out


class Permutation:
    """Keyed pseudorandom permutation of ``0..n-1``: a four-round Feistel network, walked until it falls below ``n``."""

    def __init__(self, n: int, key: int):
        self.n = n
        self.half = np.uint64(max(1, (max(2, n) - 1).bit_length() + 1 >> 1))
        self.mask = np.uint64((1 << int(self.half)) - 1)
        self.keys = np.random.SeedSequence(key).generate_state(4, np.uint64)

    def _round(self, x: np.ndarray, key: np.uint64) -> np.ndarray:
        x = (x ^ key) * np.uint64(0x9E3779B97F4A7C15)
        x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        return (x ^ (x >> np.uint64(32))) & self.mask

    def _walk(self, i: np.ndarray, keys: np.ndarray, back: bool) -> np.ndarray:
        out, todo = np.array(i, dtype=np.uint64), np.arange(len(i))
        while len(todo):
            a, b = out[todo] >> self.half, out[todo] & self.mask
            for k in keys:
                a, b = (b ^ self._round(a, k), a) if back else (b, a ^ self._round(b, k))
            out[todo] = a << self.half | b
            todo = todo[out[todo] >= self.n]
        return out.astype(np.int64)

    def forward(self, i: np.ndarray) -> np.ndarray:
        return self._walk(i, self.keys, False)

    def inverse(self, i: np.ndarray) -> np.ndarray:
        return self._walk(i, self.keys[::-1], True)


@dataclass(frozen=True)
class Quota:
    """What the mix takes of a source: ``slots`` blocks in order, the last of which up to word ``last_words``."""

    slots: int
    last_words: int


def _key(source_no: int, epoch: int, seed: int) -> int:
    return (seed << 40) + (source_no << 8) + epoch


def quota(size: int, words: int, source_no: int, block: int = BLOCK_WORDS, seed: int = SEED) -> Quota:
    """Slots that take exactly ``words`` words of a source, however its short last block is placed."""
    if not size or not words:
        return Quota(0, 0)
    blocks, short = -(-size // block), size % block or block
    epoch, rest = divmod(words, size)
    if not rest:
        epoch, rest = epoch - 1, size
    at = int(Permutation(blocks, _key(source_no, epoch, seed)).inverse(np.array([blocks - 1]))[0])
    if rest <= at * block:
        slots, last = -(-rest // block), (rest - 1) % block + 1
    elif rest <= at * block + short:
        slots, last = at + 1, rest - at * block
    else:
        rest -= at * block + short
        slots, last = at + 1 + -(-rest // block), (rest - 1) % block + 1
    return Quota(epoch * blocks + slots, last)


def shard_draws(slots: list[int], shards: int = SHARDS, seed: int = SEED) -> np.ndarray:
    """Slots by shard and source: multinomial draws over what is still owed; the last shard takes the rest."""
    rng, owed = np.random.default_rng(seed), np.array(slots, dtype=np.int64)
    out = np.zeros((shards, len(slots)), dtype=np.int64)
    for k in range(shards):
        want = int(owed.sum()) // (shards - k) if k < shards - 1 else int(owed.sum())
        while want:
            drawn = np.minimum(rng.multinomial(want, owed / owed.sum()), owed)
            out[k] += drawn
            owed -= drawn
            want -= int(drawn.sum())
    return out


def _sized(docs: DataFrame, id_col: str, text_col: str, source_col: str, rid: Column) -> DataFrame:
    text = F.col(text_col)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), n_words(text).alias("size"), F.xxhash64(F.col(id_col), text).alias("place"), rid.alias("rid"))
    return scratch.table(rows, "sizes")


def _starts(sized: DataFrame, rows: int) -> DataFrame:
    """Adds ``start``: the words of the source before the row, in an order by hash range, id and text."""
    n = max(RANGES, -(-rows // RANGE_ROWS))
    ranged = sized.withColumn("range", F.pmod("place", F.lit(n)))
    sums = ranged.groupBy("source_no", "range").agg(F.sum("size").alias("words"))
    before = F.sum("words").over(Window.partitionBy("source_no").orderBy("range").rowsBetween(Window.unboundedPreceding, -1))
    sums = sums.select("source_no", "range", F.coalesce(before, F.lit(0)).alias("base"))
    within = F.sum("size").over(Window.partitionBy("source_no", "range").orderBy("doc_id", "place", "rid").rowsBetween(Window.unboundedPreceding, -1))
    return ranged.withColumn("within", F.coalesce(within, F.lit(0))).join(sums, ["source_no", "range"]).withColumn("start", F.col("base") + F.col("within"))


def _slots(spark: SparkSession, quotas: list[Quota], blocks: list[int], shards: int, block: int, seed: int) -> DataFrame:
    """Every slot of the mix: ``shard, source_no, block_no, words`` (how many of the block it takes at most)."""
    draws, plan = shard_draws([q.slots for q in quotas], shards, seed), []
    first = np.zeros(len(quotas), dtype=np.int64)
    for k in range(shards):
        plan += [(k, s, int(first[s]), int(draws[k, s])) for s in range(len(quotas)) if draws[k, s]]
        first += draws[k]
    last = {s: (q.slots - 1, q.last_words) for s, q in enumerate(quotas)}

    def permuted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            shard, source, slot = (c.to_numpy(zero_copy_only=False) for c in b.columns)
            number, words = np.empty(len(slot), np.int64), np.full(len(slot), block, np.int64)
            for s in np.unique(source).tolist():
                for e in np.unique(slot[source == s] // blocks[s]).tolist():
                    mine = np.flatnonzero((source == s) & (slot // blocks[s] == e))
                    number[mine] = Permutation(blocks[s], _key(s, e, seed)).forward(slot[mine] % blocks[s])
                words[(source == s) & (slot == last[s][0])] = last[s][1]
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (shard, source, slot, number, words)], names=["shard", "source_no", "slot", "block_no", "words"])

    planned = spark.createDataFrame(plan, "shard int, source_no int, first long, n long").repartition(shards, "shard")
    runs = planned.selectExpr("shard", "source_no", "first", "n", f"explode(sequence(0L, (n - 1) div {RUN_SLOTS})) AS run")
    slots = runs.selectExpr("shard", "source_no", f"explode(sequence(first + run * {RUN_SLOTS}, first + least(n, (run + 1) * {RUN_SLOTS}) - 1)) AS slot")
    return slots.mapInArrow(permuted, "shard int, source_no int, slot long, block_no long, words long")


@dataclass(frozen=True)
class Mix:
    """``sized``: one row per input row with its source's size and target.  ``pieces``: what the mix takes, as rows
    ``rid, doc_id, shard, source_no, slot, from_word, to_word, in_block`` (word numbers within the document, end exclusive,
    and the first one's within the block)."""

    sized: DataFrame
    pieces: DataFrame


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = WEIGHTS,
        share: float = SHARE, most: float = MOST_REPEATS, block: int = BLOCK_WORDS, shards: int | None = None, seed: int = SEED, rid: Column | None = None) -> Mix:
    """``rid``: what tells the rows apart; by default their place in the table."""
    spark, sized = docs.sparkSession, _sized(docs, id_col, text_col, source_col, F.monotonically_increasing_id() if rid is None else rid)
    found = sized.groupBy("source").agg(F.sum("size").alias("size"), F.count(F.lit(1)).alias("rows")).limit(MOST_SOURCES + 1).collect()
    if len(found) > MOST_SOURCES:
        raise ValueError(f"more than {MOST_SOURCES} sources")
    found.sort(key=lambda r: (r["source"] is None, r["source"] or ""))
    want = targets({r["source"]: r["size"] for r in found}, weights, share, most)
    quotas = [quota(r["size"], min(round(want[r["source"]]), math.floor(most * r["size"])), i, block, seed) for i, r in enumerate(found)]
    blocks = [max(1, -(-r["size"] // block)) for r in found]
    shards = shards or max(SHARDS, min(MOST_SHARDS, sum(q.slots for q in quotas) // SHARD_SLOTS))
    table = [(r["source"], i, r["size"], float(want[r["source"]])) for i, r in enumerate(found)]
    sources = spark.createDataFrame(table, "source string, source_no int, source_size long, target double")
    sized = sized.join(F.broadcast(sources), sized["source"].eqNullSafe(sources["source"])).drop(sources["source"])
    rows = sum(r["rows"] for r in found)
    placed = _starts(sized.where("size > 0"), rows)
    parts = placed.selectExpr("rid", "doc_id", "source_no", "start", "size", f"explode(sequence(start div {block}, (start + size - 1) div {block})) AS block_no")
    slots = _slots(spark, quotas, blocks, shards, block, seed)
    pieces = parts.join(slots.hint("merge"), ["source_no", "block_no"]).selectExpr(
        "rid", "doc_id", "shard", "source_no", "slot", f"greatest(block_no * {block}, start) - start AS from_word",
        f"least(block_no * {block} + words, start + size) - start AS to_word", f"greatest(block_no * {block}, start) - block_no * {block} AS in_block",
    ).where("from_word < to_word")
    return Mix(sized, pieces)


def taken_words(docs: DataFrame, **options) -> DataFrame:
    """One row per input row: ``doc_id, size, source_size, target, taken``."""
    m = mix(docs, **options)
    taken = m.pieces.groupBy("rid").agg(F.sum(F.col("to_word") - F.col("from_word")).alias("taken"))
    return m.sized.join(taken, "rid", "left").select("doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0).cast("long")).alias("taken"))


def mixed_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", chars_col: str | None = "n_chars",
                    placed: bool = False, **options) -> DataFrame:
    """The mix itself: a row for each piece that it takes, with the columns of ``docs`` and the piece as text.

    Pieces keep the white space within them.  If ``placed``, columns ``mix_shard, mix_slot, mix_offset`` say where a
    piece goes: the pieces of a shard in the order of slot and offset are its fixed-length blocks.  Rows are numbered
    once, in a written table, so rows without an id or with another row's are mixed like any other."""
    mark, at = "__sedgeline_rid", "__sedgeline_spans"
    docs = scratch.numbered(docs, mark, "mix-rows")
    m = mix(docs, id_col, text_col, source_col, rid=F.col(mark), **options)
    spans = m.pieces.groupBy(F.col("rid").alias(mark)).agg(F.array_sort(F.collect_list(F.struct("slot", "from_word", "to_word", "shard", "in_block"))).alias(at))  # of one row
    joined = docs.join(spans, mark)
    schema = docs.drop(mark).schema
    names, extra = schema.names, ("mix_shard", "mix_slot", "mix_offset") if placed else ()

    def take(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import re

        word = re.compile(WORD)
        for b in scratch.small_batches(batches):
            rows, texts, places = [], [], []
            for i, (text, spans) in enumerate(zip(b.column(names.index(text_col)), b.column(len(names)), strict=True)):
                text = text.as_py()
                cuts = [w.span() for w in word.finditer(text)]
                for s in spans.as_py():
                    rows.append(i)
                    texts.append(text[cuts[s["from_word"]][0] : cuts[s["to_word"] - 1][1]])
                    places.append((s["shard"], s["slot"], s["in_block"]))
            picked = b.take(pa.array(rows, pa.int64()))
            columns = {n: picked.column(k) for k, n in enumerate(names)} | {text_col: pa.array(texts, pa.string())}
            if chars_col in names:
                columns[chars_col] = pa.array([len(t) for t in texts], b.schema.field(chars_col).type)
            more = [pa.array(list(c), pa.int64()) for c in zip(*places, strict=True)] if placed and places else [pa.array([], pa.int64())] * len(extra)
            yield pa.RecordBatch.from_arrays([*(columns[n] for n in names), *more], names=[*names, *extra])

    out = schema
    for c in extra:
        out = StructType([*out.fields, StructField(c, LongType())])
    return joined.select(*names, at).mapInArrow(take, out)

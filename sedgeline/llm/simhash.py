"""SimHash near-dedup by segment-popcount embedding.

A fingerprint is embedded as the bit counts of its two-bit segments, the axes.  The Manhattan distance of two such vectors
never exceeds the Hamming distance of the fingerprints.  Counts are written in unary (00, 01, 11), so that the Manhattan
distance of two vectors is the number of bits in which their codes differ.

*Two bits apart* (:func:`near_components`).  Fingerprints of 64 bits at distance 2 or less differ on at most two of the
32 axes, so in at most two of eight blocks of four axes.  A grid has one of the 28 pairs of blocks left open; its cells
are vectors that agree on the other 24 axes (34 bits of selectivity, so that cells of unlike fingerprints hold less than
one on average up to some billion of them).  Each distinct fingerprint lies in a cell of each grid; cells are joined with themselves under
the Manhattan bound, and what is left is verified by the exact bit distance.  Cells that hold more than ``CELL``
fingerprints are thousands of near copies and would give pairs by the square: they are split by the finest grid, of
one-bit segments, whose cells have one axis left open around a centre.  Any two fingerprints within two bits share
such a cell; it has at most 65 fingerprints, all within two bits of each other, so a star links them.

*Of a given similarity* (:func:`similar_classes`, :func:`drop_similar_copies`).  Shingle and similarity are parameters.
Fingerprints have ``WIDE`` bits here.  For ``NEAR_ROUNDS`` rounds there are grids, each of a bit permutation of its own.  In
the order of a grid's axes a cell is a run; each fingerprint meets its ``WINDOW`` neighbours on either side, and the nearest
one under the Manhattan bound and then within the bits is verified by the Jaccard similarity of the texts' own shingles.
Similarity 0.8 is about 15 in 100 bits, which no grid holds for sure, so what neighbours miss is found exactly:
two sets of this similarity share some of the first shingles of both, in any order of all shingles (:func:`_meeting`).  Texts
of different components that meet in so many, and whose sizes and places allow the similarity, are verified, all of
them.  Shingles of many components, by a sample of the texts, are last in that order; nothing but the work rests on it.

Equal fingerprints, or equal sets of shingles, are collapsed first, so a group of copies of any size is one node.
Defined results: words are runs of anything but ASCII white space; A-Z are lower-cased; a null text is empty; no word
gives fingerprint zero, which links like any other.  A row without an id takes the component of the rows with its
fingerprint; a fingerprint that only such rows have is no node, and its component is null.  Rows that repeat are all
returned by :func:`near_components`; :func:`drop_similar_copies` tells rows apart by place, not by id, and of a class
keeps the row with the smallest id, none being largest, then the smallest text.  An empty table gives an empty table.
Extra columns are ignored, or kept with the rows that stay.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sedgeline.llm import scratch
from sedgeline.llm.components import components

SHINGLE = 3
SEED = 42
BITS_APART = 2
CELL = 64
WIDE = 512
WINDOW = 16
NEAR_ROUNDS, NEAR_GRIDS = 2, 8
SAMPLED, FREQUENT, MOST_FREQUENT, MEET, BEFORE = 16, 4, 1 << 16, 4, 8
_CHUNK = 1 << 16


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """Unsigned 64-bit SimHash of one text."""
    words = (text or "").encode("utf-8", "replace").lower().split()
    if not words:
        return 0
    joined, n = b" ".join(words), max(1, len(words) - shingle + 1)
    if n == 1:
        return xxhash.xxh64_intdigest(joined, SEED)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))[:n]
    digest, ones = xxhash.xxh64_intdigest, np.zeros(64, np.int64)
    spans = list(zip(starts.tolist(), ends[shingle - 1 :].tolist(), strict=True))
    for i in range(0, n, _CHUNK):
        h = np.array([digest(joined[a:b], SEED) for a, b in spans[i : i + _CHUNK]], dtype=">u8")
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > n).tobytes(), "big")


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        prints = np.array([fingerprint(t.as_py()) for t in batch.column(1)], dtype=np.uint64).view(np.int64)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(prints)], names=["doc_id", "fp"])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, fp)`` with the fingerprint as a signed long."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(_fingerprints, "doc_id long, fp long")


def _axes(fp: str) -> str:
    """SQL of the vector: counts of the 32 two-bit segments in unary code, two bits each."""
    low = "6148914691236517205L"  # the lower bit of each segment
    return f"((({fp} | shiftrightunsigned({fp}, 1)) & {low}) | shiftleft({fp} & shiftrightunsigned({fp}, 1) & {low}, 1))"


def _cells(prints: DataFrame) -> DataFrame:
    """28 rows ``(grid, cell, fp)`` for each fingerprint: a cell is the vector without two of its eight blocks."""
    masks = [~(255 << 8 * i | 255 << 8 * j) & (1 << 64) - 1 for i in range(8) for j in range(i)]
    signed = [m - (1 << 64) if m >> 63 else m for m in masks]
    grids = F.array(*[F.struct(F.lit(k).alias("grid"), F.col("vec").bitwiseAND(F.lit(m)).alias("cell")) for k, m in enumerate(signed)])
    return prints.selectExpr("fp", f"{_axes('fp')} AS vec").select("fp", F.inline(grids))


def near_links(prints: DataFrame, cell: int = CELL) -> DataFrame:
    """Links ``(a, b)`` between distinct fingerprints ``fp`` whose components are those of all pairs at 2 bits or less."""
    cells = _cells(prints).repartition("grid", "cell")
    sizes = cells.groupBy("grid", "cell").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    shared = scratch.table(cells.join(sizes, ["grid", "cell"]).select("grid", "cell", "fp", "n"), "cells")
    sparse = shared.where(F.col("n") <= cell).drop("n")
    pairs = (
        sparse.withColumnRenamed("fp", "a")
        .join(sparse.withColumnRenamed("fp", "b"), ["grid", "cell"])
        .where(f"a < b AND bit_count({_axes('a')} ^ {_axes('b')}) <= {BITS_APART} AND bit_count(a ^ b) <= {BITS_APART}")
        .select("a", "b")
    )
    dense = shared.where(F.col("n") > cell).select("fp").distinct()
    finest = dense.selectExpr("fp", "explode(concat(array(fp), transform(sequence(0, 63), i -> fp ^ shiftleft(1L, i)))) AS centre")
    stars = finest.groupBy("centre").agg(F.collect_set("fp").alias("near")).where("size(near) > 1")  # 65 at most
    return pairs.unionByName(stars.selectExpr("array_min(near) AS a", "explode(near) AS b").where("a <> b")).distinct()


def near_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: ``doc_id, fingerprint, component_id``."""
    marked = scratch.table(fingerprints(docs, id_col, text_col), "prints")
    nodes = marked.groupBy("fp").agg(F.min("doc_id").alias("node"))
    links = near_links(nodes.select("fp")).join(nodes.select(F.col("fp").alias("a"), F.col("node").alias("u")), "a").join(nodes.select(F.col("fp").alias("b"), F.col("node").alias("v")), "b")
    found = components(links.where("u is not null and v is not null").select("u", "v"))
    named = nodes.join(found, "node", "left").select("fp", F.coalesce("component", "node").alias("component_id"))
    return marked.join(named, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


# --- copies of a given similarity


def shingle_hashes(text: str | None, shingle: int) -> np.ndarray:
    """Distinct 64-bit hashes of the runs of ``shingle`` words; a shorter text is one run, one without words has none."""
    words = (text or "").encode("utf-8", "replace").lower().split()
    runs = {b" ".join(words[i : i + shingle]) for i in range(max(1, len(words) - shingle + 1))} if words else ()
    return np.fromiter((xxhash.xxh64_intdigest(r, SEED) for r in runs), np.uint64, len(runs))


def wide_fingerprint(text: str | None, shingle: int) -> bytes:
    """SimHash of ``WIDE`` bits over distinct shingles."""
    return _wide(shingle_hashes(text, shingle))


def _wide(h: np.ndarray) -> bytes:
    ones = np.zeros(WIDE, np.int64)
    for i in range(0, len(h), _CHUNK):
        words = []
        for k in range(WIDE // 64):  # further words of hash by mixing
            x = h[i : i + _CHUNK] + np.uint64(k * 0x9E3779B97F4A7C15 & (1 << 64) - 1)
            x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
            x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
            words.append(x ^ (x >> np.uint64(31)))
        ones += np.unpackbits(np.stack(words, axis=1).view(np.uint8).reshape(-1, WIDE // 8), axis=1).sum(axis=0, dtype=np.int64)
    return np.packbits(2 * ones > len(h)).tobytes()


def apart(similarity: float) -> float:
    """Share of SimHash bits in which two sets of equal size and this Jaccard similarity are expected to differ."""
    return math.acos(2 * similarity / (1 + similarity)) / math.pi


def _unary(bits: np.ndarray) -> np.ndarray:
    """Rows of bits to the counts of their two-bit segments in unary code, packed."""
    a, b = bits[:, 0::2], bits[:, 1::2]
    code = np.empty(bits.shape, np.uint8)
    code[:, 0::2], code[:, 1::2] = a | b, a & b
    return np.packbits(code, axis=1)


def bits_within(similarity: float) -> int:
    """Bits that texts of a similarity are apart at most, but for one in about 200."""
    return round(WIDE * apart(similarity) + 2.6 * math.sqrt(WIDE * apart(similarity) * (1 - apart(similarity))))


def _nodes(texts: DataFrame, shingle: int) -> tuple[DataFrame, DataFrame]:
    """Distinct sets of shingles ``rid, fp`` (the first text that has each, and its wide fingerprint), and pairs ``a, b`` of
    these and the others."""

    def prints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in scratch.small_batches(batches):
            sets = [shingle_hashes(t.as_py(), shingle) for t in b.column(1)]
            marks = [xxhash.xxh64_intdigest(np.sort(h).tobytes(), SEED) for h in sets]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([_wide(h) for h in sets], pa.binary()), pa.array(np.array(marks, np.uint64).view(np.int64))], names=["rid", "fp", "set"])

    marked = scratch.table(texts.select("rid", "text").mapInArrow(prints, "rid long, fp binary, set long"), "wide-prints")
    nodes = scratch.table(marked.groupBy("fp", "set").agg(F.min("rid").alias("rid"), F.count(F.lit(1)).alias("n")), "wide-nodes")
    copies = marked.join(nodes.where("n > 1").select("fp", "set", F.col("rid").alias("a")), ["fp", "set"]).where("rid <> a").select("a", F.col("rid").alias("b"))
    return nodes.select("rid", "fp"), copies


def _bytes(column: pa.Array) -> np.ndarray:
    """Fingerprints as rows of bytes."""
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, WIDE // 8)


def _neighbours(nodes: DataFrame, grids: range, radius: int, window: int) -> DataFrame:
    """From ``rid, comp, fp``: pairs ``(a, b)`` of each fingerprint and the nearest one of a different ``comp`` that is
    within the window in one of the grids and within the radius."""
    picks = [(k, np.random.default_rng([SEED, k]).permutation(WIDE)[:64]) for k in grids]  # so many axes order any number of texts

    def ordered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            bits = np.unpackbits(_bytes(b.column(2)), axis=1)
            for k, pick in picks:
                key = _unary(bits[:, pick]).view(">i8").ravel().astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(key), k, np.int32)), pa.array(key), *b.columns], names=["grid", "key", "rid", "comp", "fp"])

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for b in batches:
            if not b.num_rows:
                continue
            new = [*(b.column(c).to_numpy() for c in (0, 2, 3)), _bytes(b.column(4)).view(np.uint64)]
            old = 0 if held is None else len(held[0])
            grid, rid, comp, words = new if held is None else [np.concatenate(x) for x in zip(held, new, strict=True)]
            axes, found = _axes_of(words), []
            for k in range(1, min(window, len(grid) - 1) + 1):
                i = np.arange(max(0, old - k), len(grid) - k)
                i = i[(grid[i] == grid[i + k]) & (comp[i] != comp[i + k])]
                bound = np.bitwise_count(axes[i] ^ axes[i + k]).sum(axis=1, dtype=np.int32)  # Manhattan distance
                i = i[bound <= radius]
                bits = np.bitwise_count(words[i] ^ words[i + k]).sum(axis=1, dtype=np.int32)
                i, bits = i[bits <= radius], bits[bits <= radius]
                found.append(np.stack([i, i + k, bits], axis=1))
            held = [x[max(0, len(x) - window) :] for x in (grid, rid, comp, words)]
            pairs = np.concatenate(found) if found else np.zeros((0, 3), np.int64)
            if len(pairs):
                both = np.concatenate([pairs, pairs[:, [1, 0, 2]]])
                both = both[np.lexsort((both[:, 1], both[:, 2], both[:, 0]))]
                pairs = both[np.concatenate(([True], both[1:, 0] != both[:-1, 0]))]
                yield pa.RecordBatch.from_arrays([pa.array(rid[pairs[:, 0]]), pa.array(rid[pairs[:, 1]]), pa.array(pairs[:, 2].astype(np.int32))], names=["a", "b", "bits"])

    schema = "grid int, key long, rid long, comp long, fp binary"
    rows = nodes.select("rid", "comp", "fp").mapInArrow(ordered, schema).repartitionByRange("grid", "key").sortWithinPartitions("grid", "key", "rid")
    pairs = rows.mapInArrow(joined, "a long, b long, bits int")
    return pairs.groupBy("a").agg(F.min_by(F.struct("b", "bits"), F.struct("bits", "b")).alias("n")).select(F.least("a", "n.b").alias("a"), F.greatest("a", "n.b").alias("b")).distinct()


def _among(values: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Which values are among the sorted known ones."""
    if not len(known):
        return np.zeros(len(values), np.bool_)
    return known[np.minimum(np.searchsorted(known, values), len(known) - 1)] == values


def _first(texts: DataFrame, shingle: int, similarity: float, late: np.ndarray) -> DataFrame:
    """From ``rid, text``: ``token, rid, size, place`` of the first shingles of each text, those in ``late`` being last in the
    order: so many that a set of this similarity, which has the same order, has ``MEET`` of these among its own first, or all
    that both share."""

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in scratch.small_batches(batches):
            sets = [shingle_hashes(t.as_py(), shingle) for t in b.column(1)]
            sizes = np.fromiter(map(len, sets), np.int64, len(sets))
            taken = np.minimum(sizes, sizes - np.ceil(similarity * sizes - 1e-6).astype(np.int64) + MEET)
            kept = [h[np.lexsort((h, _among(h, late)))[:n]] for h, n in zip(sets, taken.tolist(), strict=True)]
            places = [np.arange(n, dtype=np.int32) for n in taken.tolist()]
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate([*kept, late[:0]]).view(np.int64)), b.column(0).take(pa.array(np.repeat(np.arange(len(sets)), taken))), pa.array(np.repeat(sizes, taken).astype(np.int32)), pa.array(np.concatenate([*places, np.zeros(0, np.int32)]))],
                names=["token", "rid", "size", "place"],
            )

    return texts.select("rid", "text").mapInArrow(first, "token long, rid long, size int, place int")


def _late(texts: DataFrame, comps: DataFrame, shingle: int, sampled: int, frequent: int) -> np.ndarray:
    """Sorted shingles that stand in ``frequent`` components of one in ``sampled`` texts, ``MOST_FREQUENT`` of them at most.
    They only order the shingles: see :func:`_first`."""
    tokens = _first(texts.where(F.pmod(F.xxhash64("rid"), F.lit(sampled)) == 0), shingle, 0.0, np.zeros(0, np.uint64))
    found = tokens.join(comps, "rid").groupBy("token").agg(F.count_distinct("comp").alias("n")).where(F.col("n") >= frequent)
    most = scratch.table(found.orderBy(F.desc("n"), "token").limit(MOST_FREQUENT).select("token"), "near-late")
    return np.sort(most.toArrow().column(0).to_numpy().view(np.uint64))


def _meeting(texts: DataFrame, comps: DataFrame, shingle: int, similarity: float, sampled: int = SAMPLED, frequent: int = FREQUENT) -> DataFrame:
    """All pairs ``(a, b)`` of the texts ``rid, text`` in different components ``rid, comp`` that may have this similarity:
    ``MEET`` of their first shingles are the same (or as many as must be), and what follows there is long enough in both for
    the shared ones needed.  A shingle within one component is left out, however often it stands there; the others tell
    which components meet (:func:`_met`), and the texts of these are compared by their first shingles."""
    tokens = _first(texts, shingle, similarity, _late(texts, comps, shingle, sampled, frequent)).repartition("token")
    several = tokens.groupBy("token").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("token")
    shared = scratch.table(tokens.join(several, "token").join(comps, "rid"), "near-shared").select("token", "rid", "size", "place", "comp")
    mixed = shared.groupBy("token").agg(F.min("comp").alias("x"), F.max("comp").alias("y")).where("x < y").select("token")
    shared = scratch.table(shared.join(mixed, "token"), "near-mixed")
    groups = shared.groupBy("token", "comp").agg(F.min("size").alias("least"), F.max("size").alias("most"))
    met = scratch.table(_met(groups, similarity).distinct(), "near-met")
    items = F.array_sort(F.collect_list(F.struct("place", "token")))
    kept = scratch.table(shared.groupBy("comp", "rid", "size").agg(items.alias("items")), "near-first")
    sides = [kept.select(*[F.col(n).alias(f"{c}_{n}") for n in ("comp", "rid", "size", "items")]) for c in "ab"]
    needed = _needed("a_size", "b_size", similarity)
    early = lambda c: F.transform(F.filter(f"{c}_items", lambda x: F.col(f"{c}_size") - x["place"] >= needed - (MEET - 1)), lambda x: x["token"])
    n = F.size(F.array_intersect(early("a"), early("b")))
    far = F.least("a_size", "b_size") < needed  # too unlike in size
    # some pairs at a time, about as many as there are texts, as the texts' first shingles are shuffled along with each
    parts, found = max(1, -(-met.count() // max(1, kept.count()))), []
    for i in range(parts):
        some = met.where(F.pmod(F.xxhash64("a_comp", "b_comp"), F.lit(parts)) == i)
        pairs = some.join(sides[0], "a_comp").join(sides[1], "b_comp").where(~far & (n >= F.least(F.lit(MEET), F.greatest(needed, F.lit(1)))))
        found.append(scratch.table(pairs.select(F.least("a_rid", "b_rid").alias("a"), F.greatest("a_rid", "b_rid").alias("b")), "near-pairs"))
    return reduce(DataFrame.unionByName, found)


def _needed(a: str, b: str, similarity: float) -> Column:
    """Shared shingles that sets of these sizes need."""
    return (F.col(a) + F.col(b)) * F.lit(similarity / (1 + similarity)) - 1e-6


def _met(groups: DataFrame, similarity: float = 0.0) -> DataFrame:
    """Pairs ``(a_comp, b_comp)`` with a common ``token`` in ``token, comp``: the first that two have in common gives their
    pair, and a later one does only if there is none among the ``BEFORE`` that either has just before it.  With a similarity,
    components all of whose sizes (``least`` to ``most``) are too unlike give none."""
    groups = groups if similarity else groups.withColumns({"least": F.lit(0), "most": F.lit(0)})
    before, every = Window.partitionBy("comp").orderBy("token").rowsBetween(-BEFORE, -1), Window.partitionBy("comp")
    sized = groups.select("token", "comp", F.collect_list("token").over(before).alias("before"), F.min("least").over(every).alias("least"), F.max("most").over(every).alias("most"))
    known = scratch.table(sized, "near-groups")
    a, b = (known.select("token", *[F.col(n).alias(f"{c}_{n}") for n in ("comp", "before", "least", "most")]) for c in "ab")
    like = (F.col("a_most") >= _needed("a_most", "b_least", similarity)) & (F.col("b_most") >= _needed("b_most", "a_least", similarity))
    return a.join(b, (a["token"] == b["token"]) & (F.col("a_comp") < F.col("b_comp")) & like & ~F.arrays_overlap("a_before", "b_before")).select("a_comp", "b_comp")


def _axes_of(words: np.ndarray) -> np.ndarray:
    """Unary segment counts of 64-bit words."""
    lower, one = np.uint64(0x5555555555555555), np.uint64(1)
    return ((words | words >> one) & lower) | ((words & words >> one & lower) << one)


def _verified(pairs: DataFrame, texts: DataFrame, shingle: int, similarity: float) -> DataFrame:
    """Those of the pairs ``a, b`` whose texts' distinct shingles have this Jaccard similarity or more."""

    def verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in scratch.small_batches(batches):
            keep, sets = [], {}  # each text of a batch is hashed once
            for i, j, x, y in zip(*(b.column(c) for c in range(4)), strict=True):
                i, j = i.as_py(), j.as_py()
                for k, t in ((i, x), (j, y)):
                    if k not in sets:
                        sets[k] = np.sort(shingle_hashes(t.as_py(), shingle))
                x, y = sets[i], sets[j]
                both = int(_among(x, y).sum())
                keep.append(both >= similarity * (len(x) + len(y) - both))
            yield b.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    sides = [texts.select(F.col("rid").alias(c), F.col("text").alias(f"{c}_text")) for c in "ab"]
    return pairs.select("a", "b").join(sides[0], "a").join(sides[1], "b").select("a", "b", "a_text", "b_text").mapInArrow(verified, "a long, b long")


def similar_classes(texts: DataFrame, shingle: int = 5, similarity: float = 0.8, window: int = WINDOW, **order: int) -> DataFrame:
    """``node, component`` of the rows ``rid, text`` that pairs of the similarity connect, none being lost.

    First, for ``NEAR_ROUNDS`` rounds, each fingerprint is held against its nearest one outside its component alone, in a
    few grids.  This joins most of a group of any size by some comparisons a text instead of pairs by the square.  Then
    all pairs that meet between what is still apart are verified (:func:`_meeting`, which ``order`` goes to)."""
    nodes, copies = _nodes(texts, shingle)
    radius, links = bits_within(similarity), scratch.table(copies, "near-links")
    now = nodes.withColumn("comp", F.col("rid"))
    for r in range(NEAR_ROUNDS):
        pairs = _neighbours(now, range(r * NEAR_GRIDS, (r + 1) * NEAR_GRIDS), radius, window)
        links = links.unionByName(scratch.table(_verified(scratch.table(pairs, "near-pairs"), texts, shingle, similarity), "near-links"))
        found = components(links.toDF("u", "v")).withColumnRenamed("node", "rid")
        now = scratch.table(nodes.join(found, "rid", "left").select("rid", "fp", F.coalesce("component", "rid").alias("comp")), "near-nodes")
    with scratch.step(texts.sparkSession, "meeting") as path:
        found = _meeting(texts, now.select("rid", "comp"), shingle, similarity, **order)
    rest = scratch.table(found, "near-pairs")
    scratch.drop(texts.sparkSession, path)
    return components(links.unionByName(scratch.table(_verified(rest, texts, shingle, similarity), "near-links")).toDF("u", "v"))


def drop_similar_copies(docs: DataFrame, shingle: int = 5, similarity: float = 0.8, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of ``docs`` that stay: of rows that verified pairs connect the one with the smallest id (none is largest)."""
    mark = "__sedgeline_rid"
    rows = scratch.numbered(docs, mark, "near-rows")
    found = similar_classes(rows.select(F.col(mark).alias("rid"), F.col(text_col).alias("text")), shingle, similarity, **options)
    named = found.join(rows.select(F.col(mark).alias("node"), F.col(id_col).alias("id"), F.sha2(F.coalesce(F.col(text_col), F.lit("")), 256).alias("h")), "node")
    stays = named.groupBy("component").agg(F.min(F.struct(F.col("id").isNull(), "id", "h", "node")).getField("node").alias("stays"))
    gone = named.join(stays, "component").where("node <> stays").select(F.col("node").alias(mark))
    return rows.join(gone, mark, "left_anti").select(*docs.columns)

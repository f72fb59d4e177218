"""Vector codes by product quantisation: each vector is cut into parts, each part coded by its codebook's nearest entry.

The nearest entry is found by branch and bound in a ball tree over the entries of a part position: a ball has an integer
centre and a radius that is rounded up, a part's distance from the centre is rounded down, and a ball is visited unless
their difference surely exceeds the best distance so far (equal ones are visited, as ties go to the lower index).  What
is visited is measured in exact integers.  A whole batch descends at once: each ball gets the rows that still need it.

Codebooks have ``entries`` entries for each part position, so what tasks hold and the driver gets for a round (sums by
part, entry and component) does not grow with the table.

Defined results: vectors that are null or hold null or non-finite components are left out, and so are those that aren't
of the most frequent length that can be cut into equal parts (of equally frequent ones the longer).  Null ids come last
when entries are chosen, rows of equal ids in the order of their vectors; fewer vectors than entries give fewer entries.
Rows that repeat are coded each.  Components beyond a long count as the nearest long, errors beyond it as the largest.
An empty table gives an empty table.  Other columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sedgeline.llm import scratch
from sedgeline.llm.vectors import LONGEST, Sums, exact, finite, integers, long_of, matrix, moved, pair, summed, with_totals

SCALE, PARTS, ENTRIES, ROUNDS, LEAF = 4096, 8, 16, 6, 2
CODES = "vec_id long, label string, code string, error long"


@dataclass
class Ball:
    """Entries within ``radius`` of ``centre``; a leaf has no parts."""

    members: np.ndarray
    centre: np.ndarray
    radius: int
    parts: tuple[Ball, Ball] | None


def _squares(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    a, b = pair(a, b)
    d = a - b
    return (d * d).sum(axis=-1)


def _root_down(squares: np.ndarray) -> np.ndarray:
    """Integers that are at most the squares' roots."""
    if squares.dtype == object:
        return np.array([math.isqrt(int(x)) for x in squares], dtype=object)
    return np.maximum(np.sqrt(squares.astype(np.float64)).astype(np.int64) - 1, 0)


def ball_tree(entries: np.ndarray, members: np.ndarray | None = None) -> Ball:
    """A ball over entries, split between the two that lie far apart until few are left."""
    members = np.arange(len(entries)) if members is None else members
    own = entries[members].astype(object)
    centre = exact(np.array([sum(c) // len(own) for c in own.T], dtype=object)[None, :])[0]
    radius = math.isqrt(max(int(x) for x in _squares(own, centre.astype(object)))) + 1
    if len(members) <= LEAF:
        return Ball(members, centre, radius, None)
    one = own[np.argmax(_squares(own, own[0]))]
    other = own[np.argmax(_squares(own, one))]
    near = (_squares(own, one) <= _squares(own, other)).astype(bool)
    if near.all():  # equal entries
        near[len(members) // 2 :] = False
    return Ball(members, centre, radius, (ball_tree(entries, members[near]), ball_tree(entries, members[~near])))


def nearest(tree: Ball, entries: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index and squared distance of each row's nearest entry; of equal distances the lowest index."""
    values, entries = pair(values, entries)
    n = len(values)
    best, at = np.full(n, -1, dtype=values.dtype), np.full(n, len(entries), dtype=np.int64)

    def visit(ball: Ball, rows: np.ndarray, lower: np.ndarray) -> None:
        rows = rows[(best[rows] < 0) | (lower * lower <= best[rows])]
        if not len(rows):
            return
        if ball.parts is None:
            for m in ball.members:
                d = _squares(values[rows], entries[m])
                better = ((best[rows] < 0) | (d < best[rows]) | ((d == best[rows]) & (m < at[rows]))).astype(bool)
                best[rows[better]], at[rows[better]] = d[better], m
            return
        low = [np.maximum(_root_down(_squares(values[rows], p.centre)) - p.radius, 0) for p in ball.parts]
        first = (_squares(values[rows], ball.parts[0].centre) <= _squares(values[rows], ball.parts[1].centre)).astype(bool)
        for mine, order in ((first, (0, 1)), (~first, (1, 0))):
            for k in order:
                visit(ball.parts[k], rows[mine], low[k][mine])

    visit(tree, np.arange(n), np.zeros(n, dtype=values.dtype))
    return at, best


class Codebooks:
    """The codebooks of all part positions with their trees."""

    def __init__(self, books: list[np.ndarray]) -> None:
        self.books, self.width = books, books[0].shape[1]
        self.trees = [ball_tree(b) for b in books]

    def assign(self, vectors: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
        """By part position: the parts, their entries and squared distances."""
        for p, (book, tree) in enumerate(zip(self.books, self.trees, strict=True)):
            values = exact(vectors[:, p * self.width : (p + 1) * self.width])
            yield p, values, *nearest(tree, book, values)

    def sha256(self) -> str:
        return hashlib.sha256(",".join(str(int(x)) for b in self.books for x in b.ravel()).encode()).hexdigest()


def _sums(books: Codebooks, dims: int):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        entries = len(books.books[0])
        sums = Sums(len(books.books) * entries, books.width)
        for b in batches:
            if b.num_rows:
                for p, values, at, _ in books.assign(matrix(b.column("v"), dims)):
                    sums.add(p * entries + at, values)
        yield sums.batch()

    return work


def _codes(books: Codebooks, dims: int):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            found = [(at, d) for _, _, at, d in books.assign(matrix(b.column("v"), dims))]
            code = ["".join(f"{x:02x}" for x in row) for row in zip(*[at.tolist() for at, _ in found], strict=True)]
            error = [min(sum(map(int, row)), LONGEST) for row in zip(*[d.tolist() for _, d in found], strict=True)]
            yield pa.RecordBatch.from_arrays([b.column("vec_id"), b.column("label"), pa.array(code, pa.string()), pa.array(error, pa.int64())], names=["vec_id", "label", "code", "error"])

    return work


def kept_vectors(table: DataFrame, parts: int, scale: int, id_col: str, vec_col: str, label_col: str) -> tuple[DataFrame, int]:
    """Usable vectors as integers, written once (``vec_id, label, v``), and their length, 0 if there are none."""
    vec = F.col(vec_col).cast("array<double>")
    rows = table.select(F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).cast("string").alias("label"), vec.alias("x")).where(finite(F.col("x")) & (F.size("x") > 0) & (F.size("x") % parts == 0))
    rows = scratch.table(rows.select("vec_id", "label", integers(F.col("x"), scale).alias("v")), "vectors")
    lengths = rows.groupBy(F.size("v").alias("dims")).agg(F.count(F.lit(1)).alias("n"))
    most = lengths.orderBy(F.desc("n"), F.desc("dims")).first()
    return (rows.where(F.size("v") == most.dims), most.dims) if most else (rows, 0)


def codebooks(rows: DataFrame, dims: int, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> Codebooks:
    """Codebooks that start as the vectors of the smallest ids and move ``rounds`` times; a scan of the vectors each."""
    start = np.array([r.v for r in rows.orderBy(F.asc_nulls_last("vec_id"), "v").limit(entries).select("v").collect()], dtype=object)
    width = dims // parts
    books = Codebooks([exact(start[:, p * width : (p + 1) * width]) for p in range(parts)])
    for _ in range(rounds):
        sums, k = summed(rows, _sums(books, dims)), len(start)
        books = Codebooks([moved(b, {(g - p * k, d): x for (g, d), x in sums.items() if g // k == p}) for p, b in enumerate(books.books)])
    return books


def coded_vectors(
    table: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label"
) -> DataFrame:
    """One row per usable vector: ``vec_id, code, error, label_error, codebooks_sha256``."""
    if entries > 256:
        raise ValueError("a code has two hex digits for a part, so a codebook has at most 256 entries")
    rows, dims = kept_vectors(table, parts, scale, id_col, vec_col, label_col)
    if not dims:
        return rows.select("vec_id", F.lit("").alias("code"), F.lit(0).cast("long").alias("error"), F.lit(0).cast("long").alias("label_error"), F.lit("").alias("codebooks_sha256"))
    books = codebooks(rows, dims, parts, entries, rounds)
    coded = scratch.table(rows.mapInArrow(_codes(books, dims), CODES), "codes")
    totals = coded.groupBy("label").agg(long_of(F.sum(F.col("error").cast("decimal(38,0)"))).alias("label_error"), F.count(F.lit(1)).alias("n"))
    joined = with_totals(coded, scratch.table(totals, "label-errors"), "label", "n")
    return joined.select("vec_id", "code", "error", "label_error", F.lit(books.sha256()).alias("codebooks_sha256"))

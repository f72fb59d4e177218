"""Clustering around centroids with partial-distance search.

Vectors become integers.  A vector's squared distances grow dimension by dimension, those of the highest variance first,
in steps of ``STEP`` dimensions; a centroid is given up as soon as its sum is strictly above the best whole distance so
far, and only survivors go through all dimensions.  The first candidate is the centroid that is nearest in the first
step.  Equal distances are never given up, so ties go to the smaller number; all sums are exact integers.

Centroids, variances and sums of a round are as large as centroids x dimensions, whatever the table.

Defined results: vectors that are null, not of exactly ``dims`` components, or hold null or non-finite ones are left out.
Null ids come last when centroids are chosen, rows of equal ids in the order of their vectors; fewer vectors than
centroids give fewer centroids.  Rows that repeat are clustered each.  Components beyond a long count as the nearest
long, distances and sums beyond it as the largest.  An empty table gives an empty table.  Other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sedgeline.llm import scratch
from sedgeline.llm.vectors import LONGEST, Sums, exact, finite, integers, matrix, moved, pair, summed

SCALE, DIMS, CENTROIDS, ROUNDS, SEED, STEP = 64, 64, 16, 3, 1, 8


def kept_vectors(table: DataFrame, dims: int = DIMS, scale: int = SCALE, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """Usable vectors as integers, written once: ``vec_id, v``."""
    rows = table.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vec_col).cast("array<double>").alias("x")).where(finite(F.col("x")) & (F.size("x") == dims))
    return scratch.table(rows.select("vec_id", integers(F.col("x"), scale).alias("v")), "vectors")


def first_centroids(rows: DataFrame, count: int = CENTROIDS, seed: int = SEED) -> np.ndarray:
    """The vectors of the ids with the smallest hashes, in their order."""
    hashed = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    found = rows.select(hashed.alias("h"), "v").orderBy(F.asc_nulls_last("h"), "v").limit(count).collect()
    return exact(np.array([r.v for r in found], dtype=object))


def by_variance(rows: DataFrame, dims: int) -> np.ndarray:
    """Dimensions, those of the highest variance first.  The order only steers how soon centroids are given up."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = Sums(2, dims)
        for b in batches:
            if b.num_rows:
                values = matrix(b.column("v"), dims)
                for group, x in enumerate((values, values * values)):
                    # squares are only compared, so those that could be too large for a sum are cut
                    sums.add(np.full(len(x), group), np.minimum(x, 2**44).astype(np.int64) if group else x)
        yield sums.batch()

    sums = summed(rows, work)
    spread = [sums[1, d][0] * sums[1, d][1] - sums[0, d][0] ** 2 for d in range(dims)]
    return np.array(sorted(range(dims), key=lambda d: (-spread[d], d)))


def nearest(values: np.ndarray, centroids: np.ndarray, order: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Number and squared distance of each row's nearest centroid; of equal distances the smallest number."""
    values, centroids = pair(values[:, order], centroids[:, order])

    def squares(rows: np.ndarray | slice, k: int, step: int) -> np.ndarray:
        d = values[rows, step : step + STEP] - centroids[k, step : step + STEP]
        return (d * d).sum(axis=1)

    n, dims = values.shape
    begun = np.stack([squares(slice(None), k, 0) for k in range(len(centroids))], axis=1)
    guess = begun.argmin(axis=1)
    best = begun[np.arange(n), guess].copy()
    for k in np.unique(guess):
        rows = np.flatnonzero(guess == k)
        for step in range(STEP, dims, STEP):
            best[rows] += squares(rows, k, step)
    at = guess.astype(np.int64)
    for k in range(len(centroids)):
        rows = np.flatnonzero((guess != k) & (begun[:, k] <= best))
        sums = begun[rows, k]
        for step in range(STEP, dims, STEP):
            if not len(rows):
                break
            sums = sums + squares(rows, k, step)
            alive = (sums <= best[rows]).astype(bool)
            rows, sums = rows[alive], sums[alive]
        better = ((sums < best[rows]) | (k < at[rows])).astype(bool)  # those left are nearer or as near
        best[rows[better]], at[rows[better]] = sums[better], k
    return at, best


def _sums(centroids: np.ndarray, order: np.ndarray):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = Sums(*centroids.shape)
        for b in batches:
            if b.num_rows:
                values = matrix(b.column("v"), centroids.shape[1])
                sums.add(nearest(values, centroids, order)[0], values)
        yield sums.batch()

    return work


def _assigned(centroids: np.ndarray, order: np.ndarray):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                at, d = nearest(matrix(b.column("v"), centroids.shape[1]), centroids, order)
                distance = pa.array([min(int(x), LONGEST) for x in d], pa.int64())
                yield pa.RecordBatch.from_arrays([b.column("vec_id"), pa.array(at, pa.int32()), distance], names=["vec_id", "cluster", "distance"])

    return work


def clustered_vectors(
    table: DataFrame, count: int = CENTROIDS, rounds: int = ROUNDS, dims: int = DIMS, scale: int = SCALE, seed: int = SEED, id_col: str = "vec_id", vec_col: str = "embedding"
) -> DataFrame:
    """One row per usable vector: ``vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256``."""
    rows = kept_vectors(table, dims, scale, id_col, vec_col)
    centroids = first_centroids(rows, count, seed)
    if not len(centroids):
        zero = F.lit(0).cast("long")
        return rows.select("vec_id", F.lit(0).alias("cluster"), zero.alias("distance"), zero.alias("cluster_inertia"), zero.alias("inertia"), F.lit("").alias("centroid_sha256"))
    order = by_variance(rows, dims)
    for _ in range(rounds):
        centroids = moved(centroids, summed(rows, _sums(centroids, order)))
    found = scratch.table(rows.mapInArrow(_assigned(centroids, order), "vec_id long, cluster int, distance long"), "clusters")
    total = lambda c: F.sum(F.col(c).cast("decimal(38,0)"))
    sums = {r.cluster: r.d for r in found.groupBy("cluster").agg(total("distance").alias("d")).collect()}  # a row for each centroid
    names = [hashlib.sha256(",".join(str(int(x)) for x in c).encode()).hexdigest() for c in centroids]
    told = [(k, min(int(d), LONGEST), names[k]) for k, d in sums.items()]
    clusters = table.sparkSession.createDataFrame(told, "cluster int, cluster_inertia long, centroid_sha256 string")
    inertia = min(int(sum(sums.values())), LONGEST)
    return found.join(F.broadcast(clusters), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", F.lit(inertia).cast("long").alias("inertia"), "centroid_sha256")

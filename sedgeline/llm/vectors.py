"""Integer vectors, their sums by group, and joins with totals by key: what the operators on embeddings share.

A component becomes ``floor(scale * x)`` with ``x`` as double; what no long holds becomes the nearest long.  Distances
are exact: in 64 bits where no square can overflow, else in Python's integers.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

HEAVY = 512
LONGEST = 2**63 - 1


def finite(vec: Column) -> Column:
    """Whether a vector is there and all its components are finite numbers."""
    usable = F.forall(vec, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.coalesce(vec.isNotNull() & usable, F.lit(False))


def integers(vec: Column, scale: int) -> Column:
    """``floor(scale * x)`` of each component."""
    return F.transform(vec, lambda x: F.floor(x * F.lit(float(scale))).cast("long"))


def matrix(column: pa.Array, dims: int) -> np.ndarray:
    """Rows of a list column, all of ``dims`` longs.  Python's integers where squared distances could pass 64 bits."""
    flat = column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)
    return exact(flat)


def exact(values: np.ndarray) -> np.ndarray:
    """The integers in 64 bits if any two rows' squared distance, and its sums of a batch, surely fit; else as objects."""
    most = max(abs(int(values.max(initial=0))), abs(int(values.min(initial=0))))
    return values.astype(np.int64) if (2 * most) ** 2 * max(1, values.shape[-1]) < 2**60 else values.astype(object)


def pair(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Both in Python's integers if either is."""
    return (a.astype(object), b.astype(object)) if object in (a.dtype, b.dtype) else (a, b)


class Sums:
    """Exact sums of vectors by group, in Python's integers: as large as groups x dimensions, whatever the rows."""

    def __init__(self, groups: int, dims: int) -> None:
        self.sums, self.counts = np.zeros((groups, dims), dtype=object), np.zeros(groups, dtype=np.int64)

    def add(self, group: np.ndarray, values: np.ndarray) -> None:
        part = np.zeros(self.sums.shape, dtype=values.dtype)
        np.add.at(part, group, values)
        self.sums += part.astype(object)
        self.counts += np.bincount(group, minlength=len(self.counts))

    def batch(self) -> pa.RecordBatch:
        """``grp, dim, total, n`` of groups with rows."""
        groups = np.flatnonzero(self.counts)
        dims = self.sums.shape[1]
        total = pa.array([Decimal(int(x)) for x in self.sums[groups].ravel()], pa.decimal128(38, 0))
        columns = [pa.array(np.repeat(groups, dims), pa.int64()), pa.array(np.tile(np.arange(dims), len(groups)), pa.int64()), total, pa.array(np.repeat(self.counts[groups], dims), pa.int64())]
        return pa.RecordBatch.from_arrays(columns, names=["grp", "dim", "total", "n"])


SUMS = "grp long, dim long, total decimal(38,0), n long"


def summed(rows: DataFrame, work: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> dict[tuple[int, int], tuple[int, int]]:
    """Sums over all tasks of what ``work`` makes of its rows, as ``SUMS``: by group and dimension, total and count.
    The driver gets a row for each group and dimension."""
    found = rows.mapInArrow(work, SUMS).groupBy("grp", "dim").agg(F.sum("total").alias("total"), F.sum("n").alias("n"))
    return {(r.grp, r.dim): (int(r.total), r.n) for r in found.collect()}


def moved(centres: np.ndarray, sums: dict[tuple[int, int], tuple[int, int]]) -> np.ndarray:
    """Each centre at the componentwise ``floor(sum / count)`` of its rows; those without rows stay."""
    out = centres.astype(object)
    for (group, dim), (total, n) in sums.items():
        out[group, dim] = total // n
    return exact(out)


def long_of(total: Column) -> Column:
    """A sum of decimals as a long; beyond the largest long, that."""
    return F.least(total, F.lit(LONGEST).cast("decimal(38,0)")).cast("long")


def with_totals(rows: DataFrame, totals: DataFrame, key: str, count: str) -> DataFrame:
    """``rows`` with the other columns of ``totals`` of the same key, null being a key.

    Keys with over a ``HEAVY``-th of all rows, so fewer than ``HEAVY`` of them, are broadcast and their rows don't move;
    the others' rows are joined by a shuffle in which no key has more than that share."""
    every = totals.agg(F.sum(count)).first()[0] or 0
    totals = totals.withColumnRenamed(key, "__key")
    heavy = totals.where(F.col(count) * HEAVY > F.lit(every))
    light = totals.where(F.col(count) * HEAVY <= F.lit(every))
    same = F.col(key).eqNullSafe(F.col("__key"))
    first = rows.join(F.broadcast(heavy), same).drop("__key")
    rest = rows.join(F.broadcast(heavy.select("__key")), same, "left_anti").join(light.hint("merge"), same).drop("__key")
    return first.unionByName(rest)

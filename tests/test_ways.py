import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from sedgeline import scratch
from sedgeline.operators import trees

ROWS = "article_id long, block_id string, parent_id string, position int"


def ways(spark, rows):
    found = trees.with_ways(spark.createDataFrame(rows, ROWS), way=F.col("position"))
    return sorted((r.article_id, r.block_id, tuple(r.way)) for r in found.collect())


def test_trees_of_many_articles_take_one_table(spark, monkeypatch):
    made, table = [], scratch.table
    monkeypatch.setattr(scratch, "table", lambda df, label: made.append(label) or table(df, label))
    rows, told = [], []
    for a in [None, *range(300)]:
        for i in range(1 + (a or 7) % 9):  # a chain, a leaf on each of its rows, and an orphan with a row below
            rows += [(a, f"{a}/{i}", f"{a}/{i - 1}" if i else None, i), (a, f"{a}/{i}x", f"{a}/{i}", 50)]
            told += [(a, f"{a}/{i}", tuple(range(i + 1))), (a, f"{a}/{i}x", (*range(i + 1), 50))]
        rows += [(a, f"{a}/lost", "gone", 0), (a, f"{a}/below", f"{a}/lost", 0)]
    found = trees.with_ways(spark.createDataFrame(rows, ROWS).orderBy(F.desc("block_id")), way=F.col("position"))
    assert {(r.article_id, r.block_id, tuple(r.way)) for r in found.collect()} == set(told) and found.count() == len(told)
    assert made == ["tree"]


def test_parents_in_another_article_and_ids_twice_are_as_by_joins(spark):
    assert ways(spark, [(1, "a", None, 3), (2, "b", "a", 4), (2, "c", "b", 5)]) == [(1, "a", (3,)), (2, "b", (3, 4)), (2, "c", (3, 4, 5))]
    assert len(ways(spark, [(1, "a", None, 3), (1, "b", "a", 4), (1, "b", "a", 5)])) == 5  # each of both rows with each way
    with pytest.raises(ValueError):
        ways(spark, [(1, "a", None, 3), (1, "b", "c", 4), (1, "c", "b", 5)])


def test_articles_are_whole_wherever_batches_end():
    column = pa.array([None, None, 1, 1, 1, 1, 2, 3, 3])
    for size in range(1, 10):
        batches = [pa.RecordBatch.from_arrays([column.slice(i, size)], names=["article_id"]) for i in range(0, 9, size)]
        tables = [t["article_id"].to_pylist() for t in trees._whole_articles(iter(batches))]
        assert [x for t in tables for x in t] == column.to_pylist()
        assert np.all([set(a).isdisjoint(b) for i, a in enumerate(tables) for b in tables[:i]])

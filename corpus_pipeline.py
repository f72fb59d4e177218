"""The corpus pipeline: quality rules, exact dedup, SimHash near-dedup, mixing to target weights, packing.

Each stage takes ``(spark, docs, sf_dir)`` and works on all that the one before kept, row by row: ids may be missing or
repeated.  All but the last return the
columns of ``documents``.  Between stages the rows are written as Parquet to the shared scratch folder and read again.
As a stage begins, the scratch tables of those before it are deleted, but for any that its own ``docs`` still read, and the
session's ``BATCH`` is set.
"""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from sedgeline.llm import scratch
from sedgeline.llm.exact_dedup import drop_exact_copies
from sedgeline.llm.mixing import mixed_documents
from sedgeline.llm.packing import packed_pieces
from sedgeline.llm.quality import keep_quality
from sedgeline.llm.queries import BYTE_BPE, tokenizer
from sedgeline.llm.simhash import drop_similar_copies

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
SHINGLE, SIMILARITY = 5, 0.8
#: What goes to a Python worker at once, at most: a batch of texts, or of pairs of these, is held by the JVM and by the worker.
BATCH = {"spark.sql.execution.arrow.maxRecordsPerBatch": "1000", "spark.sql.execution.arrow.maxBytesPerBatch": "8m"}


_done: list[tuple[str, str]] = []  # application and folder of stages whose scratch tables are still there


def _stage(stage: Stage) -> Stage:
    """The stage, with scratch tables of its own that go when a later one begins."""

    @functools.wraps(stage)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        for name, most in BATCH.items():
            spark.conf.set(name, most)
        app = spark.sparkContext.applicationId
        _done[:] = [(a, path) for a, path in _done if a == app and not scratch.drop(spark, path, docs)]
        with scratch.step(spark, stage.__name__) as path:
            _done.append((app, path))
            return stage(spark, docs, sf_dir)

    return run_stage


@_stage
def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go."""
    return keep_quality(docs.select(*COLUMNS), spark.read.parquet(f"{sf_dir}/labels.parquet"))


@_stage
def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents with equal texts the one with the largest id stays."""
    return drop_exact_copies(docs.select(*COLUMNS))


@_stage
def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents that near copies connect (``SHINGLE`` words, ``SIMILARITY`` or more) the one with the smallest id stays."""
    return drop_similar_copies(docs.select(*COLUMNS), SHINGLE, SIMILARITY)


@_stage
def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What the mix takes, piece by piece; a piece has its document's id, language and source."""
    return mixed_documents(docs.select(*COLUMNS))


@_stage
def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packed sequences of token ids: the pieces of a ``sequence_id`` in the order of ``offset``."""
    return packed_pieces(docs, tokenizer(BYTE_BPE))


STAGES: list[tuple[str, Stage]] = [
    ("quality_rules", quality),
    ("exact_dedup", exact),
    ("simhash", near),
    ("mixing", mixing),
    ("packing", packing),
]

#: SQL can express neither the labelling nor the fingerprints, permutations and token ids.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, one after the other, from ``documents``."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES[:-1]:
        with scratch.step(spark, "between") as path:
            rows = stage(spark, docs, sf_dir)
            docs = scratch.table(rows, name)
        if before:
            scratch.drop(spark, before)
        before = path
    return STAGES[-1][1](spark, docs, sf_dir)

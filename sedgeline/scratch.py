"""Shared scratch space: tables that cut lineage and survive lost executors.

Everything goes below the folder the cluster names in ``spark.checkpoint.dir``.  Only where that setting is absent and
the master is local (tests, a laptop) a temporary folder of this machine is used; on a cluster its absence is an error,
as no machine's own folder is seen by the others.
"""

from __future__ import annotations

import functools
import tempfile
import threading
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_now = threading.local()


@functools.cache
def _own_folder(app_id: str) -> str:
    return "file://" + tempfile.mkdtemp(prefix="sedgeline-")


def root(spark: SparkSession) -> str:
    """Folder of this application below ``spark.checkpoint.dir``."""
    app, base = spark.sparkContext.applicationId, spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all machines share")
        base = _own_folder(app)
    return f"{base.rstrip('/')}/sedgeline/{app}"


def new_path(spark: SparkSession, label: str) -> str:
    """A path that no other call gets."""
    return f"{root(spark)}/{getattr(_now, 'step', '')}{label}-{uuid.uuid4().hex}"


@contextmanager
def step(spark: SparkSession, name: str) -> Iterator[str]:
    """What is written within goes below a folder of its own, whose path this gives: see :func:`drop`."""
    before = getattr(_now, "step", "")
    _now.step = f"{before}{name}-{uuid.uuid4().hex}/"
    try:
        yield f"{root(spark)}/{_now.step}"
    finally:
        _now.step = before


def drop(spark: SparkSession, path: str, needed: DataFrame | None = None) -> bool:
    """Delete a folder of scratch tables, unless ``needed`` reads files in it."""
    if needed is not None and any(f.startswith(path) or path.removeprefix("file://") in f for f in needed.inputFiles()):
        return False
    _delete(spark, path)
    return True


def _delete(spark: SparkSession, uri: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(uri)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


@contextmanager
def _shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """The shuffle files of each query go as it ends, not when the driver happens to collect its plan."""
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(CLEANUP, before) if before else spark.conf.unset(CLEANUP)


def table(df: DataFrame, label: str) -> DataFrame:
    """``df`` written as Parquet and read back: computed once, whatever executors are lost later.  Its shuffle files go at
    once, as nothing reads them again."""
    spark, path = df.sparkSession, new_path(df.sparkSession, label)
    with _shuffles_removed(spark):
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def release(spark: SparkSession) -> None:
    """Delete this application's scratch files.  Call it when all results have been written."""
    _delete(spark, root(spark))

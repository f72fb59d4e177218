"""Files and row ids of this subpackage on the shared scratch space (see ``sedgeline.scratch``)."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sedgeline.scratch import drop, new_path, release, root, step, table

__all__ = ["drop", "file_count", "get", "new_path", "numbered", "opened", "put", "release", "root", "small_batches", "spread", "step", "table", "writing"]

MOST_TASKS = 20_000  # among which a list of files is dealt
BATCH_CHARS = 8 << 20


def numbered(docs: DataFrame, mark: str, label: str) -> DataFrame:
    """``docs`` with a number for each row in column ``mark``, written once, so that every later read sees the same."""
    return table(docs.withColumn(mark, F.monotonically_increasing_id()), label)


def file_count(files: DataFrame) -> int:
    """Tasks for a list of files: one for each, up to ``MOST_TASKS``."""
    return max(1, min(files.count(), MOST_TASKS))


def spread(files: DataFrame, name: str, tasks: int) -> DataFrame:
    """A list of files in ``tasks`` partitions of about the same number.  An explicit number is not coalesced again."""
    return files.repartitionByRange(tasks, name)


@contextmanager
def writing(uri: str) -> Iterator[pa.NativeFile]:
    """A file to write from a task, whole or not at all: a private name is renamed at the end."""
    fs, path = _filesystem(uri)
    fs.create_dir(path.rpartition("/")[0], recursive=True)
    own = f"{path}.{uuid.uuid4().hex}.part"
    with fs.open_output_stream(own) as out:
        yield out
    fs.move(own, path)


def put(uri: str, data: bytes) -> None:
    """Write a file from a task.  A retried task replaces it whole."""
    with writing(uri) as out:
        out.write(data)


def opened(uri: str) -> pa.NativeFile:
    """A file to read from start to end."""
    fs, path = _filesystem(uri)
    return fs.open_input_stream(path, compression=None)


def get(uri: str, start: int = 0, length: int | None = None) -> bytes:
    """Read a file, or ``length`` bytes of it from ``start``."""
    fs, path = _filesystem(uri)
    with fs.open_input_file(path) as f:
        if start:
            f.seek(start)
        return f.read() if length is None else f.read(length)


def _filesystem(uri: str) -> tuple[pafs.FileSystem, str]:
    if "://" not in uri:
        uri = "file://" + (uri[5:] if uri.startswith("file:") else uri)
    return pafs.FileSystem.from_uri(uri)


def small_batches(batches: Iterator[pa.RecordBatch], rows: int = 512, size: int = BATCH_CHARS) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of at most ``rows`` and about ``size`` bytes (one row at least), so that what a task
    makes of a batch of long texts stays small."""
    for b in batches:
        step = max(1, min(rows, rows if b.nbytes <= size else size * b.num_rows // b.nbytes))
        for i in range(0, b.num_rows, step):
            part = b.slice(i, step)
            if part.num_rows > 1 and part.nbytes > 2 * size:  # a few long texts among short ones
                yield from (part.slice(k, 1) for k in range(part.num_rows))
            else:
                yield part

"""Control plane as tables: claims, retries, run counters, scheduling, pacing and metered use."""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

DONE = ("completed", "failed", "cancelled")


def claim_order() -> list[Column]:
    return [F.desc("priority"), F.asc("run_at"), F.asc("job_id")]


def claimable(jobs: DataFrame, now: Column) -> DataFrame:
    return jobs.where((F.col("status") == "pending") & (F.col("run_at") <= now))


def claim(jobs: DataFrame, now: Column, n: int = 1) -> DataFrame:
    """The next ``n`` jobs as they are once claimed."""
    taken = claimable(jobs, now).orderBy(*claim_order()).limit(n)
    return taken.withColumn("status", F.lit("running")).withColumn("attempts", F.col("attempts") + 1)


def backoff_minutes(attempts: Column) -> Column:
    """Two to the number of earlier attempts."""
    return F.pow(F.lit(2), F.greatest(attempts - 1, F.lit(0))).cast("int")


def after_failure(jobs: DataFrame, now: Column) -> DataFrame:
    """Failed work: tried again later while attempts are left."""
    again = F.col("attempts") < F.col("max_attempts")
    return jobs.withColumn("status", F.when(again, "pending").otherwise("failed")).withColumn("run_at", F.when(again, now + F.make_dt_interval(mins=backoff_minutes(F.col("attempts")))).otherwise(F.col("run_at")))


def after_cancel(jobs: DataFrame) -> DataFrame:
    """A request to cancel: pending work ends at once, running work is asked to, ended work stays."""
    s = F.col("status")
    return jobs.withColumn("status", F.when(s == "pending", "cancelled").when(s == "running", "cancelling").otherwise(s))


def reset_orphans(jobs: DataFrame, before: Column) -> DataFrame:
    """Work that was claimed before the process started is no one's: it is due again, or failed after its last attempt."""
    lost = F.col("status").isin("running", "cancelling") & (F.col("run_at") < before)
    status = F.when(~lost, F.col("status")).when(F.col("status") == "cancelling", "cancelled").when(F.col("attempts") >= F.col("max_attempts"), "failed").otherwise("pending")
    return jobs.withColumn("status", status)


def run_status(jobs: DataFrame, runs: DataFrame | None = None) -> DataFrame:
    """Counters of each run.  Cancelled jobs count as failed; a run without jobs is completed from birth."""
    counts = jobs.where("run_id is not null").groupBy("run_id").agg(
        F.count(F.lit(1)).alias("total_jobs"), F.count_if(F.col("status") == "completed").alias("completed_jobs"), F.count_if(F.col("status").isin("failed", "cancelled")).alias("failed_jobs")
    )
    if runs is not None:
        counts = runs.select("run_id").join(counts, "run_id", "left").na.fill(0, ["total_jobs", "completed_jobs", "failed_jobs"])
    ended = F.col("completed_jobs") + F.col("failed_jobs") >= F.col("total_jobs")
    return counts.withColumn("status", F.when(~ended, "running").when(F.col("failed_jobs") > 0, "failed").otherwise("completed"))


def due_feeds(feeds: DataFrame, jobs: DataFrame, now: Column, jitter: Column | float = 1.0) -> DataFrame:
    """Enabled feeds with an interval, no job waiting or at work, and an update that is long enough ago."""
    waiting = jobs.where(F.col("status").isin("pending", "running") & (F.col("kind") == "aggregate")).select("feed_id")
    jitter = jitter if isinstance(jitter, Column) else F.lit(jitter)
    age = F.unix_timestamp(now.cast("timestamp")) - F.unix_timestamp(F.col("updated_at").cast("timestamp"))
    due = feeds.where(F.col("enabled") & (F.col("interval_minutes") > 0) & (age >= F.col("interval_minutes") * 60 * jitter))
    return due.join(waiting, "feed_id", "left_anti")


def run_limit(daily: Column, collected: Column, seconds: Column) -> Column:
    """How many articles a run may collect ``seconds`` after midnight: the day's pace, at least a small base, a fifth of
    what is left (two fifths before ten), and never more than is left."""
    left = daily - collected
    behind = F.greatest(F.ceil(daily * seconds / 86_400) - collected, F.lit(0))
    wish = F.greatest(F.greatest(F.lit(1), F.floor(daily / 48)), behind, F.floor(left * 0.2))
    wish = F.when(seconds < 36_000, F.greatest(wish, F.floor(left * 0.4))).otherwise(wish)
    return F.when(collected >= daily, F.lit(0)).otherwise(F.least(wish, left)).cast("long")


def metered(requests: DataFrame, per_day: int, per_month: int) -> DataFrame:
    """Outcome of each request in order of time: ``allowed``, or the limit that stops it, the month's first.

    Attempts that are refused don't count, so the day's limit counts allowed ones only: allowed requests of a day are
    its first ``per_day`` ones, as long as the month has any left."""
    day, month = F.date_trunc("day", "created_at"), F.date_trunc("month", "created_at")
    order = ["created_at", "request_id"]
    in_day = F.row_number().over(Window.partitionBy("user_id", day).orderBy(*order))
    ranked = requests.withColumn("in_day", in_day).withColumn("fits", (F.col("in_day") <= per_day).cast("long"))
    used = F.sum("fits").over(Window.partitionBy("user_id", month).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1))
    ranked = ranked.withColumn("used", F.coalesce(used, F.lit(0)))
    return ranked.withColumn("outcome", F.when(F.col("used") >= per_month, "month_limit").when(F.col("fits") == 0, "day_limit").otherwise("allowed")).drop("in_day", "fits", "used")


def usage(requests: DataFrame, now: Column) -> DataFrame:
    """Requests of each user in the calendar day and month of ``now`` (UTC)."""
    month = requests.where(F.date_trunc("month", "created_at") == F.date_trunc("month", now))
    return month.groupBy("user_id").agg(F.count(F.lit(1)).alias("this_month"), F.count_if(F.date_trunc("day", "created_at") == F.date_trunc("day", now)).alias("today"))


def day_start(now: Column, zone: Column) -> Column:
    """The start, in UTC, of the calendar day that it is at ``now`` (UTC) in a zone; days of a clock change have 23 or 25 hours."""
    local = F.convert_timezone(F.lit("UTC"), zone, now)
    return F.convert_timezone(zone, F.lit("UTC"), F.to_date(local).cast("timestamp_ntz"))


def seconds_of_day(now: Column, zone: Column) -> Column:
    """Seconds since the day began in a zone."""
    return F.unix_timestamp(now.cast("timestamp")) - F.unix_timestamp(day_start(now, zone).cast("timestamp"))


def collected_today(articles: DataFrame, now: Column, zones: DataFrame | None = None) -> DataFrame:
    """``feed_id, collected`` of the day of ``now``: in UTC, or in each feed's zone (``feed_id, zone``, and ``now`` may name
    a column of it); feeds without a zone are in UTC."""
    if zones is None:
        return articles.where((F.col("created_at") >= F.date_trunc("day", now).cast("timestamp_ntz")) & (F.col("created_at") <= now)).groupBy("feed_id").agg(F.count(F.lit(1)).alias("collected"))
    since = zones.select("feed_id", day_start(now, F.coalesce("zone", F.lit("UTC"))).alias("__since"), now.alias("__now"))
    joined = articles.join(since, "feed_id").where((F.col("created_at") >= F.col("__since")) & (F.col("created_at") <= F.col("__now")))
    return joined.groupBy("feed_id").agg(F.count(F.lit(1)).alias("collected"))


def changes_only(progress: DataFrame, key: str, order: str, value: str) -> DataFrame:
    """Progress rows that differ from the one before."""
    before = F.lag(value).over(Window.partitionBy(key).orderBy(order))
    return progress.withColumn("__b", before).where(~F.col("__b").eqNullSafe(F.col(value))).drop("__b")


def log_tail(lines: DataFrame, job_id: int, after_id: int) -> DataFrame:
    return lines.where((F.col("job_id") == job_id) & (F.col("id") > after_id)).orderBy("id")


def debounce(events: DataFrame, key: str, at: str, seconds: int = 120) -> DataFrame:
    """Batches opened by a key's first event and closed after a fixed time: ``key, opened, events``.

    The next event after that opens another, so batches follow from each other.  Times are sorted by key within
    partitions and streamed; what is kept is the open batch of the current key, however many events it has."""
    schema = events.select(F.col(key).alias("key"), F.col(at).cast("timestamp").alias("opened"), F.lit(1).cast("long").alias("events")).schema
    rows = events.select(F.col(key).alias("key"), F.unix_seconds(F.col(at).cast("timestamp")).alias("t")).where("t is not null")

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys: list = []
        opened: list[int] = []
        counts: list[int] = []
        for b in batches:
            if not b.num_rows:
                continue
            key_column, t = b.column(0), b.column(1).to_numpy()
            new = pa.compute.not_equal(key_column[1:], key_column[:-1]).fill_null(True).to_numpy(zero_copy_only=False)
            null = key_column.is_null().to_numpy(zero_copy_only=False)
            borders = np.flatnonzero(new & ~(null[1:] & null[:-1])) + 1
            for i, j in itertools.pairwise([0, *borders.tolist(), len(t)]):
                k = key_column[i].as_py()
                if keys and keys[-1] == k and opened:  # the open batch of the batch before
                    end = i + int(np.searchsorted(t[i:j], opened[-1] + seconds))
                    counts[-1] += end - i
                    i = end
                while i < j:
                    end = i + int(np.searchsorted(t[i:j], t[i] + seconds))
                    keys.append(k)
                    opened.append(int(t[i]))
                    counts.append(end - i)
                    i = end
            if len(keys) > 10_000:
                yield _debounced(keys[:-1], opened[:-1], counts[:-1], schema)
                keys, opened, counts = keys[-1:], opened[-1:], counts[-1:]
        if keys:
            yield _debounced(keys, opened, counts, schema)

    sorted_ = rows.repartition("key").sortWithinPartitions("key", "t")
    return sorted_.mapInArrow(fold, schema).withColumnRenamed("key", key)


def _debounced(keys: list, opened: list[int], counts: list[int], schema: StructType) -> pa.RecordBatch:
    types = to_arrow_schema(schema)
    times = pa.array([t * 1_000_000 for t in opened], pa.int64()).cast(pa.timestamp("us", "UTC"))
    return pa.RecordBatch.from_arrays([pa.array(keys, types.field(0).type), times, pa.array(counts, pa.int64())], names=["key", "opened", "events"])

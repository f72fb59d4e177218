"""Streaming queries over the event table, each with the SQL of its batch twin."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sedgeline.catalog import Catalog
from sedgeline.plans.relational import query
from sedgeline.streaming import run, state


def events(c: Catalog) -> DataFrame:
    """The event table as a stream; its times are UTC."""
    schema = c.table("events").schema
    utc = F.convert_timezone(F.lit("UTC"), F.current_timezone(), F.col("ts")).cast("timestamp")
    return run.read(c.spark, f"{c.dir}/events.parquet", schema).withColumn("ts", utc)


def _last(rows: DataFrame, key: str) -> DataFrame:
    """Of each key the row of its last micro-batch."""
    return rows.withColumn("__n", F.row_number().over(Window.partitionBy(key).orderBy(F.desc("batch_id")))).where("__n = 1").drop("__n", "batch_id")


@query("stream_usage", """
    WITH d AS (SELECT *, CASE WHEN row_number() OVER (PARTITION BY user_id, date_trunc('day', ts) ORDER BY ts, event_id) <= 2 THEN 1 ELSE 0 END AS fits FROM events),
    m AS (SELECT *, coalesce(sum(fits) OVER (PARTITION BY user_id, date_trunc('month', ts) ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS used FROM d)
    SELECT event_id AS request_id, user_id, CASE WHEN used >= 25 THEN 'month_limit' WHEN fits = 0 THEN 'day_limit' ELSE 'allowed' END AS outcome FROM m""", views=False)
def stream_usage(c: Catalog) -> DataFrame:
    stream = events(c).select("user_id", F.col("event_id").alias("request_id"), F.col("ts").alias("created_at"))
    return run.drain(state.metered(stream, 2, 25), "update").drop("batch_id")


@query("stream_job_state", """
    WITH RECURSIVE e AS (SELECT user_id AS k, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i,
            CASE event_type WHEN 'view' THEN 'claim' WHEN 'purchase' THEN 'done' WHEN 'error' THEN 'error' WHEN 'signup' THEN 'cancel' ELSE 'claim' END AS a FROM events WHERE event_type <> 'signup' OR event_id % 5 = 0),
    s AS (SELECT DISTINCT k, CAST(0 AS BIGINT) AS i, 'pending' AS status, 0 AS attempts FROM e
        UNION ALL SELECT e.k, e.i, CASE WHEN a = 'claim' AND status = 'pending' THEN 'running' WHEN status = 'cancelling' AND a IN ('done', 'error') THEN 'cancelled' WHEN status = 'running' AND a = 'done' THEN 'completed'
            WHEN status = 'running' AND a = 'error' THEN CASE WHEN attempts >= 3 THEN 'failed' ELSE 'pending' END WHEN a = 'cancel' AND status = 'pending' THEN 'cancelled' WHEN a = 'cancel' AND status = 'running' THEN 'cancelling' ELSE status END,
            CASE WHEN a = 'claim' AND status = 'pending' THEN attempts + 1 ELSE attempts END FROM s JOIN e ON e.k = s.k AND e.i = s.i + 1)
    SELECT k AS job_key, arg_max(status, i) AS status, arg_max(attempts, i) AS attempts, max(i) AS events FROM s GROUP BY k""", views=False)
def stream_job_state(c: Catalog) -> DataFrame:
    action = F.when(F.col("event_type") == "purchase", "done").when(F.col("event_type") == "error", "error").when(F.col("event_type") == "signup", "cancel").otherwise("claim")
    stream = events(c).where("event_type <> 'signup' or event_id % 5 = 0").select(F.col("user_id").alias("job_key"), "event_id", "ts", action.alias("action"))
    return _last(run.drain(state.job_states(stream), "update"), "job_key").drop("run_at")


@query("stream_debounce")
def stream_debounce(c: Catalog) -> DataFrame:
    stream = events(c).select(F.col("user_id").alias("key"), F.col("ts").alias("at"))
    return run.drain(state.debounced(stream, 86_400), "update").drop("batch_id")


@query("stream_windows", "SELECT user_id, date_trunc('day', ts) AS start, count(*) AS events FROM events GROUP BY ALL", views=False)
def stream_windows(c: Catalog) -> DataFrame:
    rows = run.drain(state.windowed(events(c), "user_id", "ts", "1 day", "2 days"), "update")
    last = rows.groupBy("user_id", "start").agg(F.max_by("events", "batch_id").alias("events"))
    return last.select("user_id", F.convert_timezone(F.current_timezone(), F.lit("UTC"), F.col("start").cast("timestamp_ntz")).alias("start"), "events")


@query("stream_log_tail", "SELECT event_id, event_type FROM events WHERE event_id % 20 = 3 AND event_id > 500", views=False)
def stream_log_tail(c: Catalog) -> DataFrame:
    return run.drain(events(c).where("event_id % 20 = 3 and event_id > 500").select("event_id", "event_type")).drop("batch_id")

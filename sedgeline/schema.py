"""Schemas of the stored relations and checks of the rules that storage does not enforce."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


#: As DDL, which readers and ``createDataFrame`` take as they are.
SCHEMAS: dict[str, str] = {
    "users": "user_id bigint, email string, name string, role string, banned boolean, ban_expires timestamp",
    "feeds": "feed_id bigint, user_id bigint, name string, aggregator string, identifier string, enabled boolean, daily_limit int, interval_minutes int, concurrency int, max_age_days int, options string, updated_at timestamp",
    "tags": "tag_id bigint, user_id bigint, name string, color string",
    "feed_tags": "feed_id bigint, tag_id bigint",
    "articles": "article_id bigint, feed_id bigint, name string, identifier string, raw_content string, plain_text string, content_hash string, date timestamp, read boolean, starred boolean, author string, icon string, created_at timestamp, updated_at timestamp",
    "tombstones": "tombstone_id bigint, article_id bigint, user_id bigint, deleted_at timestamp",
    "blocks": "block_id string, article_id bigint, parent_id string, position int, kind string, level int, ordered boolean, text string, language string, image_ref string, embed_provider string, embed_url string, embed_title string",
    "runs_inline": "block_id string, position int, text string, bold boolean, italic boolean, code boolean, strikethrough boolean, link string",
    "blobs": "hash string, content_type string, width int, height int, byte_size bigint, data binary",
    "jobs": "job_id bigint, run_id bigint, user_id bigint, kind string, payload string, status string, attempts int, max_attempts int, run_at timestamp, started_at timestamp, finished_at timestamp, progress int, error string, priority int",
    "runs": "run_id bigint, user_id bigint, status string, total_jobs int, completed_jobs int, failed_jobs int, finished_at timestamp",
    "requests": "request_id bigint, user_id bigint, created_at timestamp",
}


def orphans(child: DataFrame, parent: DataFrame, key: str, parent_key: str | None = None) -> DataFrame:
    """Child rows whose non-null key has no parent."""
    parent_key = parent_key or key
    keys = parent.select(F.col(parent_key).alias("__key"))
    return child.where(F.col(key).isNotNull()).join(keys, F.col(key) == F.col("__key"), "left_anti")


def duplicates(df: DataFrame, *keys: str) -> DataFrame:
    """Key values that more than one row has, with their number."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("rows")).where("rows > 1")


def violations(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """Number of rows that break each rule, in one pass: ``rule, rows``.  A rule that is null is not broken."""
    counts = df.agg(*[F.count_if(~r).alias(n) for n, r in rules.items()])
    return counts.select(F.explode(F.map_from_arrays(F.array(*map(F.lit, rules)), F.array(*rules))).alias("rule", "rows"))


def missing_fields(df: DataFrame, *columns: str) -> DataFrame:
    """Tally of rows without a value (null or empty), one column each, in one pass."""
    return df.agg(F.count(F.lit(1)).alias("rows"), *[F.count_if(F.coalesce(F.col(c).cast("string"), F.lit("")) == "").alias(f"missing_{c}") for c in columns])

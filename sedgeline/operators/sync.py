"""Delta feed in three streams: new, updated and removed articles since a cursor.

Each stream is a keyset scan by (epoch second, id).  The condition is written as a range on the time, which reaches the
Parquet scan, and the tie rule beside it.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sedgeline.params import Cursor, Mark

DEFAULT_ROWS, MOST_ROWS = 200, 500
HORIZON_DAYS = 90
COLUMNS = ("article_id", "feed_id", "name", "date", "read", "starred", "created_at", "updated_at")


def clamp(limit: int | None) -> int:
    return DEFAULT_ROWS if limit is None else max(1, min(limit, MOST_ROWS))


def after(time: str, key: str, mark: Mark) -> Column:
    """Rows behind a mark; times count in whole seconds."""
    at = F.lit(mark.time)
    second = F.date_trunc("second", time).cast("timestamp_ntz")
    return (F.col(time) >= at) & ((second > at) | ((second == at) & (F.col(key) > mark.id)))


def stream(rows: DataFrame, time: str, key: str, mark: Mark, limit: int) -> DataFrame:
    return rows.where(after(time, key, mark)).orderBy(F.date_trunc("second", time), key).limit(limit)


@dataclass(frozen=True)
class Changes:
    """One page of each stream.  ``fetched`` updates include rows that are also new; their marks count."""

    new: DataFrame
    updated: DataFrame
    removed: DataFrame
    fetched: DataFrame


def changes(articles: DataFrame, tombstones: DataFrame, user_id: int, feeds: DataFrame, cursor: Cursor, limit: int | None = None) -> Changes:
    mine = articles.join(feeds.where(F.col("user_id") == user_id).select("feed_id"), "feed_id", "left_semi").select(*COLUMNS)
    n = clamp(limit)
    new = stream(mine, "created_at", "article_id", cursor.new, n)
    fetched = stream(mine, "updated_at", "article_id", cursor.updated, n)
    removed = stream(tombstones.where(F.col("user_id") == user_id).select("article_id", "deleted_at"), "deleted_at", "article_id", cursor.removed, n)
    return Changes(new, fetched.join(new.select("article_id"), "article_id", "left_anti"), removed, fetched)


def last_mark(rows: DataFrame, time: str, key: str, before: Mark) -> Mark:
    """The mark of a page's last row, at most one page of rows being read."""
    top = rows.agg(F.max(F.struct(F.date_trunc("second", time).cast("timestamp_ntz").alias("t"), F.col(key).alias("k"))).alias("m")).select(F.unix_seconds(F.col("m.t").cast("timestamp")).alias("t"), "m.k").first()
    return before if top["k"] is None else Mark(top["t"], top["k"])


def next_cursor(page: Changes, cursor: Cursor) -> Cursor:
    return Cursor(last_mark(page.new, "created_at", "article_id", cursor.new), last_mark(page.fetched, "updated_at", "article_id", cursor.updated), last_mark(page.removed, "deleted_at", "article_id", cursor.removed))


def needs_resync(cursor: Cursor, now: int, oldest_tombstone: int | None) -> bool:
    """Whether deletions may have been pruned that the cursor has not seen.  A zero cursor starts anyway."""
    if cursor.is_zero:
        return False
    if cursor.removed.at and cursor.removed.at < now - HORIZON_DAYS * 86_400:
        return True
    return bool(oldest_tombstone and cursor.removed.at and cursor.removed.at < oldest_tombstone - HORIZON_DAYS * 86_400)

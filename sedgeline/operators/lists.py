"""Owner-scoped lists: filter, search, sort, page and count.

Ownership is always reached through the feed, never stored on the article.  Every ordering ends in a unique key.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sedgeline.params import ListParams


def owned(articles: DataFrame, feeds: DataFrame, user_id: int) -> DataFrame:
    """Articles of the user's feeds.  A semi-join: the feeds' filter is pushed to their scan."""
    return articles.join(feeds.where(F.col("user_id") == user_id).select("feed_id"), "feed_id", "left_semi")


def owned_ids(requested: DataFrame, rows: DataFrame, key: str, user_id: int, admin: bool = False) -> DataFrame:
    """Of the requested ids those of rows that the caller owns; all that exist for an admin."""
    mine = rows if admin else rows.where(F.col("user_id") == user_id)
    return requested.join(mine.select(key), key, "left_semi")


def given(**equal) -> list[Column]:
    """Equality filters for the values that are given."""
    return [F.col(k) == v for k, v in equal.items() if v is not None]


def where_all(df: DataFrame, conditions: Sequence[Column]) -> DataFrame:
    return df.where(reduce(Column.__and__, conditions)) if conditions else df


def contains_text(columns: Sequence[str], term: str) -> Column:
    """Case-insensitive containment in any column; wildcards in the term are plain characters."""
    return reduce(Column.__or__, [F.contains(F.lower(F.col(c)), F.lit(term.lower())) for c in columns])


def escape_like(term: Column) -> Column:
    return F.regexp_replace(term, r"([\\%_])", r"\\$1")


def tagged(feeds: DataFrame, feed_tags: DataFrame, tag_ids: Sequence, key: str = "feed_id") -> DataFrame:
    """Rows of feeds that have one of the tags."""
    return feeds.join(feed_tags.where(F.col("tag_id").isin(list(tag_ids))).select(key), key, "left_semi")


def ordered(df: DataFrame, params: ListParams, allowed: dict[str, str], fallback: str, key: str, key_descending: bool = True) -> DataFrame:
    """Sorted by an allowed column, else by the fallback; ties by key; nulls last."""
    column = F.col(allowed.get(params.sort or "", fallback))
    by = column.desc_nulls_last() if params.descending else column.asc_nulls_last()
    return df.orderBy(by, F.desc(key) if key_descending else F.asc(key))


def page(df: DataFrame, params: ListParams) -> DataFrame:
    return df.offset(params.offset).limit(params.page_size)


def total(df: DataFrame) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("total"))


ARTICLE_COLUMNS = ("article_id", "feed_id", "name", "date", "read", "starred")
ARTICLE_SORTS = {"date": "date", "name": "name", "read": "read", "starred": "starred"}


def article_filter(articles: DataFrame, feeds: DataFrame, user_id: int, params: ListParams, feed_tags: DataFrame | None = None) -> DataFrame:
    """Articles that a list shows, before sorting; the same frame serves page and total."""
    f = params.filters
    flags = {k: f[k] == "true" for k in ("read", "starred") if k in f}
    rows = where_all(owned(articles, feeds, user_id), given(feed_id=int(f["feed"]) if "feed" in f else None, **flags))
    if params.q:
        rows = rows.where(contains_text(["name"], params.q))
    if "tag" in f and feed_tags is not None:
        rows = tagged(rows, feed_tags, f["tag"].split(","))
    return rows


def article_page(articles: DataFrame, feeds: DataFrame, user_id: int, params: ListParams, feed_tags: DataFrame | None = None) -> DataFrame:
    """A page of articles with their feed's name and the total of all pages."""
    rows = article_filter(articles, feeds, user_id, params, feed_tags)
    shown = page(ordered(rows.select(*ARTICLE_COLUMNS), params, ARTICLE_SORTS, "date", "article_id"), params)
    names = feeds.where(F.col("user_id") == user_id).select("feed_id", F.col("name").alias("feed_name"))
    return shown.join(names, "feed_id").join(F.broadcast(total(rows)))  # the total is one row


def page_with_total(df: DataFrame, params: ListParams, order: Sequence[Column]) -> DataFrame:
    """A page's rows with their ranks and the total: a top-k that each task cuts, and a map-side count.

    Only the rows up to the page's end, which the top-k leaves, are ranked."""
    top = df.orderBy(*order).limit(params.offset + params.page_size)
    ranked = top.withColumn("rank", F.row_number().over(Window.orderBy(*order))).where(F.col("rank") > params.offset)
    return ranked.join(F.broadcast(total(df)))  # one row


def recent_unread(articles: DataFrame, feeds: DataFrame, user_id: int, n: int = 6) -> DataFrame:
    mine = owned(articles.where("NOT read"), feeds, user_id)
    return mine.select("article_id", "feed_id", "name", "date").orderBy(F.desc("date"), F.desc("article_id")).limit(n)


def dashboard(articles: DataFrame, feeds: DataFrame, feed_tags: DataFrame, user_id: int) -> DataFrame:
    """Counts of a user's articles, feeds and tags: one pass each."""
    mine = feeds.where(F.col("user_id") == user_id)
    a = owned(articles, feeds, user_id).agg(F.count(F.lit(1)).alias("articles"), F.count_if(~F.col("read")).alias("unread"))
    f = mine.agg(F.count(F.lit(1)).alias("feeds"), F.count_if("enabled").alias("enabled_feeds"))
    t = feed_tags.join(mine.select("feed_id"), "feed_id", "left_semi").agg(F.count_distinct("tag_id").alias("tags"))
    return a.join(F.broadcast(f)).join(F.broadcast(t))  # a row each


def feeds_with_counts(feeds: DataFrame, articles: DataFrame, feed_tags: DataFrame) -> DataFrame:
    """Feeds with their number of articles and list of tags: one grouping each instead of a query per feed."""
    counts = articles.groupBy("feed_id").agg(F.count(F.lit(1)).alias("articles"))
    tags = feed_tags.groupBy("feed_id").agg(F.array_sort(F.collect_set("tag_id")).alias("tags"))  # of one feed
    empty = F.array().cast("array<string>")
    return feeds.join(counts, "feed_id", "left").join(tags, "feed_id", "left").withColumn("articles", F.coalesce("articles", F.lit(0))).withColumn("tags", F.coalesce("tags", empty))


def tag_usage(feed_tags: DataFrame) -> DataFrame:
    """Pairs (not distinct feeds) by tag."""
    return feed_tags.groupBy("tag_id").agg(F.count(F.lit(1)).alias("feeds"))


def has_role(role: str, column: str = "role") -> Column:
    """Membership in a comma list; parts are not trimmed and case counts."""
    return F.array_contains(F.split(column, ","), role)


def usable_admin(now: Column) -> Column:
    """Admin who is not banned, or whose ban is over."""
    return has_role("admin") & (~F.coalesce("banned", F.lit(False)) | F.coalesce(F.col("ban_expires") <= now, F.lit(False)))


def usable_admins_without(users: DataFrame, excluded: DataFrame, now: Column) -> DataFrame:
    """Number of usable admins outside the excluded ids (an anti join, so a null there excludes nobody)."""
    return users.where(usable_admin(now)).join(excluded, "user_id", "left_anti").agg(F.count(F.lit(1)).alias("admins"))


def deletable_users(users: DataFrame, wanted: DataFrame, now: Column) -> DataFrame:
    """The wanted users, or none if no usable admin would remain."""
    left = F.broadcast(usable_admins_without(users, wanted, now))  # one row
    return users.join(wanted, "user_id", "left_semi").join(left).where("admins > 0").drop("admins")


def delete_impact(users: DataFrame, feeds: DataFrame, articles: DataFrame, feed_tags: DataFrame) -> DataFrame:
    """What deleting a set of users removes."""
    mine = feeds.join(users.select("user_id"), "user_id", "left_semi").select("feed_id")
    n = F.count(F.lit(1))
    parts = [mine.agg(n.alias("feeds")), articles.join(mine, "feed_id", "left_semi").agg(n.alias("articles")), feed_tags.join(mine, "feed_id", "left_semi").agg(n.alias("feed_tags"))]
    return reduce(lambda a, b: a.join(F.broadcast(b)), parts)  # a row each


def jobs_with_owner(jobs: DataFrame, users: DataFrame, kind: str | None = None, status: str | None = None, user_id: int | None = None) -> DataFrame:
    """Jobs, with their owner if they have one."""
    rows = where_all(jobs, given(kind=kind, status=status, user_id=user_id))
    return rows.join(users.select("user_id", F.col("name").alias("owner")), "user_id", "left")


def visible_jobs(jobs: DataFrame, user_id: int, admin: bool) -> DataFrame:
    return jobs if admin else jobs.where(F.col("user_id") == user_id)


def top_per_key(df: DataFrame, key: str, order: Sequence[Column], n: int) -> DataFrame:
    """First ``n`` rows of each key.  The rank limit is applied before the shuffle too."""
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where(F.col("rank") <= n)


def valid_comment() -> Column:
    """Comments with a body, not by bots."""
    body, author = F.trim(F.coalesce("body", F.lit(""))), F.lower(F.coalesce("author", F.lit("")))
    return ~body.isin("", "[deleted]", "[removed]") & ~(author.endswith("_bot") | author.endswith("-bot") | (author == "automoderator"))


def top_comments(comments: DataFrame, n: int) -> DataFrame:
    return top_per_key(comments.where(valid_comment()), "post_id", [F.desc("score"), F.asc("position")], n)


def first_then_valid(comments: DataFrame, n: int) -> DataFrame:
    """The first ``n`` of each post by place, and of these the valid ones: the limit comes first."""
    return top_per_key(comments, "post_id", [F.asc("position")], n).where(valid_comment())


def longest_prefix(rows: DataFrame, value: str, prefixes: DataFrame) -> DataFrame:
    """Rows with the longest of a small table's ``prefix`` that they start with, and its ``label``.

    Joined by first letter, so the join has a key; ``max_by`` picks the longest."""
    keyed = rows.withColumn("__i", F.monotonically_increasing_id()).withColumn("__k", F.left(F.col(value), F.lit(1)))
    table = prefixes.withColumn("__k", F.left("prefix", F.lit(1)))
    hit = keyed.join(table, (keyed["__k"] == table["__k"]) & F.startswith(keyed[value], table["prefix"]), "left").drop(table["__k"])
    best = F.max_by(F.struct("prefix", "label"), F.length("prefix"))
    return hit.groupBy("__i", *rows.columns).agg(best.alias("best")).select(*rows.columns, "best.prefix", "best.label")


def image_owned(hashes: DataFrame, blocks: DataFrame, articles: DataFrame, feeds: DataFrame, user_id: int) -> DataFrame:
    """Of ``hashes`` those that the user may see: as an image or a thumbnail in an own article, or as an own feed's logo."""
    mine = feeds.where(F.col("user_id") == user_id)
    in_articles = blocks.join(articles.join(mine.select("feed_id"), "feed_id", "left_semi").select("article_id"), "article_id", "left_semi")
    refs = [in_articles.select(F.col("image_ref").alias("hash")), in_articles.select(F.col("thumbnail_ref").alias("hash")), mine.select(F.col("logo").alias("hash"))]
    return hashes.join(reduce(DataFrame.union, refs), "hash", "left_semi")

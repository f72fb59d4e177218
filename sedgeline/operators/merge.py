"""Incremental maintenance: hash-gated upserts, retention with tombstones, cascades and bulk edits.

Tables are Parquet, so a change is a join that gives the new state; callers write it.  Nothing reads the clock: the
present is a parameter.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

KEY = ("feed_id", "identifier")


def content_hash(*fields: Column) -> Column:
    """SHA-256 of fields, each with its length in front, so that borders between them count; null differs from empty."""
    parts = [F.when(f.isNull(), F.lit("-")).otherwise(F.concat(F.length(f.cast("string")).cast("string"), F.lit(":"), f.cast("string"))) for f in fields]
    return F.sha2(F.concat_ws("|", *parts), 256)


def last_of_batch(incoming: DataFrame, order: str, key: tuple[str, ...] = KEY) -> DataFrame:
    """Of incoming rows with one key the last; rows without an identifier are dropped."""
    usable = incoming.where(F.coalesce("identifier", F.lit("")) != "")
    return usable.withColumn("__n", F.row_number().over(Window.partitionBy(*key).orderBy(F.desc(order)))).where("__n = 1").drop("__n")


def classify(stored: DataFrame, incoming: DataFrame, key: tuple[str, ...] = KEY, hash_col: str = "content_hash") -> DataFrame:
    """Full outer join on the key: ``action`` is created, updated, unchanged or untouched.

    ``stored`` and ``incoming`` share the key, ``date`` and the hash; the stored date stays if none comes in."""
    s = stored.select(*key, F.col(hash_col).alias("s_hash"), F.col("date").alias("s_date"), F.lit(True).alias("s"))
    i = incoming.select(*key, F.col(hash_col).alias("i_hash"), F.col("date").alias("i_date"), F.lit(True).alias("i"))
    action = F.when(F.col("i").isNull(), "untouched").when(F.col("s").isNull(), "created").when(F.col("s_hash").eqNullSafe(F.col("i_hash")), "unchanged").otherwise("updated")
    both = s.join(i, list(key), "full_outer").withColumn("action", action)
    date = F.when(F.col("action").isin("created", "updated"), F.coalesce("i_date", "s_date")).otherwise(F.col("s_date"))
    return both.select(*key, "action", F.when(F.col("i").isNull(), F.col("s_hash")).otherwise(F.col("i_hash")).alias(hash_col), date.alias("date"))


def upsert(stored: DataFrame, incoming: DataFrame, now: Column, key: tuple[str, ...] = KEY, hash_col: str = "content_hash") -> DataFrame:
    """The new state of ``stored``: rows whose hash is unchanged stay as they are, ``updated_at`` moves for the others.

    Columns that come in replace stored ones; flags and other columns that don't, stay."""
    brought = [c for c in incoming.columns if c not in key]
    i = incoming.select(*key, *[F.col(c).alias(f"i_{c}") for c in brought], F.lit(True).alias("__i"))
    both = stored.withColumn("__s", F.lit(True)).join(i, list(key), "full_outer")
    changed = F.col("__i").isNotNull() & (F.col("__s").isNull() | ~F.col(hash_col).eqNullSafe(F.col(f"i_{hash_col}")))
    out = []
    for c in stored.columns:
        if c in key:
            out.append(F.col(c))
        elif c == "updated_at":
            out.append(F.when(changed, now).otherwise(F.col(c)).alias(c))
        elif c == "created_at":
            out.append(F.when(F.col("__s").isNull(), now).otherwise(F.col(c)).alias(c))
        elif c == "date" and c in brought:
            out.append(F.when(changed, F.coalesce(f"i_{c}", c)).otherwise(F.col(c)).alias(c))
        elif c in brought:
            out.append(F.when(changed, F.col(f"i_{c}")).otherwise(F.col(c)).alias(c))
        else:
            out.append(F.col(c))
    return both.select(*out)


def tally(classified: DataFrame) -> DataFrame:
    return classified.where("action <> 'untouched'").groupBy("action").agg(F.count(F.lit(1)).alias("rows"))


def expired(articles: DataFrame, cutoff: Column) -> Column:
    """Retention: not starred and created at the cutoff or before."""
    return ~F.col("starred") & (F.col("created_at") <= cutoff)


def retention(articles: DataFrame, feeds: DataFrame, days: DataFrame, now: Column) -> DataFrame:
    """Articles with ``user_id`` and ``gone``; ``days`` is each user's retention (60 where it has none, none at 0)."""
    owner = feeds.select("feed_id", "user_id").join(days, "user_id", "left").withColumn("retention_days", F.coalesce("retention_days", F.lit(60)))
    joined = articles.join(owner, "feed_id", "left")
    gone = expired(articles, now - F.make_dt_interval(days=F.col("retention_days").cast("int"))) & (F.col("retention_days") > 0)
    return joined.withColumn("gone", F.coalesce(gone, F.lit(False)))


def tombstones(gone: DataFrame, now: Column) -> DataFrame:
    """Delete log rows, with the owner copied, as the feed may be gone later."""
    return gone.select("article_id", "user_id", now.alias("deleted_at"))


def prune_tombstones(log: DataFrame, now: Column, days: int = 90) -> DataFrame:
    return log.where(F.col("deleted_at") > now - F.make_dt_interval(days=F.lit(days)))


def delete_feeds(articles: DataFrame, feeds: DataFrame, feed_ids: DataFrame, now: Column) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Feeds, articles and new tombstones after deleting feeds with all that hangs on them."""
    gone = articles.join(feeds.join(feed_ids, "feed_id", "left_semi").select("feed_id", "user_id"), "feed_id")
    return feeds.join(feed_ids, "feed_id", "left_anti"), articles.join(feed_ids, "feed_id", "left_anti"), tombstones(gone, now)


def set_flag(articles: DataFrame, mine: DataFrame, flag: str, value: bool, now: Column) -> DataFrame:
    """Bulk flag for owned ids.  Rows that have the value already are not touched; content hashes stay."""
    marked = articles.join(mine.select("article_id", F.lit(True).alias("__hit")), "article_id", "left")
    moves = F.col("__hit").isNotNull() & (F.col(flag) != value)
    return marked.withColumn("updated_at", F.when(moves, now).otherwise(F.col("updated_at"))).withColumn(flag, F.when(moves, F.lit(value)).otherwise(F.col(flag))).select(*articles.columns)


def edit(articles: DataFrame, edits: DataFrame, now: Column) -> DataFrame:
    """Manual edits (``article_id`` and new columns; null keeps): the hash is cleared, so the next collection rewrites it."""
    new = [c for c in edits.columns if c != "article_id"]
    joined = articles.join(edits.select("article_id", *[F.col(c).alias(f"e_{c}") for c in new], F.lit(True).alias("__hit")), "article_id", "left")
    hit = F.col("__hit").isNotNull()
    values = {c: F.coalesce(f"e_{c}", c) for c in new} | {"updated_at": F.when(hit, now).otherwise(F.col("updated_at"))}
    if "content_hash" in articles.columns:
        values["content_hash"] = F.when(~hit, F.col("content_hash"))
    return joined.select(*[values.get(c, F.col(c)).alias(c) for c in articles.columns])


def patch(rows: DataFrame, changes: DataFrame, key: str) -> DataFrame:
    """Sparse update: an omitted (null) field keeps, an empty string clears."""
    new = [c for c in changes.columns if c != key]
    joined = rows.join(changes.select(key, *[F.col(c).alias(f"p_{c}") for c in new]), key, "left")
    return joined.select(*[F.when(F.col(f"p_{c}").isNull(), F.col(c)).when(F.col(f"p_{c}") == "", F.lit(None)).otherwise(F.col(f"p_{c}")).alias(c) if c in new else F.col(c) for c in rows.columns])


def new_names(existing: DataFrame, wanted: DataFrame, name: str = "name") -> DataFrame:
    """Wanted names that clash with none, whatever their case; of clashing wanted ones the first."""
    first = wanted.groupBy(F.lower(name).alias("__low")).agg(F.min_by(name, "position").alias(name))
    return first.join(existing.select(F.lower(name).alias("__low")), "__low", "left_anti").drop("__low")


def last_writer(writes: DataFrame, key: str, at: str) -> DataFrame:
    """The latest write of each key; ties go to the larger row."""
    rest = [c for c in writes.columns if c not in (key, at)]
    top = writes.groupBy(key).agg(F.max(F.struct(at, *rest)).alias("w"))
    return top.select(key, *[F.col(f"w.{c}").alias(c) for c in (at, *rest)])


def unique_blobs(blobs: DataFrame, data: str = "data") -> tuple[DataFrame, DataFrame]:
    """Content-addressed blobs, and hashes that stand for more than one size (a collision or damage).

    ``width`` and ``height`` of 1 mark tracking pixels, which are not stored."""
    hashed = blobs.where(~((F.col("width") == 1) & (F.col("height") == 1))).withColumn("hash", F.sha2(F.col(data), 256)).withColumn("byte_size", F.octet_length(data))
    sizes = hashed.groupBy("hash").agg(F.count_distinct("byte_size").alias("sizes")).where("sizes > 1")
    return hashed.dropDuplicates(["hash"]), sizes


def stop_or_delete(jobs: DataFrame, ids: DataFrame) -> DataFrame:
    """The wanted jobs: those at work are asked to stop, the others can go."""
    at_work = F.col("status").isin("running", "cancelling")
    return jobs.join(ids, "job_id", "left_semi").withColumn("outcome", F.when(at_work, "stopping").otherwise("deleted"))


def fan_out(mine: DataFrame, key: str, kind: str, now: Column, priority: int = 0) -> DataFrame:
    """One pending job for each owned row."""
    return mine.select("user_id", F.lit(kind).alias("kind"), F.to_json(F.struct(F.col(key))).alias("payload"), F.lit("pending").alias("status"), now.alias("run_at"), F.lit(priority).alias("priority"))


def reloaded(articles: DataFrame, fetched: DataFrame, now: Column) -> DataFrame:
    """Articles after a reload: ``fetched`` has ``article_id, name, raw_content, plain_text, error``.

    What was fetched replaces the content; a failed fetch leaves a notice as text and the raw page as it was.  The hash is
    cleared either way, so that the next collection writes again."""
    new = ["name", "raw_content", "plain_text"]
    f = fetched.select("article_id", *[F.col(c).alias(f"f_{c}") for c in (*new, "error")], F.lit(True).alias("__hit"))
    joined = articles.join(f, "article_id", "left")
    hit, failed = F.col("__hit").isNotNull(), F.col("f_error").isNotNull()
    values = {
        "name": F.when(hit & ~failed, F.coalesce(F.nullif("f_name", F.lit("")), "name")).otherwise(F.col("name")),
        "raw_content": F.when(hit & ~failed, F.col("f_raw_content")).otherwise(F.col("raw_content")),
        "plain_text": F.when(failed, F.concat(F.lit("This article could not be reloaded: "), "f_error")).when(hit, F.col("f_plain_text")).otherwise(F.col("plain_text")),
        "content_hash": F.when(~hit, F.col("content_hash")),
        "updated_at": F.when(hit, now).otherwise(F.col("updated_at")),
    }
    return joined.select(*[values.get(c, F.col(c)).alias(c) for c in articles.columns])


def restored(articles: DataFrame, feeds: DataFrame, feed_ids: DataFrame, now: Column) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Feeds to be collected anew: the articles that are left, tombstones of the others, and a job for each feed."""
    wanted = feeds.join(feed_ids, "feed_id", "left_semi")
    gone = articles.join(wanted.select("feed_id", "user_id"), "feed_id")
    return articles.join(feed_ids, "feed_id", "left_anti"), tombstones(gone, now), fan_out(wanted, "feed_id", "aggregate", now)


def created_feeds(wanted: DataFrame, tags: DataFrame, now: Column, first_id: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """From ``position, user_id, name, tag_ids``: new feeds, their pairs with tags of the same owner, and a logo job each.

    Ids count on from ``first_id`` by position: positions are the caller's own and unique."""
    feeds = wanted.withColumn("feed_id", F.lit(first_id) + F.col("position"))
    pairs = feeds.select("feed_id", "user_id", F.explode(F.array_distinct("tag_ids")).alias("tag_id")).join(tags.select("tag_id", "user_id"), ["tag_id", "user_id"], "left_semi").select("feed_id", "tag_id")
    return feeds.drop("tag_ids", "position"), pairs, fan_out(feeds, "feed_id", "feed.logo", now)


def retagged(feed_tags: DataFrame, changes: DataFrame, tags: DataFrame) -> DataFrame:
    """Pairs after feed edits ``feed_id, user_id, tag_ids``: omitted (null) lists keep, empty ones clear, others replace."""
    given = changes.where("tag_ids is not null")
    new = given.select("feed_id", "user_id", F.explode(F.array_distinct("tag_ids")).alias("tag_id")).join(tags.select("tag_id", "user_id"), ["tag_id", "user_id"], "left_semi")
    return feed_tags.join(given.select("feed_id"), "feed_id", "left_anti").select("feed_id", "tag_id").unionByName(new.select("feed_id", "tag_id"))


#: Owners that are numbered by one window.
OWNERS_A_RANGE = 4096


def tags_for(names: DataFrame, tags: DataFrame, first_id: int) -> tuple[DataFrame, DataFrame]:
    """Tags by name (``user_id, name``), found or created: all wanted with their ids, and those that are new.

    Names are compared without case within an owner; of equal wanted ones the smallest spelling is created."""
    wanted = names.groupBy("user_id", F.lower("name").alias("__low")).agg(F.min("name").alias("name"))
    had = tags.select("user_id", F.lower("name").alias("__low"), "tag_id")
    new = wanted.join(had, ["user_id", "__low"], "left_anti")
    # numbers within an owner, then after the owners before: no window over all rows
    at = F.row_number().over(Window.partitionBy("user_id").orderBy("__low"))
    sizes = new.groupBy("user_id").agg(F.count(F.lit(1)).alias("__n")).withColumn("__range", F.floor(F.col("user_id") / OWNERS_A_RANGE))
    earlier = lambda w: F.coalesce(F.sum("__n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranges = sizes.groupBy("__range").agg(F.sum("__n").alias("__n")).select("__range", earlier(Window.orderBy("__range")).alias("__base"))  # a row for each range
    sizes = sizes.withColumn("__within", earlier(Window.partitionBy("__range").orderBy("user_id"))).join(ranges, "__range").select("user_id", (F.col("__base") + F.col("__within")).alias("__before"))
    created = new.withColumn("__at", at).join(sizes, "user_id").select("user_id", "__low", "name", (F.lit(first_id - 1) + F.col("__before") + F.col("__at")).alias("tag_id"))
    found = wanted.join(had, ["user_id", "__low"]).select("user_id", "__low", "tag_id")
    return found.unionByName(created.select("user_id", "__low", "tag_id")).withColumnRenamed("__low", "name"), created.drop("__low")


def appended_lines(lines: DataFrame, new: DataFrame) -> DataFrame:
    """Log lines with more behind: ``job_id, position, line``; a job's lines count on from its last one."""
    last = lines.groupBy("job_id").agg(F.max("position").alias("__last"))
    at = F.row_number().over(Window.partitionBy("job_id").orderBy("position"))
    rows = new.withColumn("__at", at).join(last, "job_id", "left").withColumn("position", F.coalesce("__last", F.lit(-1)) + F.col("__at"))
    return lines.unionByName(rows.select(*lines.columns))


def with_logos(feeds: DataFrame, logos: DataFrame, stored: DataFrame) -> DataFrame:
    """Feeds whose new logo (``feed_id, hash``) has been stored refer to it; others keep theirs."""
    known = logos.join(stored.select("hash"), "hash", "left_semi").select("feed_id", F.col("hash").alias("__hash"))
    return feeds.join(known, "feed_id", "left").select(*[F.coalesce("__hash", "logo").alias(c) if c == "logo" else F.col(c) for c in feeds.columns])

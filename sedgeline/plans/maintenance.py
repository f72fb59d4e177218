"""Queries of merges, delta feeds and the control plane, with their SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sedgeline.catalog import Catalog
from sedgeline.operators import control, merge, sync
from sedgeline.params import Cursor, Mark
from sedgeline.plans.relational import NOW, OWNER, query


def at(text: str) -> Column:
    return F.lit(text).cast("timestamp_ntz")


def stored(c: Catalog) -> DataFrame:
    """Articles that are stored: all but each seventh."""
    rows = c.articles.where("article_id % 7 <> 0")
    return rows.withColumn("content_hash", merge.content_hash(F.col("name"), F.col("content"), F.col("date").cast("string")))


def incoming(c: Catalog) -> DataFrame:
    """A collection: each third article, each fifth of which has changed, some twice, some undated, some without identifier."""
    k = F.col("article_id")
    base = c.articles.where(k % 3 == 0).withColumn("seq", k)
    again = c.articles.where(k % 30 == 0).withColumn("seq", k + 1_000_000_000).withColumn("content", F.concat("content", F.lit("*")))
    rows = base.withColumn("content", F.when(k % 5 == 0, F.concat("content", F.lit("+"))).otherwise(F.col("content"))).unionByName(again)
    rows = rows.withColumn("identifier", F.when(k % 99 == 0, F.lit("")).otherwise(F.col("identifier")))
    hashed = rows.withColumn("content_hash", merge.content_hash(F.col("name"), F.col("content"), F.col("date").cast("string")))
    return merge.last_of_batch(hashed.withColumn("date", F.when(k % 6 == 0, F.lit(None).cast("timestamp_ntz")).otherwise(F.col("date"))), "seq").drop("seq", "article_id")


#: Which rows come in, and whether they have changed, told by key alone.
MERGED = """
    , m AS (SELECT article_id AS k, feed_id, identifier, date, created_at, updated_at, article_id % 7 <> 0 AS s, article_id % 3 = 0 AND article_id % 99 <> 0 AS i, article_id % 15 = 0 AS c FROM articles),
    act AS (SELECT *, CASE WHEN NOT i THEN 'untouched' WHEN NOT s THEN 'created' WHEN c THEN 'updated' ELSE 'unchanged' END AS action FROM m WHERE s OR i)"""


@query("upsert_actions", MERGED + "SELECT action, count(*) AS rows FROM act WHERE action <> 'untouched' GROUP BY action")
def upsert_actions(c: Catalog) -> DataFrame:
    return merge.tally(merge.classify(stored(c), incoming(c)))


@query("upsert_classified", MERGED + "SELECT feed_id, identifier, action, CASE WHEN action = 'created' AND k % 6 = 0 THEN NULL ELSE date END AS date FROM act")
def upsert_classified(c: Catalog) -> DataFrame:
    return merge.classify(stored(c), incoming(c)).select("feed_id", "identifier", "action", "date")


@query("upsert_result", MERGED + """
    SELECT feed_id, identifier, CASE WHEN action = 'created' THEN NULL ELSE k END AS article_id, CASE WHEN action = 'created' AND k % 6 = 0 THEN NULL ELSE date END AS date,
           CASE WHEN action = 'created' THEN TIMESTAMP '1998-01-01' ELSE created_at END AS created_at, CASE WHEN action IN ('created', 'updated') THEN TIMESTAMP '1998-01-01' ELSE updated_at END AS updated_at FROM act""")
def upsert_result(c: Catalog) -> DataFrame:
    keep = ["feed_id", "identifier", "article_id", "date", "content_hash", "created_at", "updated_at"]
    return merge.upsert(stored(c).select(keep), incoming(c).select("feed_id", "identifier", "date", "content_hash"), at(NOW)).drop("content_hash")


def _retention(c: Catalog) -> DataFrame:
    days = c.users.where("user_id % 3 <> 0").select("user_id", (F.col("user_id") % 4 * 365).alias("retention_days"))
    return merge.retention(c.articles, c.feeds, days, at(NOW))


RETENTION = """
    , r AS (SELECT a.article_id, f.user_id, a.created_at, a.starred, CASE WHEN f.user_id % 3 <> 0 THEN f.user_id % 4 * 365 ELSE 60 END AS days FROM articles a JOIN feeds f USING (feed_id)),
    g AS (SELECT *, days > 0 AND NOT starred AND created_at <= TIMESTAMP '1998-01-01' - to_days(CAST(days AS INTEGER)) AS gone FROM r)"""


@query("retention_survivors", RETENTION + "SELECT article_id, user_id FROM g WHERE NOT gone")
def retention_survivors(c: Catalog) -> DataFrame:
    return _retention(c).where("NOT gone").select("article_id", "user_id")


@query("retention_tombstones", RETENTION + "SELECT article_id, user_id, TIMESTAMP '1998-01-01' AS deleted_at FROM g WHERE gone")
def retention_tombstones(c: Catalog) -> DataFrame:
    return merge.tombstones(_retention(c).where("gone"), at(NOW))


@query("feed_delete", """
    SELECT 'feeds' AS what, count(*) AS rows FROM feeds WHERE feed_id % 20 <> 0 UNION ALL SELECT 'articles', count(*) FROM articles WHERE feed_id % 20 <> 0
    UNION ALL SELECT 'tombstones', count(*) FROM articles WHERE feed_id % 20 = 0""")
def feed_delete(c: Catalog) -> DataFrame:
    parts = merge.delete_feeds(c.articles, c.feeds, c.feeds.where("feed_id % 20 = 0").select("feed_id"), at(NOW))
    counts = [p.agg(F.lit(n).alias("what"), F.count(F.lit(1)).alias("rows")) for n, p in zip(("feeds", "articles", "tombstones"), parts, strict=True)]
    return counts[0].unionByName(counts[1]).unionByName(counts[2])


@query("bulk_read_flag", """
    SELECT article_id, read OR (article_id % 4 = 0 AND feed_id IN (SELECT feed_id FROM mine)) AS read,
           CASE WHEN NOT read AND article_id % 4 = 0 AND feed_id IN (SELECT feed_id FROM mine) THEN TIMESTAMP '1998-01-01' ELSE updated_at END AS updated_at FROM articles""")
def bulk_read_flag(c: Catalog) -> DataFrame:
    mine = c.articles.where("article_id % 4 = 0").join(c.feeds.where(F.col("user_id") == OWNER), "feed_id", "left_semi").select("article_id")
    return merge.set_flag(c.articles, mine, "read", True, at(NOW)).select("article_id", "read", "updated_at")


@query("manual_edit", "SELECT article_id, CASE WHEN article_id % 50 = 0 THEN 'Edited' ELSE name END AS name, article_id % 50 = 0 OR article_id % 7 = 0 AS unhashed FROM articles")
def manual_edit(c: Catalog) -> DataFrame:
    rows = c.articles.select("article_id", "name", "updated_at", F.when(F.col("article_id") % 7 != 0, F.sha2("name", 256)).alias("content_hash"))
    edits = c.articles.where("article_id % 50 = 0").select("article_id", F.lit("Edited").alias("name"))
    return merge.edit(rows, edits, at(NOW)).select("article_id", "name", F.col("content_hash").isNull().alias("unhashed"))


@query("sparse_update", """
    SELECT feed_id, CASE WHEN feed_id % 3 = 0 THEN 'New ' || feed_id ELSE name END AS name, CASE WHEN feed_id % 4 = 0 THEN NULL ELSE aggregator END AS aggregator FROM feeds""")
def sparse_update(c: Catalog) -> DataFrame:
    k = F.col("feed_id")
    changes = c.feeds.select("feed_id", F.when(k % 3 == 0, F.concat(F.lit("New "), k.cast("string"))).alias("name"), F.when(k % 4 == 0, F.lit("")).alias("aggregator"))
    return merge.patch(c.feeds.select("feed_id", "name", "aggregator"), changes, "feed_id")


@query("tag_clash", """
    SELECT min_by(r_name, r_regionkey) AS name FROM (SELECT upper(c_mktsegment) AS r_name, c_custkey AS r_regionkey FROM customer UNION ALL SELECT n_name, n_nationkey FROM nation)
    WHERE lower(r_name) NOT IN (SELECT lower(p_brand) FROM part) AND lower(r_name) NOT IN ('building', 'france') GROUP BY lower(r_name)""", views=False)
def tag_clash(c: Catalog) -> DataFrame:
    wanted = c.table("customer").select(F.upper("c_mktsegment").alias("name"), F.col("c_custkey").alias("position")).unionByName(c.table("nation").select(F.col("n_name").alias("name"), F.col("n_nationkey").cast("long").alias("position")))
    existing = c.tags.select("name").union(c.spark.createDataFrame([("Building",), ("FRANCE",)], "name string"))
    return merge.new_names(existing, wanted)


@query("reading_position", "SELECT user_id, max(ts) AS ts, arg_max(event_id, (ts, event_id)) AS event_id FROM events GROUP BY user_id", views=False)
def reading_position(c: Catalog) -> DataFrame:
    return merge.last_writer(c.table("events").select("user_id", "ts", "event_id"), "user_id", "ts")


@query("unique_blobs", "SELECT sha256(text) AS hash, octet_length(encode(text)) AS byte_size FROM documents WHERE text IS NOT NULL AND NOT (doc_id % 10 = 1) GROUP BY ALL", views=False)
def unique_blobs(c: Catalog) -> DataFrame:
    side = F.when(F.col("doc_id") % 10 == 1, 1).otherwise(20)
    blobs = c.table("documents").where("text is not null").select(F.encode("text", "UTF-8").alias("data"), side.alias("width"), side.alias("height"))
    return merge.unique_blobs(blobs)[0].select("hash", "byte_size")


@query("stop_or_delete", "SELECT job_id, CASE WHEN status IN ('running', 'cancelling') THEN 'stopping' ELSE 'deleted' END AS outcome FROM jobs WHERE user_id = 7")
def stop_or_delete(c: Catalog) -> DataFrame:
    return merge.stop_or_delete(c.jobs, c.jobs.where(F.col("user_id") == OWNER).select("job_id")).select("job_id", "outcome")


@query("job_fan_out", "SELECT user_id, 'update' AS kind, '{\"feed_id\":' || feed_id || '}' AS payload, 'pending' AS status, 10 AS priority FROM mine")
def job_fan_out(c: Catalog) -> DataFrame:
    return merge.fan_out(c.feeds.where(F.col("user_id") == OWNER), "feed_id", "update", at(NOW), 10).drop("run_at")


# --- delta feed: the marks lie in the middle of the data, on ties

CURSOR = Cursor(Mark(852_076_800, 500), Mark(852_076_800, 500), Mark(852_076_800, 500))  # 1997-01-01


def _changes(c: Catalog) -> sync.Changes:
    log = c.articles.where("article_id % 11 = 0").join(c.feeds.select("feed_id", "user_id"), "feed_id").select("article_id", "user_id", F.col("created_at").alias("deleted_at"))
    return sync.changes(c.articles, log, OWNER, c.feeds, CURSOR, 300)


SYNCED = """
    , own AS (SELECT article_id, feed_id, created_at, updated_at FROM articles WHERE feed_id IN (SELECT feed_id FROM mine)),
    n AS (SELECT * FROM own WHERE (created_at, article_id) > (TIMESTAMP '1997-01-01', 500) ORDER BY created_at, article_id LIMIT 300),
    u AS (SELECT * FROM own WHERE (updated_at, article_id) > (TIMESTAMP '1997-01-01', 500) ORDER BY updated_at, article_id LIMIT 300)"""


@query("sync_new", SYNCED + "SELECT article_id, created_at FROM n")
def sync_new(c: Catalog) -> DataFrame:
    return _changes(c).new.select("article_id", "created_at")


@query("sync_updated_minus_new", SYNCED + "SELECT article_id, updated_at FROM u WHERE article_id NOT IN (SELECT article_id FROM n)")
def sync_updated_minus_new(c: Catalog) -> DataFrame:
    return _changes(c).updated.select("article_id", "updated_at")


@query("sync_removed", """
    SELECT article_id, created_at AS deleted_at FROM articles WHERE article_id % 11 = 0 AND feed_id IN (SELECT feed_id FROM mine) AND (created_at, article_id) > (TIMESTAMP '1997-01-01', 500) ORDER BY created_at, article_id LIMIT 300""")
def sync_removed(c: Catalog) -> DataFrame:
    return _changes(c).removed


# --- control plane


@query("claim_order", "SELECT job_id, 'running' AS status, attempts + 1 AS attempts FROM jobs WHERE status = 'pending' AND run_at <= TIMESTAMP '2024-01-20' ORDER BY priority DESC, run_at, job_id LIMIT 40")
def claim_order(c: Catalog) -> DataFrame:
    return control.claim(c.jobs, at("2024-01-20 00:00:00"), 40).select("job_id", "status", "attempts")


@query("job_retry_schedule", """
    SELECT job_id, CASE WHEN attempts < max_attempts THEN 'pending' ELSE 'failed' END AS status,
           CASE WHEN attempts < max_attempts THEN TIMESTAMP '2024-02-01' + to_minutes(CAST(2 ** greatest(attempts - 1, 0) AS BIGINT)) ELSE run_at END AS run_at FROM jobs WHERE status = 'failed'""")
def job_retry_schedule(c: Catalog) -> DataFrame:
    return control.after_failure(c.jobs.where("status = 'failed'"), at("2024-02-01 00:00:00")).select("job_id", "status", "run_at")


@query("job_cancel", "SELECT job_id, CASE status WHEN 'pending' THEN 'cancelled' WHEN 'running' THEN 'cancelling' ELSE status END AS status FROM jobs")
def job_cancel(c: Catalog) -> DataFrame:
    return control.after_cancel(c.jobs).select("job_id", "status")


@query("job_orphans", """
    SELECT job_id, CASE WHEN status = 'running' AND run_at < TIMESTAMP '2024-01-15' THEN CASE WHEN attempts >= max_attempts THEN 'failed' ELSE 'pending' END ELSE status END AS status FROM jobs""")
def job_orphans(c: Catalog) -> DataFrame:
    return control.reset_orphans(c.jobs, at("2024-01-15 00:00:00")).select("job_id", "status")


@query("run_status", """
    , n AS (SELECT r.i AS run_id, count(job_id) AS total_jobs, count(*) FILTER (WHERE status = 'completed') AS completed_jobs, count(*) FILTER (WHERE status IN ('failed', 'cancelled')) AS failed_jobs
            FROM range(0, 60) r(i) LEFT JOIN (SELECT * FROM jobs WHERE run_id % 5 <> 0 OR status IN ('completed', 'failed')) j ON j.run_id = r.i GROUP BY r.i)
    SELECT *, CASE WHEN completed_jobs + failed_jobs < total_jobs THEN 'running' WHEN failed_jobs > 0 THEN 'failed' ELSE 'completed' END AS status FROM n""")
def run_status(c: Catalog) -> DataFrame:
    return control.run_status(c.jobs.where("run_id % 5 <> 0 or status in ('completed', 'failed')"), c.spark.range(60).withColumnRenamed("id", "run_id"))


@query("scheduler_due", """
    , w AS (SELECT DISTINCT job_id % 1000 AS feed_id FROM jobs WHERE status IN ('pending', 'running') AND kind = 'aggregate')
    SELECT feed_id FROM feeds WHERE enabled AND interval_minutes > 0 AND 12000 - feed_id % 300 * 60 >= interval_minutes * 60 AND feed_id NOT IN (SELECT feed_id FROM w)""")
def scheduler_due(c: Catalog) -> DataFrame:
    now = at("2024-02-01 03:20:00")
    feeds = c.feeds.withColumn("updated_at", at("2024-02-01 00:00:00") + F.make_dt_interval(mins=(F.col("feed_id") % 300).cast("int")))
    return control.due_feeds(feeds, c.jobs.withColumn("feed_id", F.col("job_id") % 1000), now).select("feed_id")


@query("usage_outcome", """
    WITH d AS (SELECT *, CASE WHEN row_number() OVER (PARTITION BY user_id, date_trunc('day', ts) ORDER BY ts, event_id) <= 2 THEN 1 ELSE 0 END AS fits FROM events),
    m AS (SELECT *, coalesce(sum(fits) OVER (PARTITION BY user_id, date_trunc('month', ts) ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS used FROM d)
    SELECT event_id AS request_id, user_id, CASE WHEN used >= 25 THEN 'month_limit' WHEN fits = 0 THEN 'day_limit' ELSE 'allowed' END AS outcome FROM m""", views=False)
def usage_outcome(c: Catalog) -> DataFrame:
    return control.metered(c.requests, 2, 25).select("request_id", "user_id", "outcome")


@query("usage_windows", """
    SELECT user_id, count(*) AS this_month, count(*) FILTER (WHERE date_trunc('day', ts) = TIMESTAMP '2024-01-17') AS today FROM events WHERE date_trunc('month', ts) = TIMESTAMP '2024-01-01' GROUP BY user_id""", views=False)
def usage_windows(c: Catalog) -> DataFrame:
    return control.usage(c.requests, at("2024-01-17 12:00:00"))


@query("collected_today", "SELECT o_custkey AS feed_id, count(*) AS collected FROM orders WHERE o_orderdate >= TIMESTAMP '1997-03-03' AND o_orderdate <= TIMESTAMP '1997-03-03 15:00:00' GROUP BY 1", views=False)
def collected_today(c: Catalog) -> DataFrame:
    return control.collected_today(c.articles, at("1997-03-03 15:00:00"))


@query("progress_changes", """
    , p AS (SELECT user_id, event_id, event_type, lag(event_type) OVER (PARTITION BY user_id ORDER BY event_id) AS b FROM events)
    SELECT user_id, event_id, event_type FROM p WHERE b IS DISTINCT FROM event_type""")
def progress_changes(c: Catalog) -> DataFrame:
    return control.changes_only(c.table("events").select("user_id", "event_id", "event_type"), "user_id", "event_id", "event_type")


@query("log_tail", "SELECT event_id AS id, event_id % 20 AS job_id, event_type AS line FROM events WHERE event_id % 20 = 3 AND event_id > 500 ORDER BY id", views=False)
def log_tail(c: Catalog) -> DataFrame:
    lines = c.table("events").select(F.col("event_id").alias("id"), (F.col("event_id") % 20).alias("job_id"), F.col("event_type").alias("line"))
    return control.log_tail(lines, 3, 500)


@query("run_limit", """
    , x AS (SELECT feed_id, daily_limit AS l, feed_id % 37 AS c, feed_id * 7919 % 86400 AS s FROM feeds),
    y AS (SELECT *, greatest(greatest(1, floor(l / 48.0)), greatest(ceil(l * s / 86400.0) - c, 0), floor((l - c) * 0.2)) AS w FROM x)
    SELECT feed_id, CAST(CASE WHEN c >= l THEN 0 ELSE least(CASE WHEN s < 36000 THEN greatest(w, floor((l - c) * 0.4)) ELSE w END, l - c) END AS BIGINT) AS run_limit FROM y""")
def run_limit(c: Catalog) -> DataFrame:
    k = F.col("feed_id")
    return c.feeds.select("feed_id", control.run_limit(F.col("daily_limit"), k % 37, k * 7919 % 86_400).alias("run_limit"))


#: Hours around clock changes of two hemispheres, and zones, by a feed's number.
_ZONES = ("UTC", "Europe/Berlin", "America/New_York", "Australia/Sydney")
_ZONED = """
    z AS (SELECT c_custkey AS feed_id, ['UTC', 'Europe/Berlin', 'America/New_York', 'Australia/Sydney'][CAST(c_custkey % 4 + 1 AS BIGINT)] AS zone, TIMESTAMP '1997-03-29 00:00:00' + to_hours(CAST(c_custkey % 53 AS BIGINT)) + to_days(CAST(c_custkey % 3 * 210 AS INTEGER)) AS now FROM customer),
    d AS (SELECT *, timezone('UTC', timezone(zone, date_trunc('day', timezone(zone, timezone('UTC', now))))) AS since FROM z)"""


def _zoned(c: Catalog) -> DataFrame:
    k = F.col("c_custkey")
    now = at("1997-03-29 00:00:00") + F.make_dt_interval(days=(k % 3 * 210).cast("int"), hours=(k % 53).cast("int"))
    return c.table("customer").select(k.alias("feed_id"), F.element_at(F.array(*[F.lit(z) for z in _ZONES]), (k % 4 + 1).cast("int")).alias("zone"), now.cast("timestamp_ntz").alias("now"))


@query("collected_local", f"""
    WITH {_ZONED}, a AS (SELECT o_custkey % 300 AS feed_id, TIMESTAMP '1997-03-28 00:00:00' + to_hours(CAST(o_orderkey % 100 AS BIGINT)) + to_days(CAST(o_orderkey % 3 * 210 AS INTEGER)) AS created_at FROM orders)
    SELECT feed_id, count(*) AS collected FROM a JOIN d USING (feed_id) WHERE created_at >= since AND created_at <= now GROUP BY feed_id""", views=False)
def collected_local(c: Catalog) -> DataFrame:
    """Articles of each feed's own day, at hours around changes of the clock."""
    k = F.col("o_orderkey")
    made = at("1997-03-28 00:00:00") + F.make_dt_interval(days=(k % 3 * 210).cast("int"), hours=(k % 100).cast("int"))
    articles = c.table("orders").select((F.col("o_custkey") % 300).alias("feed_id"), made.cast("timestamp_ntz").alias("created_at"))
    return control.collected_today(articles, F.col("now"), _zoned(c))


@query("run_limit_local", f"""
    WITH {_ZONED}, x AS (SELECT feed_id, feed_id % 100 AS l, feed_id % 37 AS c, epoch(now) - epoch(since) AS s FROM d),
    y AS (SELECT *, greatest(greatest(1, floor(l / 48.0)), greatest(ceil(l * s / 86400.0) - c, 0), floor((l - c) * 0.2)) AS w FROM x)
    SELECT feed_id, CAST(s AS BIGINT) AS seconds, CAST(CASE WHEN c >= l THEN 0 ELSE least(CASE WHEN s < 36000 THEN greatest(w, floor((l - c) * 0.4)) ELSE w END, l - c) END AS BIGINT) AS run_limit FROM y""", views=False)
def run_limit_local(c: Catalog) -> DataFrame:
    k = F.col("feed_id")
    rows = _zoned(c).withColumn("seconds", control.seconds_of_day(F.col("now"), F.col("zone")))
    return rows.select("feed_id", "seconds", control.run_limit(k % 100, k % 37, F.col("seconds")).alias("run_limit"))


@query("debounced_batches", """
    WITH RECURSIVE t AS (SELECT user_id, CAST(floor(epoch(ts)) AS BIGINT) AS s, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events),
    w AS (SELECT user_id, i, s, s AS opened FROM t WHERE i = 1 UNION ALL SELECT t.user_id, t.i, t.s, CASE WHEN t.s < w.opened + 86400 THEN w.opened ELSE t.s END FROM w JOIN t ON t.user_id = w.user_id AND t.i = w.i + 1)
    SELECT user_id, opened, count(*) AS events FROM w GROUP BY user_id, opened""", views=False)
def debounced_batches(c: Catalog) -> DataFrame:
    return control.debounce(c.table("events").select("user_id", "ts"), "user_id", "ts", 86_400).select("user_id", F.unix_seconds("opened").alias("opened"), "events")

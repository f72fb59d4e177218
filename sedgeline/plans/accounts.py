"""Queries over sessions, settings and writes that are made from the test tables, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sedgeline.catalog import Catalog
from sedgeline.functions import text
from sedgeline.operators import accounts, merge
from sedgeline.plans.relational import NOW, query

SESSIONS = "SELECT event_id AS session_id, user_id % 30 AS user_id, CASE WHEN event_id % 3 <> 0 THEN 'device ' || event_id END AS device_name, ts AS created_at, ts + INTERVAL 7 DAY AS expires_at FROM events"
THEN = "2024-01-20 00:00:00"


def now(value: str = THEN):
    return F.lit(value).cast("timestamp_ntz")


def sessions(c: Catalog) -> DataFrame:
    k = F.col("event_id")
    return c.table("events").select(k.alias("session_id"), (F.col("user_id") % 30).alias("user_id"), F.when(k % 3 != 0, F.concat(F.lit("device "), k.cast("string"))).alias("device_name"), F.col("ts").alias("created_at"), (F.col("ts") + F.make_dt_interval(days=F.lit(7))).alias("expires_at"))


@query("live_devices", f"SELECT session_id, user_id FROM ({SESSIONS}) WHERE device_name IS NOT NULL AND expires_at > TIMESTAMP '{THEN}'", views=False)
def live_devices(c: Catalog) -> DataFrame:
    return accounts.live_devices(sessions(c), now()).select("session_id", "user_id")


@query("session_owners", f", s AS ({SESSIONS}) SELECT session_id, user_id, name FROM s JOIN users USING (user_id) WHERE expires_at > TIMESTAMP '{THEN}'")
def session_owners(c: Catalog) -> DataFrame:
    return accounts.session_owners(sessions(c), c.users, now()).select("session_id", "user_id", "name")


@query("usable_credentials", "SELECT c_custkey FROM customer WHERE c_custkey % 3 = 0 AND c_custkey % 4 <> 0", views=False)
def usable_credentials(c: Catalog) -> DataFrame:
    k = F.col("c_custkey")
    rows = c.table("customer").select(k, F.when(k % 3 == 0, "credential").otherwise("other").alias("provider"), F.when(k % 4 != 0, "x").alias("password"))
    return accounts.usable_credentials(rows).select("c_custkey")


@query("recipients", "SELECT user_id, name || '@h' AS email, CASE WHEN user_id % 3 = 0 THEN 'de' ELSE 'en' END AS locale FROM users WHERE list_contains(string_split(role, ','), 'admin')")
def recipients(c: Catalog) -> DataFrame:
    k = F.col("user_id")
    settings = c.users.where(k % 2 == 0).select("user_id", F.when(k % 3 == 0, "de").when(k % 3 == 1, "fr").alias("language")).unionByName(c.users.where(k % 6 == 3).select("user_id", F.lit("de").alias("language")))
    return accounts.recipients(c.users.withColumn("email", F.concat("name", F.lit("@h"))), settings, ["de", "en"], "en", "admin")


@query("settings_shown", """
    SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 AND c_custkey % 2 = 0 THEN 'one' WHEN c_custkey % 3 = 1 AND c_custkey % 5 = 0 THEN 'two' ELSE '' END AS active,
           CASE WHEN c_custkey % 4 = 0 THEN NULL WHEN c_custkey % 4 = 1 THEN '••••••••' ELSE '••••••••' || right(c_name, 4) END AS secret FROM customer""", views=False)
def settings_shown(c: Catalog) -> DataFrame:
    k = F.col("c_custkey")
    stored = F.when(k % 3 == 0, "one").when(k % 3 == 1, "two").otherwise("gone")
    secret = F.when(k % 4 == 0, F.lit(None)).when(k % 4 == 1, F.right("c_name", F.lit(8))).otherwise(F.col("c_name"))
    return c.table("customer").select("c_custkey", accounts.active_provider(stored, {"one": k % 2 == 0, "two": k % 5 == 0}).alias("active"), accounts.masked(secret).alias("secret"))


@query("users_admitted", """
    SELECT c_custkey AS position, upper(left(c_name, 1)) || substr(c_name, 2) || '@' || c_custkey % 1000 || '.H' AS email,
           CASE WHEN c_custkey % 7 = 0 OR c_custkey >= 1000 AND lower(c_name || '@' || c_custkey % 1000 || '.H') IN (SELECT lower(c_name || '@' || c_custkey % 1000 || '.H') FROM customer o WHERE o.c_custkey < customer.c_custkey) THEN 'taken' ELSE 'created' END AS outcome FROM customer""", views=False)
def users_admitted(c: Catalog) -> DataFrame:
    k = F.col("c_custkey")
    email = F.concat("c_name", F.lit("@"), (k % 1000).cast("string"), F.lit(".H"))
    rows = c.table("customer").select(k.alias("position"), email.alias("email"))
    return accounts.admitted(rows.where("position % 7 = 0").select(F.upper("email").alias("email")), rows)


@query("addresses_changed", "SELECT c_custkey AS user_id, CASE WHEN c_custkey % 4 = 1 THEN 'new' || c_custkey ELSE c_name END AS email FROM customer", views=False)
def addresses_changed(c: Catalog) -> DataFrame:
    users = c.table("customer").select(F.col("c_custkey").alias("user_id"), F.col("c_name").alias("email"))
    k = F.col("user_id")
    wish = F.when(k % 4 == 1, F.concat(F.lit("new"), k.cast("string"))).when(k % 4 == 2, F.upper(F.regexp_replace("email", "[0-9]{9}$", F.lpad((k - 1).cast("string"), 9, "0"))))
    return accounts.changed_addresses(users, users.select("user_id", wish.alias("email")).where("email is not null"))


ITEMS = "SELECT o_orderkey AS article_id, 'Article ' || o_orderkey AS name, 'raw' AS raw_content, 'old' AS plain_text, md5('x') AS content_hash, o_orderdate AS updated_at FROM orders"


@query("reload_articles", f"""
    SELECT article_id, CASE WHEN article_id % 5 = 0 THEN 'New ' || article_id ELSE name END AS name, CASE WHEN article_id % 5 IN (0, 1) THEN 'fresh' ELSE raw_content END AS raw_content,
           CASE article_id % 5 WHEN 0 THEN 'text' WHEN 1 THEN 'text' WHEN 2 THEN 'This article could not be reloaded: gone' ELSE plain_text END AS plain_text,
           CASE WHEN article_id % 5 > 2 THEN content_hash END AS content_hash, CASE WHEN article_id % 5 > 2 THEN updated_at ELSE TIMESTAMP '{NOW}' END AS updated_at FROM ({ITEMS})""", views=False)
def reload_articles(c: Catalog) -> DataFrame:
    rows = c.articles.select("article_id", "name", F.lit("raw").alias("raw_content"), F.lit("old").alias("plain_text"), F.md5(F.lit("x")).alias("content_hash"), F.col("created_at").alias("updated_at"))
    k = F.col("article_id")
    ok = k % 5 < 2
    fetched = rows.where(k % 5 <= 2).select("article_id", F.when(k % 5 == 0, F.concat(F.lit("New "), k.cast("string"))).otherwise("").alias("name"), F.when(ok, "fresh").alias("raw_content"), F.when(ok, "text").alias("plain_text"), F.when(~ok, "gone").alias("error"))
    return merge.reloaded(rows, fetched, now(NOW))


@query("restore_feeds", """
    SELECT 'left' AS part, count(*) AS rows FROM articles WHERE feed_id % 10 <> 0 OR feed_id IS NULL UNION ALL SELECT 'tombstones', count(*) FROM articles JOIN feeds USING (feed_id) WHERE feed_id % 10 = 0 UNION ALL SELECT 'jobs', count(*) FROM feeds WHERE feed_id % 10 = 0""")
def restore_feeds(c: Catalog) -> DataFrame:
    parts = merge.restored(c.articles, c.feeds, c.feeds.where("feed_id % 10 = 0").select("feed_id"), now(NOW))
    counts = [p.agg(F.count(F.lit(1)).alias("rows")).select(F.lit(name).alias("part"), "rows") for name, p in zip(("left", "tombstones", "jobs"), parts, strict=True)]
    return counts[0].unionByName(counts[1]).unionByName(counts[2])


@query("create_feeds", """
    , w AS (SELECT feed_id AS position, user_id, name, [feed_id % 30, feed_id % 30, feed_id % 7] AS tag_ids FROM feeds), p AS (SELECT DISTINCT 1000000 + position AS feed_id, user_id, unnest(tag_ids) AS tag_id FROM w)
    SELECT 1000000 + position AS feed_id, user_id, name, (SELECT coalesce(string_agg(tag_id, ',' ORDER BY tag_id), '') FROM p WHERE p.feed_id = 1000000 + position AND p.user_id = tag_id) AS tags, '{"feed_id":' || 1000000 + position || '}' AS payload FROM w""")
def create_feeds(c: Catalog) -> DataFrame:
    k = F.col("feed_id")
    wanted = c.feeds.select(k.alias("position"), "user_id", "name", F.array(k % 30, k % 30, k % 7).alias("tag_ids"))
    tags = c.users.select(F.col("user_id").cast("long").alias("tag_id"), "user_id")  # tag n belongs to owner n
    feeds, pairs, jobs = merge.created_feeds(wanted, tags, now(NOW), 1_000_000)
    of = pairs.groupBy("feed_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list("tag_id")), lambda t: t.cast("string")), ",").alias("tags"))  # of one feed
    jobs = jobs.select(F.get_json_object("payload", "$.feed_id").cast("long").alias("feed_id"), "payload")
    return feeds.join(of, "feed_id", "left").join(jobs, "feed_id").select("feed_id", "user_id", "name", F.coalesce("tags", F.lit("")).alias("tags"), "payload")


@query("retag_feeds", "SELECT feed_id, tag_id FROM feed_tags WHERE feed_id % 3 = 0 UNION ALL SELECT feed_id, 'Brand#11' FROM feeds WHERE feed_id % 3 = 2")
def retag_feeds(c: Catalog) -> DataFrame:
    k = F.col("feed_id")
    empty = F.array().cast("array<string>")
    changes = c.feeds.select("feed_id", "user_id", F.when(k % 3 == 1, empty).when(k % 3 == 2, F.array(F.lit("Brand#11"), F.lit("Brand#11"), F.lit("nobody's"))).alias("tag_ids"))
    return merge.retagged(c.feed_tags, changes, c.users.select(F.lit("Brand#11").alias("tag_id"), "user_id"))


@query("tags_for_import", """
    SELECT user_id, low AS name, CASE WHEN low = 'had' THEN user_id ELSE 99 + row_number() OVER (PARTITION BY low = 'had' ORDER BY user_id, low) END AS tag_id
    FROM (SELECT DISTINCT c_nationkey AS user_id, CASE c_custkey % 3 WHEN 0 THEN 'had' ELSE lower(c_mktsegment) END AS low FROM customer)""", views=False)
def tags_for_import(c: Catalog) -> DataFrame:
    k = F.col("c_custkey")
    names = c.table("customer").select(F.col("c_nationkey").alias("user_id"), F.when(k % 3 == 0, "HAD").when(k % 3 == 1, F.col("c_mktsegment")).otherwise(F.lower("c_mktsegment")).alias("name"))
    return merge.tags_for(names, c.users.select("user_id", F.lit("Had").alias("name"), F.col("user_id").cast("long").alias("tag_id")), 100)[0]


@query("append_lines", """
    WITH l AS (SELECT conv_id AS job_id, turn AS position, text AS line FROM conversations), last AS (SELECT job_id, max(position) AS last FROM l WHERE position < 1 GROUP BY job_id)
    SELECT * FROM l WHERE position < 1 UNION ALL SELECT job_id, coalesce(last, -1) + row_number() OVER (PARTITION BY job_id ORDER BY position), line FROM l LEFT JOIN last USING (job_id) WHERE position >= 1""", views=False)
def append_lines(c: Catalog) -> DataFrame:
    rows = c.table("conversations").select(F.col("conv_id").alias("job_id"), F.col("turn").alias("position"), F.col("text").alias("line"))
    return merge.appended_lines(rows.where("position < 1"), rows.where("position >= 1"))


@query("logo_references", "SELECT feed_id, CASE WHEN feed_id % 6 = 0 THEN 'new' || feed_id ELSE 'old' END AS logo FROM feeds")
def logo_references(c: Catalog) -> DataFrame:
    k = F.col("feed_id")
    logos = c.feeds.where(k % 2 == 0).select("feed_id", F.concat(F.lit("new"), k.cast("string")).alias("hash"))
    stored = c.feeds.where(k % 3 == 0).select(F.concat(F.lit("new"), k.cast("string")).alias("hash"))
    return merge.with_logos(c.feeds.select("feed_id", F.lit("old").alias("logo")), logos, stored)


@query("wire_summaries", """
    SELECT article_id, '{"id":' || article_id || ',"feedId":' || feed_id || ',"name":"' || name || '","date":"' || strftime(date, '%Y-%m-%dT%H:%M:%S') || '.000Z","read":' || read || ',"starred":' || starred || '}' AS wire FROM articles""")
def wire_summaries(c: Catalog) -> DataFrame:
    row = F.struct(F.col("article_id").alias("id"), F.col("feed_id").alias("feedId"), "name", text.iso_millis(F.col("date")).alias("date"), "read", "starred")
    return c.articles.select("article_id", F.to_json(row).alias("wire"))


@query("wire_feeds", """
    SELECT f.feed_id, '{"id":' || f.feed_id || ',"name":"' || f.name || '","aggregator":"' || f.aggregator || '","enabled":' || f.enabled || ',"dailyLimit":' || f.daily_limit || ',"tagIds":[' ||
           coalesce((SELECT string_agg('"' || tag_id || '"', ',' ORDER BY tag_id) FROM feed_tags t WHERE t.feed_id = f.feed_id), '') || ']}' AS wire FROM feeds f""")
def wire_feeds(c: Catalog) -> DataFrame:
    tags = c.feed_tags.groupBy("feed_id").agg(F.array_sort(F.collect_set("tag_id")).alias("tags"))  # of one feed
    row = F.struct(F.col("feed_id").alias("id"), "name", "aggregator", "enabled", F.col("daily_limit").alias("dailyLimit"), F.coalesce("tags", F.array().cast("array<string>")).alias("tagIds"))
    return c.feeds.join(tags, "feed_id", "left").select("feed_id", F.to_json(row).alias("wire"))


@query("wire_tags", """
    SELECT p_partkey AS tag_id, '{"id":' || p_partkey || ',"name":"' || p_brand || '","color":' || CASE WHEN p_partkey % 3 = 0 THEN 'null' ELSE '"#' || p_partkey % 10 || '0"' END || '}' AS wire FROM part""", views=False)
def wire_tags(c: Catalog) -> DataFrame:
    k = F.col("p_partkey")
    color = F.when(k % 3 != 0, F.concat(F.lit("#"), (k % 10).cast("string"), F.lit("0")))
    return c.table("part").select(k.alias("tag_id"), accounts.wire_tag(k, F.col("p_brand"), color).alias("wire"))


@query("wire_positions", """
    SELECT c_custkey AS user_id, CASE WHEN a IS NULL THEN '{"articleId":null,"updatedAt":null}' ELSE '{"articleId":' || a || ',"updatedAt":"' || strftime(t, '%Y-%m-%dT%H:%M:%S') || '.000Z"}' END AS wire
    FROM customer LEFT JOIN (SELECT o_custkey, max(o_orderkey) AS a, max(o_orderdate) AS t FROM orders GROUP BY 1) ON o_custkey = c_custkey""", views=False)
def wire_positions(c: Catalog) -> DataFrame:
    """A reader's position: their last order, null for those without any."""
    last = c.table("orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.max("o_orderkey").alias("a"), F.max("o_orderdate").alias("t"))
    return c.table("customer").select("c_custkey").join(last, "c_custkey", "left").select(F.col("c_custkey").alias("user_id"), accounts.wire_position(F.col("a"), F.col("t")).alias("wire"))


@query("list_addresses", """
    SELECT c_custkey AS id, concat_ws('&', CASE WHEN c_custkey % 3 = 0 THEN 'q=' || replace(replace(c_name, '#', '%23'), ' ', '+') || '+%26+%C3%A9' END, CASE WHEN c_custkey % 5 > 1 AND c_custkey % 7 <> 0 THEN 'page=' || c_custkey % 5 END, CASE WHEN c_custkey % 2 = 0 THEN 'pageSize=50' END, CASE WHEN c_custkey % 4 = 1 THEN 'sort=name' END,
        CASE WHEN c_custkey % 4 = 3 THEN 'dir=asc' END, CASE WHEN c_custkey % 7 = 0 THEN 'feed=' || c_nationkey END) AS address FROM customer""", views=False)
def list_addresses(c: Catalog) -> DataFrame:
    """Addresses of lists; those that a feed narrows begin with the first page again."""
    k = F.col("c_custkey")
    found = accounts.list_address(
        F.when(k % 3 == 0, F.concat(F.lit(" "), "c_name", F.lit(" & é "))), k % 5, F.when(k % 2 == 0, 50).otherwise(25), F.when(k % 4 == 1, "name"), k % 4 != 3, {"feed": F.when(k % 7 == 0, F.col("c_nationkey").cast("string"))}, k % 7 == 0
    )
    return c.table("customer").select(k.alias("id"), found.alias("address"))


@query("fn_options", """
    SELECT event_id, CASE WHEN event_id % 3 = 0 THEN props END AS options, CAST(CASE WHEN event_id % 3 = 0 THEN props->>'$.k' ELSE '5' END AS VARCHAR) AS k, CASE WHEN event_id % 2 = 0 THEN 'yes' END AS gated FROM events""", views=False)
def fn_options(c: Catalog) -> DataFrame:
    e = F.col("event_id")
    coded = F.when(e % 3 == 0, F.base64(F.col("props").cast("binary"))).when(e % 3 == 1, F.base64(F.lit("[1]").cast("binary"))).otherwise("%%%")
    raw = text.options_from_base64(coded)
    read = text.options(raw, {"k": F.lit(5), "gated": F.lit("yes")}, {"gated": e % 2 == 0})
    return c.table("events").select("event_id", raw.alias("options"), read["k"].alias("k"), read["gated"].alias("gated"))


@query("fn_image_refs", "SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN '' WHEN doc_id % 3 = 1 THEN sha256(text) ELSE sha256(text) || ' ' || sha256(source) END AS refs FROM documents", views=False)
def fn_image_refs(c: Catalog) -> DataFrame:
    k, one, two = F.col("doc_id"), F.concat(F.lit("<img src='image://"), F.sha2("text", 256), F.lit("'>")), F.concat(F.lit("image://"), F.sha2("source", 256))
    body = F.when(k % 3 == 0, "image://abc and nothing").when(k % 3 == 1, F.concat(one, one)).otherwise(F.concat(one, F.lit(" "), two, one))
    return c.table("documents").select("doc_id", F.array_join(text.image_refs(body), " ").alias("refs"))


@query("fn_decode", "SELECT c_custkey, CASE c_custkey % 5 WHEN 4 THEN '€ü “' || c_name ELSE 'ü' || c_name END AS body FROM customer", views=False)
def fn_decode(c: Catalog) -> DataFrame:
    k, t = F.col("c_custkey"), F.concat(F.lit("ü"), "c_name")
    western = F.concat(F.unhex(F.lit("80FC2093")), F.col("c_name").cast("binary"))  # the euro sign and a quote by windows-1252
    body = F.when(k % 5 == 0, F.encode(t, "UTF-8")).when(k % 5 == 1, F.encode(t, "UTF-16")).when(k % 5 == 2, F.encode(t, "ISO-8859-1")).when(k % 5 == 3, F.encode(t, "UTF-8")).otherwise(western)
    charset = F.when(k % 5 == 1, "UTF-16").when(k % 5 == 3, "iso-8859-1").when(k % 5 == 4, " Windows-1252 ")
    return c.table("customer").select("c_custkey", text.decode_text(body, charset).alias("body"))


@query("fn_selector_list", "SELECT p_partkey, 'a|' || p_brand || '|b c' AS parts FROM part", views=False)
def fn_selector_list(c: Catalog) -> DataFrame:
    raw = F.concat(F.lit(" a ,"), "p_brand", F.lit("\n\n, b c ,"))
    return c.table("part").select("p_partkey", F.array_join(text.selector_list(raw), "|").alias("parts"))

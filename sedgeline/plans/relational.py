"""Queries of the relational operators, with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sedgeline import schema
from sedgeline.catalog import Catalog
from sedgeline.operators import lists
from sedgeline.params import parse

OWNER = 7
NOW = "1998-01-01 00:00:00"
Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}

#: The logical relations in SQL, as the catalog maps them.
VIEWS = """
    users AS (SELECT n_nationkey AS user_id, n_name AS name, n_regionkey AS region,
                     CASE n_nationkey % 5 WHEN 0 THEN 'admin' WHEN 1 THEN 'user,admin' WHEN 2 THEN 'administrator' ELSE 'user' END AS role,
                     n_nationkey % 4 = 0 AS banned, CASE WHEN n_nationkey % 8 = 0 THEN TIMESTAMP '1995-06-01' END AS ban_expires FROM nation),
    feeds AS (SELECT c_custkey AS feed_id, c_nationkey AS user_id, c_name AS name, lower(c_mktsegment) AS aggregator, c_acctbal >= 0 AS enabled,
                     c_custkey % 6 * 30 AS interval_minutes, c_custkey % 100 AS daily_limit FROM customer),
    articles AS (SELECT o_orderkey AS article_id, o_custkey AS feed_id, 'Article ' || o_orderkey AS name, 'urn:' || o_orderkey AS identifier, o_orderdate AS date,
                        o_orderstatus = 'F' AS read, o_orderpriority = '1-URGENT' AS starred, o_orderdate AS created_at,
                        o_orderdate + to_days(CAST(o_orderkey % 40 AS INTEGER)) AS updated_at FROM orders),
    feed_tags AS (SELECT DISTINCT o_custkey AS feed_id, p_brand AS tag_id FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey WHERE l_quantity > 45),
    jobs AS (SELECT event_id AS job_id, event_id % 50 AS run_id, CASE WHEN event_id % 7 <> 0 THEN user_id % 30 END AS user_id,
                    CASE event_id % 3 WHEN 0 THEN 'aggregate' WHEN 1 THEN 'retention' ELSE 'reload' END AS kind,
                    CASE event_type WHEN 'purchase' THEN 'completed' WHEN 'error' THEN 'failed' WHEN 'click' THEN 'running' WHEN 'signup' THEN 'cancelled' ELSE 'pending' END AS status,
                    CAST(event_id % 4 AS INTEGER) AS attempts, 3 AS max_attempts, ts AS run_at, CAST(event_id % 3 * 5 AS INTEGER) AS priority, props AS payload FROM events),
    comments AS (SELECT conv_id AS post_id, turn AS position, role AS author, text AS body, length(text) AS score FROM conversations),
    mine AS (SELECT * FROM feeds WHERE user_id = 7)"""


def query(name: str, sql: str | None = None, views: bool = True) -> Callable[[Callable[[Catalog], DataFrame]], Callable[[Catalog], DataFrame]]:
    """Register a query over the catalog; ``sql`` continues a WITH list of the relations above."""

    def add(f: Callable[[Catalog], DataFrame]) -> Callable[[Catalog], DataFrame]:
        QUERIES[name] = lambda spark, sf_dir: f(Catalog(spark, sf_dir))
        if sql:
            ORACLE_SQL[name] = f"WITH {VIEWS}{sql if sql.lstrip().startswith(',') else ' ' + sql}" if views else sql
        return f

    return add


@query("list_articles", """
    , hits AS (SELECT a.article_id, a.feed_id, a.name, a.date, a.read, a.starred, m.name AS feed_name FROM articles a JOIN mine m USING (feed_id) WHERE NOT a.read)
    SELECT *, (SELECT count(*) FROM hits) AS total FROM hits ORDER BY date DESC NULLS LAST, article_id DESC LIMIT 25""")
def list_articles(c: Catalog) -> DataFrame:
    return lists.article_page(c.articles, c.feeds, OWNER, parse({"read": "false"}))


@query("list_articles_third_page", """
    , hits AS (SELECT a.article_id, a.feed_id, a.name, a.date, a.read, a.starred, m.name AS feed_name FROM articles a JOIN mine m USING (feed_id) WHERE a.starred)
    SELECT *, (SELECT count(*) FROM hits) AS total FROM hits ORDER BY name ASC NULLS LAST, article_id DESC LIMIT 10 OFFSET 20""")
def list_articles_third_page(c: Catalog) -> DataFrame:
    return lists.article_page(c.articles, c.feeds, OWNER, parse({"starred": "true", "sort": "name", "dir": "asc", "page": "3", "pageSize": "10"}))


@query("list_articles_by_tag", """
    , hits AS (SELECT a.article_id, a.feed_id, a.name, a.date, a.read, a.starred, m.name AS feed_name FROM articles a JOIN mine m USING (feed_id)
               WHERE a.feed_id IN (SELECT feed_id FROM feed_tags WHERE tag_id IN ('Brand#11', 'Brand#23')) AND contains(lower(a.name), '1'))
    SELECT *, (SELECT count(*) FROM hits) AS total FROM hits ORDER BY date DESC NULLS LAST, article_id DESC LIMIT 50""")
def list_articles_by_tag(c: Catalog) -> DataFrame:
    return lists.article_page(c.articles, c.feeds, OWNER, parse({"tag": "Brand#11,Brand#23", "q": "1", "pageSize": "50"}), c.feed_tags)


@query("list_articles_total", "SELECT count(*) AS total FROM articles WHERE NOT read AND feed_id IN (SELECT feed_id FROM mine)")
def list_articles_total(c: Catalog) -> DataFrame:
    return lists.total(lists.article_filter(c.articles, c.feeds, OWNER, parse({"read": "false"})))


@query("page_and_total_window", """
    , hits AS (SELECT feed_id, name, count(*) OVER () AS total, row_number() OVER (ORDER BY name, feed_id) AS rank FROM mine)
    SELECT * FROM hits WHERE rank BETWEEN 26 AND 50""")
def page_and_total_window(c: Catalog) -> DataFrame:
    mine = c.feeds.where(F.col("user_id") == OWNER).select("feed_id", "name")
    return lists.page_with_total(mine, parse({"page": "2"}), [F.asc("name"), F.asc("feed_id")])


@query("recent_unread", "SELECT article_id, feed_id, name, date FROM articles WHERE NOT read AND feed_id IN (SELECT feed_id FROM mine) ORDER BY date DESC, article_id DESC LIMIT 6")
def recent_unread(c: Catalog) -> DataFrame:
    return lists.recent_unread(c.articles, c.feeds, OWNER)


@query("article_with_feed", "SELECT a.article_id, a.name, f.feed_id, f.name AS feed_name, f.user_id FROM articles a JOIN feeds f USING (feed_id) WHERE a.article_id = 100")
def article_with_feed(c: Catalog) -> DataFrame:
    feed = c.feeds.select("feed_id", F.struct("feed_id", "name", "user_id").alias("feed"))
    row = c.articles.where("article_id = 100").join(feed, "feed_id")
    return row.select("article_id", "name", "feed.feed_id", F.col("feed.name").alias("feed_name"), "feed.user_id")


@query("dashboard_stats", """
    , own AS (SELECT * FROM articles WHERE feed_id IN (SELECT feed_id FROM mine))
    SELECT (SELECT count(*) FROM own) AS articles, (SELECT count(*) FROM own WHERE NOT read) AS unread, (SELECT count(*) FROM mine) AS feeds,
           (SELECT count(*) FROM mine WHERE enabled) AS enabled_feeds, (SELECT count(DISTINCT tag_id) FROM feed_tags WHERE feed_id IN (SELECT feed_id FROM mine)) AS tags""")
def dashboard_stats(c: Catalog) -> DataFrame:
    return lists.dashboard(c.articles, c.feeds, c.feed_tags, OWNER)


@query("feeds_with_counts", """
    SELECT f.feed_id, f.name, (SELECT count(*) FROM articles a WHERE a.feed_id = f.feed_id) AS articles,
           coalesce((SELECT string_agg(tag_id, ',' ORDER BY tag_id) FROM feed_tags t WHERE t.feed_id = f.feed_id), '') AS tags FROM feeds f""")
def feeds_with_counts(c: Catalog) -> DataFrame:
    return lists.feeds_with_counts(c.feeds, c.articles, c.feed_tags).select("feed_id", "name", "articles", F.array_join("tags", ",").alias("tags"))


@query("feed_search", "SELECT feed_id, name FROM feeds WHERE contains(lower(name), '#00000001') ORDER BY name, feed_id LIMIT 25")
def feed_search(c: Catalog) -> DataFrame:
    p = parse({"q": "#00000001", "dir": "asc"})
    return lists.page(lists.ordered(c.feeds.where(lists.contains_text(["name"], p.q)).select("feed_id", "name"), p, {}, "name", "feed_id", False), p)


@query("tag_usage", "SELECT tag_id, count(*) AS feeds FROM feed_tags GROUP BY tag_id")
def tag_usage(c: Catalog) -> DataFrame:
    return lists.tag_usage(c.feed_tags)


@query("usable_admins", "SELECT user_id, name FROM users WHERE list_contains(string_split(role, ','), 'admin') AND (NOT banned OR coalesce(ban_expires <= TIMESTAMP '1998-01-01', false))")
def usable_admins(c: Catalog) -> DataFrame:
    return c.users.where(lists.usable_admin(F.lit(NOW).cast("timestamp_ntz"))).select("user_id", "name")


@query("admins_after_exclusion", """
    SELECT count(*) AS admins FROM users WHERE list_contains(string_split(role, ','), 'admin') AND (NOT banned OR coalesce(ban_expires <= TIMESTAMP '1998-01-01', false)) AND user_id NOT IN (1, 5, 6)""")
def admins_after_exclusion(c: Catalog) -> DataFrame:
    return lists.usable_admins_without(c.users, c.users.where("user_id in (1, 5, 6)").select("user_id"), F.lit(NOW).cast("timestamp_ntz"))


@query("deletable_users", """
    , admins AS (SELECT user_id FROM users WHERE list_contains(string_split(role, ','), 'admin') AND (NOT banned OR coalesce(ban_expires <= TIMESTAMP '1998-01-01', false)))
    SELECT user_id, name FROM users WHERE region = 1 AND EXISTS (SELECT 1 FROM admins WHERE user_id NOT IN (SELECT user_id FROM users WHERE region = 1))""")
def deletable_users(c: Catalog) -> DataFrame:
    return lists.deletable_users(c.users, c.users.where("region = 1").select("user_id"), F.lit(NOW).cast("timestamp_ntz")).select("user_id", "name")


@query("delete_impact", """
    , gone AS (SELECT feed_id FROM feeds WHERE user_id IN (SELECT user_id FROM users WHERE region = 2))
    SELECT (SELECT count(*) FROM gone) AS feeds, (SELECT count(*) FROM articles WHERE feed_id IN (SELECT feed_id FROM gone)) AS articles,
           (SELECT count(*) FROM feed_tags WHERE feed_id IN (SELECT feed_id FROM gone)) AS feed_tags""")
def delete_impact(c: Catalog) -> DataFrame:
    return lists.delete_impact(c.users.where("region = 2"), c.feeds, c.articles, c.feed_tags)


@query("jobs_left_owner", "SELECT j.job_id, j.kind, j.status, j.user_id, u.name AS owner FROM jobs j LEFT JOIN users u ON j.user_id = u.user_id WHERE j.kind = 'reload' AND j.status = 'pending'")
def jobs_left_owner(c: Catalog) -> DataFrame:
    return lists.jobs_with_owner(c.jobs, c.users, kind="reload", status="pending").select("job_id", "kind", "status", "user_id", "owner")


@query("jobs_visible", "SELECT job_id, status FROM jobs WHERE user_id = 7")
def jobs_visible(c: Catalog) -> DataFrame:
    return lists.visible_jobs(c.jobs, OWNER, admin=False).select("job_id", "status")


@query("owned_ids", "SELECT feed_id FROM feeds WHERE feed_id % 10 = 0 AND user_id = 7")
def owned_ids(c: Catalog) -> DataFrame:
    return lists.owned_ids(c.feeds.where("feed_id % 10 = 0").select("feed_id"), c.feeds, "feed_id", OWNER)


@query("topn_comments", """
    , ranked AS (SELECT post_id, position, author, score, row_number() OVER (PARTITION BY post_id ORDER BY score DESC, position) AS rank FROM comments
                 WHERE trim(body) NOT IN ('', '[deleted]', '[removed]') AND NOT (lower(author) LIKE '%\\_bot' ESCAPE '\\' OR lower(author) LIKE '%-bot' OR lower(author) = 'automoderator'))
    SELECT * FROM ranked WHERE rank <= 3""")
def topn_comments(c: Catalog) -> DataFrame:
    return lists.top_comments(c.comments, 3).select("post_id", "position", "author", "score", "rank")


@query("first_comments", "SELECT post_id, position, author FROM comments WHERE position IN (SELECT unnest(range(0, 2))) AND trim(body) <> ''")
def first_comments(c: Catalog) -> DataFrame:
    return lists.first_then_valid(c.comments, 2).select("post_id", "position", "author")


@query("child_positions", """
    , item AS (SELECT l_orderkey AS parent_id, l_partkey, l_suppkey, l_linenumber, l_quantity, l_extendedprice, l_shipdate FROM lineitem WHERE l_quantity > 49)
    SELECT parent_id, l_partkey, row_number() OVER (PARTITION BY parent_id ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_shipdate) - 1 AS position FROM item""")
def child_positions(c: Catalog) -> DataFrame:
    item = c.table("lineitem").where("l_quantity > 49").withColumnRenamed("l_orderkey", "parent_id")
    order = [F.asc(x) for x in ("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_shipdate")]
    return lists.top_per_key(item, "parent_id", order, 1 << 30).select("parent_id", "l_partkey", (F.col("rank") - 1).alias("position"))


PREFIXES = [("ECONOMY", "cheap"), ("ECONOMY ANODIZED", "cheap and coated"), ("STANDARD", "plain"), ("STANDARD PLATED", "plain and coated"), ("PROMO", "on sale")]


@query("longest_prefix", """
    SELECT p_partkey, p_type, (SELECT label FROM (VALUES ('ECONOMY', 'cheap'), ('ECONOMY ANODIZED', 'cheap and coated'), ('STANDARD', 'plain'), ('STANDARD PLATED', 'plain and coated'), ('PROMO', 'on sale')) t(prefix, label)
           WHERE starts_with(p_type, prefix) ORDER BY length(prefix) DESC LIMIT 1) AS label FROM part""", views=False)
def longest_prefix(c: Catalog) -> DataFrame:
    table = c.spark.createDataFrame(PREFIXES, "prefix string, label string")
    return lists.longest_prefix(c.table("part").select("p_partkey", "p_type"), "p_type", table).drop("prefix")


@query("image_ownership", """
    , blocks AS (SELECT article_id, md5(CAST(article_id % 300 AS VARCHAR)) AS image_ref, md5(CAST(article_id % 500 + 300 AS VARCHAR)) AS thumbnail_ref FROM articles)
    SELECT hash FROM (SELECT md5(CAST(i AS VARCHAR)) AS hash FROM range(0, 1000) t(i)) WHERE hash IN (
        SELECT image_ref FROM blocks JOIN articles USING (article_id) JOIN mine USING (feed_id) UNION SELECT thumbnail_ref FROM blocks JOIN articles USING (article_id) JOIN mine USING (feed_id)
        UNION SELECT md5(CAST(feed_id % 1000 AS VARCHAR)) FROM mine)""")
def image_ownership(c: Catalog) -> DataFrame:
    md5 = lambda x: F.md5(x.cast("string"))
    k = F.col("article_id")
    blocks = c.articles.select("article_id", md5(k % 300).alias("image_ref"), md5(k % 500 + 300).alias("thumbnail_ref"))
    feeds = c.feeds.withColumn("logo", md5(F.col("feed_id") % 1000))
    return lists.image_owned(c.spark.range(1000).select(md5(F.col("id")).alias("hash")), blocks, c.articles, feeds, OWNER)


@query("orphan_comments", "SELECT count(*) AS orphans FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE doc_id IS NOT NULL)", views=False)
def orphan_comments(c: Catalog) -> DataFrame:
    return schema.orphans(c.table("documents").select("doc_id"), c.table("labels"), "doc_id").agg(F.count(F.lit(1)).alias("orphans"))


@query("duplicate_children", "SELECT l_orderkey, l_linenumber, count(*) AS rows FROM lineitem GROUP BY ALL HAVING count(*) > 1", views=False)
def duplicate_children(c: Catalog) -> DataFrame:
    return schema.duplicates(c.table("lineitem"), "l_orderkey", "l_linenumber")


@query("rule_violations", "SELECT 'discount' AS rule, count(*) FILTER (WHERE NOT l_discount < 0.1) AS rows FROM lineitem UNION ALL SELECT 'quantity', count(*) FILTER (WHERE NOT l_quantity >= 2) FROM lineitem", views=False)
def rule_violations(c: Catalog) -> DataFrame:
    return schema.violations(c.table("lineitem"), {"discount": F.col("l_discount") < 0.1, "quantity": F.col("l_quantity") >= 2})


@query("missing_fields", "SELECT count(*) AS rows, count(*) FILTER (WHERE coalesce(text, '') = '') AS missing_text, count(*) FILTER (WHERE coalesce(lang, '') = '') AS missing_lang FROM documents", views=False)
def missing_fields(c: Catalog) -> DataFrame:
    return schema.missing_fields(c.table("documents"), "text", "lang")

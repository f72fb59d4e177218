"""Queries over feed documents, OPML and listings that are made from the test tables, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sedgeline.catalog import Catalog
from sedgeline.functions import text
from sedgeline.plans.relational import NOW, query
from sedgeline.sources import feeds as src
from sedgeline.sources import sites


def _feeds(c: Catalog) -> DataFrame:
    """One RSS or Atom document for each conversation, an entry a turn; every tenth has none."""
    esc = lambda n: text.escape_html(F.translate(n, "\n", " "))
    k, turn = F.col("conv_id"), F.col("turn")
    rss = F.format_string(
        '<item><title>Turn %s</title><link>http://h/%s/%s</link><content:encoded>%s</content:encoded><description>short</description><pubDate>Mon, 01 Jan 2024 0%s:00:00 +0000</pubDate><dc:creator>%s</dc:creator><enclosure url="http://h/a.%s" type="%s" length="7"/></item>',
        turn, k, turn, esc("text"), turn % 10, "role", F.when(turn % 2 == 0, "mp3").otherwise("bin"), F.when(turn % 3 == 0, "audio/mpeg").otherwise("text/plain"),
    )
    atom = F.format_string('<entry><title>Turn %s</title><link rel="self" href="http://s"/><link href="http://h/%s/%s"/><summary>%s</summary><updated>2024-01-01T0%s:00:00Z</updated><author>%s</author></entry>', turn, k, turn, esc("text"), turn % 10, "role")
    line = F.when(k % 3 == 0, atom).otherwise(rss)
    of = c.table("conversations").groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", line.alias("l")))), lambda x: x["l"]), "").alias("b"))
    return of.select(F.col("conv_id").alias("feed_id"), F.when(F.col("conv_id") % 10 == 7, F.lit("<rss><channel/></rss>")).otherwise(F.concat(F.lit("<rss><channel>"), "b", F.lit("</channel></rss>"))).alias("xml"))


BODY = "trim(replace(text, chr(10), ' '))"


@query("feed_entries", f"""
    SELECT conv_id AS feed_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS position, conv_id % 3 = 0 AS is_atom, 'Turn ' || turn AS title, 'http://h/' || conv_id || '/' || turn AS url, {BODY} AS content,
           TIMESTAMP '2024-01-01' + to_hours(CAST(turn % 10 AS INTEGER)) AS date, role AS author FROM conversations WHERE conv_id % 10 <> 7""", views=False)
def feed_entries(c: Catalog) -> DataFrame:
    rows = src.as_articles(src.entries(_feeds(c)), F.lit(NOW).cast("timestamp"))
    return rows.select("feed_id", "position", "is_atom", "title", "url", "content", F.convert_timezone(F.current_timezone(), F.lit("UTC"), F.col("date").cast("timestamp_ntz")).alias("date"), "author")


@query("feed_unreadable", "SELECT DISTINCT conv_id AS feed_id FROM conversations WHERE conv_id % 10 = 7", views=False)
def feed_unreadable(c: Catalog) -> DataFrame:
    return src.unreadable(_feeds(c)).select("feed_id")


@query("feed_episodes", "SELECT conv_id AS feed_id, 'Turn ' || turn AS title, 'http://h/a.' || CASE WHEN turn % 2 = 0 THEN 'mp3' ELSE 'bin' END AS audio FROM conversations WHERE conv_id % 10 <> 7 AND conv_id % 3 <> 0 AND (turn % 2 = 0 OR turn % 3 = 0)", views=False)
def feed_episodes(c: Catalog) -> DataFrame:
    return src.episodes(src.entries(_feeds(c))).select("feed_id", "title", F.col("audio.url").alias("audio"))


@query("feed_slice", "SELECT conv_id AS feed_id, count(*) AS taken FROM (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS n FROM conversations WHERE conv_id % 10 <> 7) WHERE n <= 3 GROUP BY conv_id", views=False)
def feed_slice(c: Catalog) -> DataFrame:
    return src.as_articles(src.entries(_feeds(c)), F.lit(NOW).cast("timestamp"), 3).groupBy("feed_id").agg(F.count(F.lit(1)).alias("taken"))


@query("age_filter", "SELECT o_orderkey FROM orders WHERE o_orderkey % 10 = 0 OR o_orderdate >= TIMESTAMP '1998-01-01' - INTERVAL 30 DAY", views=False)
def age_filter(c: Catalog) -> DataFrame:
    rows = c.table("orders").select("o_orderkey", F.when(F.col("o_orderkey") % 10 != 0, F.col("o_orderdate")).alias("date"))
    return src.within_age(rows, F.lit(NOW).cast("timestamp_ntz"), 30).select("o_orderkey")


def _outlines(c: Catalog) -> DataFrame:
    k = F.col("feed_id")
    rows = c.feeds.select("user_id", "feed_id", F.concat(F.lit('A & "'), "name").alias("name"), "aggregator", F.concat(F.lit("http://h/?a=1&b="), (k % 400).cast("string")).alias("identifier"), F.array(F.lit("x,y"), F.concat(F.lit("t "), (k % 3).cast("string"))).alias("tags"))
    return rows.withColumn("identifier", F.when(k % 50 == 0, F.lit("")).otherwise(F.col("identifier")))


@query("opml_round_trip", """
    SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY name, feed_id) - 1 AS position, 'A & "' || name AS name, CASE WHEN feed_id % 50 = 0 THEN '' ELSE 'http://h/?a=1&b=' || feed_id % 400 END AS identifier, aggregator, 'x,y|t ' || feed_id % 3 AS tags FROM feeds""")
def opml_round_trip(c: Catalog) -> DataFrame:
    return src.read_opml(src.opml(_outlines(c))).select("user_id", "position", "name", "identifier", "aggregator", F.array_join("tags", "|").alias("tags"))


@query("opml_classify", """
    , o AS (SELECT user_id, feed_id, name, aggregator, CASE WHEN feed_id % 50 = 0 THEN '' ELSE 'http://h/?a=1&b=' || feed_id % 400 END AS identifier FROM feeds),
    n AS (SELECT *, row_number() OVER (PARTITION BY user_id, aggregator, identifier ORDER BY name, feed_id) AS n FROM o)
    SELECT outcome, count(*) AS rows FROM (SELECT CASE WHEN identifier = '' THEN 'invalid: no address' WHEN aggregator = 'machinery' THEN 'invalid: unknown aggregator'
        WHEN n > 1 OR (user_id, aggregator, identifier) IN (SELECT (user_id, aggregator, identifier) FROM o WHERE feed_id % 7 = 0) THEN 'duplicate' ELSE 'new' END AS outcome FROM n) GROUP BY outcome""")
def opml_classify(c: Catalog) -> DataFrame:
    stored = _outlines(c).where("feed_id % 7 = 0")
    rows = src.classify_opml(src.read_opml(src.opml(_outlines(c))), stored, ["automobile", "building", "furniture", "household"])
    return rows.groupBy("outcome").agg(F.count(F.lit(1)).alias("rows"))


@query("listing_posts", """
    SELECT event_id, 'p' || event_id AS id, value FROM (SELECT event_id, user_id, event_type, value, epoch(TIMESTAMP '2024-02-01') - floor(epoch(ts)) AS age FROM events)
    WHERE event_type <> 'error' AND event_id % 9 >= 5 AND age >= 172800 AND event_type <> 'click'""", views=False)
def listing_posts(c: Catalog) -> DataFrame:
    kind = F.when(F.col("event_type") == "error", "t1").otherwise("t3")
    author = F.when(F.col("event_type") == "click", "AutoModerator").otherwise("someone")
    utc = F.convert_timezone(F.lit("UTC"), F.current_timezone(), "ts").cast("timestamp")
    data = F.struct(F.concat(F.lit("p"), F.col("event_id").cast("string")).alias("id"), author.alias("author"), F.unix_seconds(utc).cast("double").alias("created_utc"), (F.col("event_id") % 9).alias("num_comments"))
    docs = c.table("events").select("event_id", "value", F.to_json(F.struct(F.struct(F.array(F.struct(kind.alias("kind"), data.alias("data"))).alias("children")).alias("data"))).alias("json"))
    now = F.timestamp_seconds(F.lit(1_706_745_600))  # 2024-02-01
    return src.worth_showing(src.listing(docs), now).select("event_id", "id", "value")


@query("channel_ids", """
    SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN 'UC' || lpad(CAST(c_custkey AS VARCHAR), 22, 'a') WHEN 1 THEN 'UC' || lpad(CAST(n.n_nationkey AS VARCHAR), 22, 'b') WHEN 2 THEN (SELECT min('UC' || lpad(CAST(o.n_nationkey AS VARCHAR), 22, 'b')) FROM nation o WHERE contains(o.n_name, n.n_name)) END AS channel_id
    FROM customer JOIN nation n ON c_nationkey = n.n_nationkey""", views=False)
def channel_ids(c: Catalog) -> DataFrame:
    nation = c.table("nation")
    channels = nation.select(F.concat(F.lit("UC"), F.lpad(F.col("n_nationkey").cast("string"), 22, "b")).alias("channel_id"), F.concat(F.lit("h"), F.lower("n_name")).alias("handle"), F.concat(F.lit("The channel of "), "n_name").alias("title"))
    k = F.col("c_custkey")
    rows = c.table("customer").join(F.broadcast(nation), F.col("c_nationkey") == F.col("n_nationkey"))  # 25 rows
    said = F.when(k % 4 == 0, F.concat(F.lit("https://y/channel/UC"), F.lpad(k.cast("string"), 22, "a"))).when(k % 4 == 1, F.concat(F.lit("https://y/@H"), "n_name")).when(k % 4 == 2, F.concat(F.lit("channel of "), "n_name")).otherwise("nobody")
    return src.channel_id(rows.select("c_custkey", said.alias("identifier")), channels).select("c_custkey", "channel_id")


@query("wanted_titles", "SELECT c_custkey, CASE c_custkey % 3 WHEN 0 THEN 'heise' WHEN 1 THEN 'caschys_blog' ELSE 'merkur' END AS aggregator FROM customer WHERE NOT (c_custkey % 3 = 1 AND c_custkey % 5 = 0) AND NOT (c_custkey % 3 = 0 AND c_custkey % 7 = 0)", views=False)
def wanted_titles(c: Catalog) -> DataFrame:
    k = F.col("c_custkey")
    title = F.concat(F.when(k % 5 == 0, "Neu (Anzeige) ").otherwise(""), F.when(k % 7 == 0, "HEISE-ANGEBOT").otherwise(F.col("c_name")))
    rows = c.table("customer").select("c_custkey", F.when(k % 3 == 0, "heise").when(k % 3 == 1, "caschys_blog").otherwise("merkur").alias("aggregator"), title.alias("title"), F.lit("http://h/").alias("url"))
    return sites.wanted(rows).drop("title", "url")


@query("site_articles")
def site_articles(c: Catalog) -> DataFrame:
    fetched = c.table("pages").select("page_id", "html", F.lit(" no content ").alias("summary"))
    return sites.site_articles(fetched, sites.SITES["full_website"])

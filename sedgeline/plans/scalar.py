"""Queries of the scalar functions and of search, with their SQL."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sedgeline.catalog import Catalog
from sedgeline.functions import text as t
from sedgeline.operators import control, merge, search
from sedgeline.plans.relational import query


@query("fn_escape", """
    SELECT page_id, replace(replace(replace(replace(replace(x, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '''', '&#39;') AS html,
           replace(replace(replace(replace(x, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;') AS attr, x AS back
    FROM (SELECT page_id, html AS x FROM pages)""", views=False)
def fn_escape(c: Catalog) -> DataFrame:
    x = F.col("html")
    return c.table("pages").select("page_id", t.escape_html(x).alias("html"), t.escape_attr(x).alias("attr"), t.unescape_basic(t.escape_html(x)).alias("back"))


@query("fn_whitespace", """
    SELECT doc_id, regexp_replace(x, '[ \\t\\n\\r]+', ' ', 'g') AS collapsed, regexp_replace(regexp_replace(x, '^[ \\t\\n\\r]+', ''), '[ \\t\\n\\r]+$', '') AS stripped
    FROM (SELECT doc_id, ' ' || replace(text, '|', chr(10) || chr(9)) || '  ' AS x FROM documents)""", views=False)
def fn_whitespace(c: Catalog) -> DataFrame:
    x = F.concat(F.lit(" "), F.replace("text", F.lit("|"), F.lit("\n\t")), F.lit("  "))
    return c.table("documents").select("doc_id", t.collapse(x).alias("collapsed"), t.strip(x).alias("stripped"))


NAMES = "CASE p_partkey % 4 WHEN 0 THEN '-300x200.jpg' WHEN 1 THEN '-2.png' WHEN 2 THEN '-a1B2c3.webp' ELSE '-scaled-1200x800-1.jpeg' END"


@query("fn_base_filename", f"""
    SELECT p_partkey, regexp_replace(regexp_replace(regexp_replace(replace(p_name, ' ', '-') || {NAMES}, '\\.[^.]*$', ''), '(-[0-9]+x[0-9]+|-[0-9]+)+$', ''), '-[a-zA-Z0-9]{{3,6}}$', '') AS base FROM part""", views=False)
def fn_base_filename(c: Catalog) -> DataFrame:
    k = F.col("p_partkey") % 4
    suffix = F.when(k == 0, "-300x200.jpg").when(k == 1, "-2.png").when(k == 2, "-a1B2c3.webp").otherwise("-scaled-1200x800-1.jpeg")
    return c.table("part").select("p_partkey", t.base_filename(F.concat(F.replace("p_name", F.lit(" "), F.lit("-")), suffix)).alias("base"))


@query("fn_short_count", """
    SELECT o_orderkey, CASE WHEN n >= 1000000 THEN format('{:.1f}', floor(n / 1000000.0 * 10 + 0.5) / 10) || 'M' WHEN n >= 1000 THEN format('{:.1f}', floor(n / 1000.0 * 10 + 0.5) / 10) || 'K' ELSE CAST(n AS VARCHAR) END AS short
    FROM (SELECT o_orderkey, o_orderkey * o_orderkey % 3000000 AS n FROM orders)""", views=False)
def fn_short_count(c: Catalog) -> DataFrame:
    n = F.col("o_orderkey") * F.col("o_orderkey") % 3_000_000
    return c.table("orders").select("o_orderkey", t.short_count(n).alias("short"))


@query("fn_urls", """
    SELECT page_id, regexp_extract(url, '^([a-z]+):', 1) AS scheme, regexp_extract(url, '^[a-z]+://([^/?#:]+)', 1) AS host,
           regexp_extract(url, '^[a-z]+://([^/?#:]+)', 1) = 'example.com' OR regexp_extract(url, '^[a-z]+://([^/?#:]+)', 1) LIKE '%.example.com' AS own,
           CASE WHEN page_id <= 1 THEN url ELSE url || CASE WHEN contains(url, '?') THEN '&page=' ELSE '?page=' END || page_id END AS paged,
           CASE WHEN page_id <= 1 THEN url ELSE regexp_replace(url, '/+$', '') || '/' || page_id || '/' END AS path FROM pages""", views=False)
def fn_urls(c: Catalog) -> DataFrame:
    u, n = F.col("url"), F.col("page_id")
    return c.table("pages").select("page_id", t.url_scheme(u).alias("scheme"), t.host(u).alias("host"), t.host_is(u, "example.com").alias("own"), t.page_query(u, n).alias("paged"), t.page_path(u, n).alias("path"))


ADDRESSES = [
    (1, "https://www.youtube.com/watch?v=abcdefghijk&t=3"), (2, "https://youtu.be/abc_def-123"), (3, "https://www.youtube-nocookie.com/embed/xyzxyz123"), (4, "javascript:alert(1)"), (5, "/relative"), (6, ""),
    (7, "mailto:a@b.example"), (8, "https://www.dailymotion.com/video/x8abc"), (9, "https://dai.ly/x9"), (10, "https://x.com/u/status/1234567"), (11, "https://bsky.app/profile/me.example/post/3kabc"),
    (12, "https://www.reddit.com/r/spark_sql/comments/1"), (13, "r/a"), (14, "FTP://h/x"), (15, "https://i.example.net/cat.gifv?x"), (16, "https://i.example.net/cat.PNG#f"), (17, None), (18, "https://notyoutube.example/live/abcdefg"),
]


@query("fn_embed_ids", """
    WITH a AS (SELECT c_custkey AS id, replace(u, 'abc', c_custkey || 'abc') AS u FROM customer JOIN (VALUES """ + ", ".join(f"({i}, {'NULL' if u is None else repr(u)})" for i, u in ADDRESSES) + """) t(id, u) ON c_custkey % 18 + 1 = t.id)
    SELECT id, trim(coalesce(u, '')) <> '' AND lower(regexp_extract(u, '^([A-Za-z][A-Za-z0-9+.-]*):', 1)) IN ('', 'http', 'https', 'mailto') AS safe,
           coalesce(nullif(regexp_extract(u, 'youtu\\.be/([A-Za-z0-9_-]{6,})', 1), ''), nullif(regexp_extract(u, '[?&]v=([A-Za-z0-9_-]{6,})', 1), ''), nullif(regexp_extract(u, 'youtube(?:-nocookie)?\\.com/(?:embed|v|shorts|live)/([A-Za-z0-9_-]{6,})', 1), '')) AS video,
           coalesce(nullif(regexp_extract(u, 'dailymotion\\.com/(?:embed/)?video/([A-Za-z0-9]+)', 1), ''), nullif(regexp_extract(u, 'dai\\.ly/([A-Za-z0-9]+)', 1), '')) AS clip,
           nullif(regexp_extract(u, '/status/([0-9]+)', 1), '') AS status, nullif(regexp_extract(u, '/profile/([^/]+)/post/([^/?#]+)', 2), '') AS post,
           nullif(regexp_extract(u, '(?:reddit\\.com/|^/?)r/([A-Za-z0-9_]{2,21})', 1), '') AS subreddit,
           CASE WHEN regexp_matches(lower(u), '^[^?#]*\\.(gifv?|mp4|webm)([?#]|$)') THEN 'video' WHEN regexp_matches(lower(u), '^[^?#]*\\.(jpe?g|png|webp|avif)([?#]|$)') THEN 'image' END AS media FROM a""", views=False)
def fn_embed_ids(c: Catalog) -> DataFrame:
    kinds = F.broadcast(c.spark.createDataFrame(ADDRESSES, "k int, a string"))  # 18 rows
    rows = c.table("customer").join(kinds, F.col("c_custkey") % 18 + 1 == F.col("k")).select(F.col("c_custkey").alias("id"), F.replace("a", F.lit("abc"), F.concat(F.col("c_custkey").cast("string"), F.lit("abc"))).alias("u"))
    u = F.col("u")
    return rows.select("id", t.is_safe_url(u).alias("safe"), t.video_id(u).alias("video"), t.clip_id(u).alias("clip"), t.status_id(u).alias("status"), t.actor_and_post(u)["post"].alias("post"), t.subreddit(u).alias("subreddit"), t.media_kind(u).alias("media"))


@query("fn_links_in_text", """
    SELECT page_id, 'see ' || url || ', [a](' || url || 'x) [b](' || url || 'x) ' || url || '.' AS body, list_aggregate([url || 'x', url || 'x', url], 'string_agg', ' ') AS links FROM pages""", views=False)
def fn_links_in_text(c: Catalog) -> DataFrame:
    u = F.col("url")
    body = F.concat(F.lit("see "), u, F.lit(", [a]("), u, F.lit("x) [b]("), u, F.lit("x) "), u, F.lit("."))
    return c.table("pages").select("page_id", body.alias("body"), F.array_join(t.links_in_text(body), " ").alias("links"))


@query("fn_duration", """
    SELECT event_id, CASE event_id % 4 WHEN 0 THEN s WHEN 1 THEN s WHEN 2 THEN s ELSE NULL END AS seconds,
           CASE WHEN s >= 3600 THEN (s // 3600) || ':' || lpad(CAST(s % 3600 // 60 AS VARCHAR), 2, '0') || ':' || lpad(CAST(s % 60 AS VARCHAR), 2, '0') ELSE (s // 60) || ':' || lpad(CAST(s % 60 AS VARCHAR), 2, '0') END AS shown
    FROM (SELECT event_id, event_id * 37 % 9000 AS s FROM events)""", views=False)
def fn_duration(c: Catalog) -> DataFrame:
    k = F.col("event_id")
    s = k * 37 % 9000
    raw = F.when(k % 4 == 0, s.cast("string")).when(k % 4 == 1, t.duration_text(s)).when(k % 4 == 2, F.concat(F.floor(s / 60).cast("string"), F.lit(":"), (s % 60).cast("string"))).otherwise("1:xx")
    return c.table("events").select("event_id", t.duration_seconds(raw).alias("seconds"), t.duration_text(s).alias("shown"))


@query("fn_dates", """
    SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S') || '.000Z' AS iso, strftime(o_orderdate, '%b %d, %Y') AS day, CAST(epoch(o_orderdate) AS BIGINT) AS epoch,
           date_trunc('day', o_orderdate) AS day_start, date_trunc('month', o_orderdate) AS month_start FROM orders""", views=False)
def fn_dates(c: Catalog) -> DataFrame:
    d = F.col("o_orderdate")
    utc = F.convert_timezone(F.lit("UTC"), F.current_timezone(), d).cast("timestamp")
    return c.table("orders").select("o_orderkey", t.iso_millis(d).alias("iso"), t.day_text(d).alias("day"), F.unix_seconds(utc).alias("epoch"), F.date_trunc("day", d).cast("timestamp_ntz").alias("day_start"), F.date_trunc("month", d).cast("timestamp_ntz").alias("month_start"))


@query("fn_numbers", """
    SELECT event_id, CAST(least(greatest(floor(value), 0), 100) AS INTEGER) AS percent, CAST(CASE WHEN trunc(value * 3) BETWEEN 10 AND 200 THEN trunc(value * 3) ELSE 25 END AS INTEGER) AS bounded,
           CAST(least(greatest(floor(value / 10), 1), 6) AS INTEGER) AS level, CAST(2 ** greatest(event_id % 6 - 1, 0) AS INTEGER) AS minutes, coalesce(event_id % 50 < 20 OR 30 < 20, false) AS small FROM events""", views=False)
def fn_numbers(c: Catalog) -> DataFrame:
    v, k = F.col("value"), F.col("event_id")
    width = t.pixels(F.concat((k % 50).cast("string"), F.lit("px")))
    return c.table("events").select("event_id", t.percent(v).alias("percent"), t.int_within(v * 3, 10, 200, 25).alias("bounded"), t.heading_level(v / 10).alias("level"), control.backoff_minutes(k % 6).alias("minutes"), t.too_small(width, F.lit(30), 20).alias("small"))


@query("fn_content_hash", """
    SELECT doc_id, sha256(coalesce(length(source) || ':' || source, '-') || '|' || coalesce(length(text) || ':' || text, '-') || '|' || CASE WHEN doc_id % 3 = 0 THEN '-' ELSE length(lang) || ':' || lang END) AS content_hash FROM documents""", views=False)
def fn_content_hash(c: Catalog) -> DataFrame:
    lang = F.when(F.col("doc_id") % 3 != 0, F.col("lang"))
    return c.table("documents").select("doc_id", merge.content_hash(F.col("source"), F.col("text"), lang).alias("content_hash"))


@query("fn_json", """
    SELECT event_id, CAST(props->>'$.k' AS INTEGER) AS k, event_id % 3 <> 0 AS valid, CASE WHEN event_id % 3 = 0 THEN props END AS recovered FROM events""", views=False)
def fn_json(c: Catalog) -> DataFrame:
    k, p = F.col("event_id"), F.col("props")
    broken = F.concat(F.lit("Sure: "), p, F.lit(" done"))
    raw = F.when(k % 3 == 0, broken).otherwise(p)
    return c.table("events").select("event_id", F.get_json_object(p, "$.k").cast("int").alias("k"), t.is_json(raw).alias("valid"), F.when(k % 3 == 0, t.lenient_json(raw)).alias("recovered"))


@query("fn_fold_tokens", """
    SELECT doc_id, array_to_string(list_filter(string_split_regex(strip_accents(lower(text)), '[^\\p{L}\\p{N}]+'), lambda x: x <> ''), ' ') AS tokens FROM documents""", views=False)
def fn_fold_tokens(c: Catalog) -> DataFrame:
    return c.table("documents").select("doc_id", F.array_join(t.tokens(F.col("text")), " ").alias("tokens"))


@query("fn_names", """
    SELECT c_custkey, trim(CASE WHEN c_custkey % 3 = 0 THEN '' ELSE c_name END || ' ' || CASE WHEN c_custkey % 2 = 0 THEN '' ELSE c_mktsegment END) AS shown,
           contains(lower(c_mktsegment), 'build') OR contains(lower(c_mktsegment), 'auto') AS listed, replace(replace(replace(c_name, '\\', '\\\\'), '%', '\\%'), '#', '%23') AS coded FROM customer""", views=False)
def fn_names(c: Catalog) -> DataFrame:
    k = F.col("c_custkey")
    first, last = F.when(k % 3 != 0, F.col("c_name")), F.when(k % 2 != 0, F.col("c_mktsegment"))
    return c.table("customer").select("c_custkey", t.display_name(first, last).alias("shown"), t.contains_any(F.col("c_mktsegment"), ["BUILD", "auto"]).alias("listed"), t.percent_encode(F.col("c_name")).alias("coded"))


# --- search

DOCS = """
    d AS (SELECT doc_id, source AS owner, list_filter(string_split_regex(strip_accents(lower(split_part(text, chr(10), 1))), '[^\\p{L}\\p{N}]+'), lambda x: x <> '') AS n,
                 list_filter(string_split_regex(strip_accents(lower(text)), '[^\\p{L}\\p{N}]+'), lambda x: x <> '') AS p FROM documents)"""


def _hits(rows: DataFrame) -> DataFrame:
    return rows.select("doc_id", "owner")


@query("search_and", f"WITH {DOCS} SELECT doc_id, owner FROM d WHERE (list_contains(p, 'the') OR list_contains(n, 'the')) AND len(list_filter(p || n, lambda x: starts_with(x, 'thi'))) > 0", views=False)
def search_and(c: Catalog) -> DataFrame:
    return _hits(search.search(c.documents, "The thi"))


@query("search_prefix", f"WITH {DOCS} SELECT doc_id, owner FROM d WHERE owner = 'src3' AND len(list_filter(p || n, lambda x: starts_with(x, 'ering'))) > 0", views=False)
def search_prefix(c: Catalog) -> DataFrame:
    return _hits(search.search(c.documents.where("owner = 'src3'"), "ering"))


@query("search_folded", f"WITH {DOCS} SELECT doc_id, owner FROM d WHERE len(list_filter(p || n, lambda x: starts_with(x, 'etre'))) > 0", views=False)
def search_folded(c: Catalog) -> DataFrame:
    return _hits(search.search(c.documents, "ÊTRE"))


@query("search_phrase", f"""
    WITH {DOCS} SELECT doc_id, owner FROM d WHERE (contains(' ' || array_to_string(p, ' '), ' of th') OR contains(' ' || array_to_string(n, ' '), ' of th'))""", views=False)
def search_phrase(c: Catalog) -> DataFrame:
    return _hits(search.search(c.documents, "of-th"))


@query("search_index", f"""
    WITH {DOCS} SELECT doc_id FROM d WHERE (contains(' ' || array_to_string(p, ' ') || ' ', ' of the ') OR contains(' ' || array_to_string(n, ' ') || ' ', ' of the ')) AND len(list_filter(p || n, lambda x: starts_with(x, 'ed'))) > 0""", views=False)
def search_index(c: Catalog) -> DataFrame:
    return search.lookup(search.index(c.documents, "doc_id"), "doc_id", "of/the ed")


@query("search_refresh", f"WITH {DOCS} SELECT doc_id, count(*) AS tokens FROM (SELECT doc_id, unnest(CASE WHEN doc_id % 5 = 0 THEN list_slice(p, 1, 0) || ['changed'] ELSE p END) FROM d) GROUP BY doc_id", views=False)
def search_refresh(c: Catalog) -> DataFrame:
    before = c.documents.select("doc_id", "plain_text")
    now = before.withColumn("plain_text", F.when(F.col("doc_id") % 5 == 0, F.lit("Changed")).otherwise(F.col("plain_text")))
    fresh = search.refreshed(search.index(before, "doc_id", ("plain_text",)), before, now, "doc_id", ("plain_text",))
    return fresh.groupBy("doc_id").agg(F.count(F.lit(1)).alias("tokens"))


@query("search_index_stored", f"""
    WITH {DOCS} SELECT doc_id FROM d WHERE (contains(' ' || array_to_string(p, ' ') || ' ', ' de ') OR contains(' ' || array_to_string(n, ' ') || ' ', ' de ')) AND len(list_filter(p || n, lambda x: starts_with(x, 'le'))) > 0""", views=False)
def search_index_stored(c: Catalog) -> DataFrame:
    return search.lookup(search.stored(search.index(c.documents, "doc_id")), "doc_id", "DE le")


#: Words in several scripts, composed and with combining marks, and how a search asks for them.
WORDS = [("Tiếng Việt", "tieng viet"), ("τὸ ἔργο", "εργ"), ("ΈΡΓΟ", "έργο"), ("nai\u0308ve cafe\u0301", "naïve café"), ("Ёлка", "елк"), ("straße", "straße"), ("한국어", "한국"), ("plain", "pla\x00in")]


@query("search_unicode", "SELECT c_custkey, c_custkey % 8 AS word FROM customer", views=False)
def search_unicode(c: Catalog) -> DataFrame:
    """Each of these words is found by its own search, and by no other one."""
    texts = F.broadcast(c.spark.createDataFrame([(k, w) for k, (w, _) in enumerate(WORDS)], "word int, w string"))  # 8 rows
    rows = c.table("customer").join(texts, F.col("c_custkey") % 8 == F.col("word")).select("c_custkey", F.concat(F.col("w"), F.lit(" "), "c_name").alias("name"))
    found = [search.search(rows, asked, ("name",)).select("c_custkey", F.lit(k).cast("long").alias("word")) for k, (_, asked) in enumerate(WORDS) if k != 2]
    # the second word's search finds the third one too, which is the same in capitals
    both = reduce(DataFrame.unionByName, found).withColumn("word", F.when((F.col("word") == 1) & (F.col("c_custkey") % 8 == 2), F.lit(2).cast("long")).otherwise(F.col("word")))
    return both.unionByName(search.search(rows, WORDS[2][1], ("name",)).select("c_custkey", (F.col("c_custkey") % 8).alias("word"))).distinct()


@query("identifier_search", """
    WITH names AS (SELECT p_name || ' ' || lower(p_brand) AS label, min(p_partkey) AS value FROM part GROUP BY 1),
    queries AS (SELECT p_partkey AS query_id, lower(trim(CASE p_partkey % 3 WHEN 0 THEN substr(p_name, 1, CAST(p_partkey % 8 AS BIGINT)) WHEN 1 THEN p_name || ' Brand' ELSE substr(p_name, 3, 6) END)) AS q FROM part WHERE p_partkey % 20 = 0),
    index_ AS (SELECT value, label, unnest(list_distinct(['^' || substr(label, 1, 2)] || [substr(label, i, 3) FOR i IN range(1, length(label) - 1)])) AS gram FROM names),
    asked AS (SELECT query_id, q, list_distinct(['^' || substr(q, 1, 2)] || [substr(q, i, 3) FOR i IN range(1, length(q) - 1)]) AS pieces FROM queries WHERE length(q) >= 2),
    pieces AS (SELECT query_id, q, len(pieces) AS n, unnest(pieces) AS gram FROM asked),
    shared AS (SELECT query_id, value, label, count(*) AS shared, any_value(n) AS n, any_value(starts_with(label, q)) AS begins FROM pieces JOIN index_ USING (gram) GROUP BY ALL HAVING count(*) * 2 >= any_value(n))
    SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY begins DESC, shared DESC, length(label), value) AS position, value, label FROM shared QUALIFY position <= 10""", views=False)
def identifier_search(c: Catalog) -> DataFrame:
    """Names of parts with their brand, for the starts, middles and extensions of every twentieth part's name."""
    k = F.col("p_partkey")
    names = c.table("part").select(k.alias("value"), F.concat_ws(" ", "p_name", F.lower("p_brand")).alias("label"))
    q = F.when(k % 3 == 0, F.substring(F.col("p_name"), F.lit(1), (k % 8).cast("int"))).when(k % 3 == 1, F.concat(F.col("p_name"), F.lit(" Brand"))).otherwise(F.substring("p_name", 3, 6))
    queries = c.table("part").where(k % 20 == 0).select(k.alias("query_id"), q.alias("q"))
    return search.identifier_search(queries, search.identifier_index(names)).select("query_id", F.col("position").cast("long").alias("position"), "value", "label")


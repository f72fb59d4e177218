"""Queries over pages that are built from table columns, so that SQL can tell what they hold."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sedgeline.catalog import Catalog
from sedgeline.functions import text
from sedgeline.operators import media, pages
from sedgeline.plans.relational import query
from sedgeline.sources import sites


def _k() -> Column:
    return F.col("c_custkey")


PAGE = """<html><head><link rel="alternate" type="application/atom+xml" href="/atom/{k}"><link rel="Alternate" type="application/rss+xml" href="feed/{k}">
<link rel="icon" sizes="32x32" href="/i{k}.png"><link rel="apple-touch-icon" href="/t{k}.png"><link rel="shortcut icon" sizes="any" href="/s{k}.svg"><meta property="og:image" content="//cdn.example/og{k}.jpg">
<script type="application/ld+json">{"a": 1}</script><script type="application/ld+json">[{"b": 2}, {"discussionUrl": "/talk/{k}"}]</script></head>
<body><nav class="pager"><a href="?page=3">3</a><a href="?page=2">2</a><a href="?page=3">again</a></nav><article><h1>  {n} </h1><p class="x" onclick="y()">Hello <b>{n}</b> <a href="a/{k}?q#f" style="z">x</a> <a href="javascript:z()">bad</a></p><p> </p>
<p><img src="http://h/pic{k}-300x200.jpg"></p><img src="data:image/png;base64,AA"><iframe src="https://www.youtube.com/embed/video{k}abc"></iframe><iframe src="https://bad.example/x"></iframe><a href="https://x.com/u/status/{k}">post</a>
<div class="c"><span class="u">User {k}</span><div class="b">First
 of {n}</div></div><div class="c"><div class="b"> </div></div><div class="c"><div class="b">Third</div></div></article></body></html>"""


def built(c: Catalog) -> DataFrame:
    """A page for each customer: ``page_id, html``."""
    parts = F.replace(F.replace(F.lit(PAGE), F.lit("{k}"), _k().cast("string")), F.lit("{n}"), F.col("c_name"))
    return c.spread("customer").select(_k().alias("page_id"), parts.alias("html"))


def tree(c: Catalog, *tags: str) -> DataFrame:
    """Nodes of the pages, or those of the tags that are read."""
    return pages.nodes(built(c), stored=False, tags=tags)


def bases(c: Catalog) -> DataFrame:
    return c.table("customer").select(_k().alias("page_id"), F.concat(F.lit("http://site.example/dir/"), _k().cast("string"), F.lit("?x=1")).alias("base"))


@query("page_feed_link", "SELECT c_custkey AS page_id, 'http://site.example/dir/feed/' || c_custkey AS url FROM customer", views=False)
def page_feed_link(c: Catalog) -> DataFrame:
    return pages.feed_link(tree(c, "link"), bases(c))


@query("page_icon", "SELECT c_custkey AS page_id, '/t' || c_custkey || '.png' AS icon FROM customer", views=False)
def page_icon(c: Catalog) -> DataFrame:
    return pages.best_icon(tree(c, "link"))


@query("page_header_image", "SELECT c_custkey AS page_id, 'http://cdn.example/og' || c_custkey || '.jpg' AS image FROM customer", views=False)
def page_header_image(c: Catalog) -> DataFrame:
    return pages.header_image(tree(c, "meta", "img"), bases(c))


@query("page_embeds", """
    SELECT c_custkey AS page_id, url, provider FROM customer, LATERAL (VALUES ('https://www.youtube.com/embed/video' || c_custkey || 'abc', 'youtube'), ('https://bad.example/x', 'generic'), ('https://x.com/u/status/' || c_custkey, 'twitter')) t(url, provider)""", views=False)
def page_embeds(c: Catalog) -> DataFrame:
    return pages.embeds(tree(c, "iframe", "a")).drop("pos")


@query("page_empty_elements", """
    SELECT c_custkey AS page_id, tag, n FROM customer, (VALUES ('p', 1), ('div', 2)) t(tag, n)""", views=False)
def page_empty_elements(c: Catalog) -> DataFrame:
    return pages.empty_elements(tree(c)).groupBy("page_id", "tag").agg(F.count(F.lit(1)).cast("int").alias("n"))


@query("page_discussion", "SELECT c_custkey AS page_id, 'http://site.example/talk/' || c_custkey AS url FROM customer", views=False)
def page_discussion(c: Catalog) -> DataFrame:
    return pages.discussion_link(tree(c, "script", "#text", "a"), bases(c))


@query("page_resolved_links", """
    SELECT c_custkey AS page_id, href, url FROM customer, LATERAL (VALUES ('?page=3', 'http://site.example/dir/' || c_custkey || '?page=3'), ('?page=2', 'http://site.example/dir/' || c_custkey || '?page=2'), ('?page=3', 'http://site.example/dir/' || c_custkey || '?page=3'),
        ('a/' || c_custkey || '?q#f', 'http://site.example/dir/a/' || c_custkey || '?q#f'), ('javascript:z()', ''), ('https://x.com/u/status/' || c_custkey, 'https://x.com/u/status/' || c_custkey)) t(href, url)""", views=False)
def page_resolved_links(c: Catalog) -> DataFrame:
    return pages.links(tree(c, "a"), bases(c)).drop("pos")


@query("page_cleaned", """
    SELECT c_custkey AS page_id, tag, attributes FROM customer, (VALUES ('p', 'data-sanitized-class'), ('p', ''), ('p', ''), ('a', 'data-sanitized-style href'), ('a', 'href'), ('a', 'href'), ('a', 'href'), ('a', 'href'), ('a', 'href')) t(tag, attributes)""", views=False)
def page_cleaned(c: Catalog) -> DataFrame:
    cleaned = pages.clean_attributes(tree(c)).where("tag in ('p', 'a')")
    return cleaned.select("page_id", "tag", F.array_join(F.array_sort(F.map_keys("attrs")), " ").alias("attributes"))


@query("page_notes", "SELECT c_custkey AS page_id, 'a[href:a/' || c_custkey || '?q#f] a[] a[href:https://x.com/u/status/' || c_custkey || ']' AS links, 2 AS images FROM customer", views=False)
def page_notes(c: Catalog) -> DataFrame:
    """Links of articles after the cleaning that comments get; its data image has an unsafe address."""
    tree = pages.nodes(built(c), stored=False, within=False)
    read = tree.select("page_id", "pos", "last", "tag", F.when(F.col("tag").isin("a", "img"), F.col("attrs")).alias("attrs"))
    notes = pages.clean_notes(pages.inside_selected(read, ("article",)))
    link = F.concat(F.lit("a["), F.array_join(F.transform(F.map_entries("attrs"), lambda e: F.concat(e["key"], F.lit(":"), e["value"])), ","), F.lit("]"))
    rows = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("tag") == "a", F.struct("pos", link.alias("l"))))), lambda x: x["l"]), " ")
    return notes.groupBy("page_id").agg(rows.alias("links"), (F.count_if(F.col("tag") == "img") + 1).cast("int").alias("images"))


@query("page_runs", """
    SELECT c_custkey AS page_id, text, bold, link FROM customer, LATERAL (VALUES (' ' || c_name || ' ', false, NULL), ('Hello ', false, NULL), (c_name, true, NULL), (' ', false, NULL), ('x', false, 'a/' || c_custkey || '?q#f'), (' ', false, NULL), ('bad', false, 'javascript:z()')) t(text, bold, link)""", views=False)
def page_runs(c: Catalog) -> DataFrame:
    """Runs of the headings and of paragraphs with a class."""
    found = pages.runs(pages.inside_selected(tree(c), ("article h1", "article p.x")))
    return found.select("page_id", "text", "bold", "link")


@query("page_same_image", "SELECT c_custkey AS page_id, 'http://h/pic' || c_custkey || '-300x200.jpg' AS src, 3 AS left_p FROM customer", views=False)
def page_same_image(c: Catalog) -> DataFrame:
    """The image that a header shows in another size, and how many paragraphs there are once it and its own are gone."""
    t = pages.nodes(built(c))
    targets = c.table("customer").select(_k().alias("page_id"), F.concat(F.lit("https://cdn/pic"), _k().cast("string"), F.lit("-1200x800.jpg")).alias("image"))
    hit = media.same_image(t, targets).select("page_id", pages.attr("src").alias("src"))
    left = media.without_image(t, targets).groupBy("page_id").agg((F.count_if(F.col("tag") == "p") + 1).cast("int").alias("left_p"))
    return hit.join(left, "page_id")


@query("page_absolute", "SELECT c_custkey AS page_id, 'http://site.example/dir/a/' || c_custkey || '?q#f' AS href FROM customer", views=False)
def page_absolute(c: Catalog) -> DataFrame:
    moved = media.absolute(tree(c), bases(c))
    return moved.where((F.col("tag") == "a") & pages.attr("style").isNotNull()).select("page_id", pages.attr("href").alias("href"))


@query("page_foreign_frames", "SELECT c_custkey AS page_id, 'https://bad.example/x' AS src FROM customer", views=False)
def page_foreign_frames(c: Catalog) -> DataFrame:
    return media.foreign_frames(tree(c), ("youtube.com",)).select("page_id", pages.attr("src").alias("src"))


@query("page_trimmed", "SELECT c_custkey AS page_id, c_name AS text FROM customer", views=False)
def page_trimmed(c: Catalog) -> DataFrame:
    return media.trimmed(tree(c)).where((F.col("tag") == "#text") & F.map_contains_key("within", F.lit("h1"))).select("page_id", "text")


@query("page_numbers", "SELECT c_custkey AS page_id, '1 2 3' AS numbers FROM customer", views=False)
def page_numbers(c: Catalog) -> DataFrame:
    found = media.page_numbers(tree(c), (".pager",))
    return found.select("page_id", F.array_join(F.transform("numbers", lambda n: n.cast("string")), " ").alias("numbers"))


@query("page_comment_elements", """
    SELECT c_custkey AS page_id, position, author, body FROM customer, LATERAL (VALUES (1, 'User ' || c_custkey, 'First of ' || c_name), (3, 'Unknown', 'Third')) t(position, author, body)""", views=False)
def page_comment_elements(c: Catalog) -> DataFrame:
    return media.comments(pages.nodes(built(c), stored=False, within=False), (".c",), (".u",), (".b",), 5)


@query("site_rules", """
    SELECT c_custkey FROM customer WHERE c_custkey % 3 <> 0""", views=False)
def site_rules(c: Catalog) -> DataFrame:
    """Entries that are left of a source that skips titles by their start."""
    rows = c.table("customer").select("c_custkey", F.lit("mactechnews").alias("aggregator"), F.concat(F.when(_k() % 3 == 0, "TechTicker: ").otherwise("On TechTicker: "), "c_name").alias("title"), F.lit("http://h/").alias("url"))
    return sites.wanted(rows).select("c_custkey")


@query("merged_pages", "SELECT conv_id AS article_id, string_agg(trim(text), chr(10) || chr(10) ORDER BY turn) AS plain_text FROM conversations WHERE trim(text) <> '' GROUP BY conv_id", views=False)
def merged_pages(c: Catalog) -> DataFrame:
    parts = c.table("conversations").select(F.col("conv_id").alias("article_id"), F.col("turn").alias("number"), F.concat(F.lit(" "), "text", F.lit(" ")).alias("plain_text"))
    return media.merged_pages(parts)


@query("thread_comments", "SELECT conv_id AS video_id, turn AS position FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn, text) AS n FROM conversations WHERE text <> '' AND role <> 'assistant') WHERE n <= 2", views=False)
def thread_comments(c: Catalog) -> DataFrame:
    rows = c.table("conversations").select(F.col("conv_id").alias("video_id"), F.col("turn").alias("position"), F.when(F.col("role") == "assistant", "[removed]").otherwise(F.col("text")).alias("body"))
    return media.top_comments(rows, 2).select("video_id", "position")


@query("post_media", """
    SELECT event_id, CASE event_id % 3 WHEN 0 THEN 'file' || event_id WHEN 1 THEN 'stream' || event_id END AS video, 'big' || event_id AS thumbnail, 'one' || event_id || '&x a.mp4' AS gallery,
           CASE WHEN event_id % 3 = 2 THEN '' ELSE '<div class="youtube-embed-container" data-embed="https://www.youtube.com/embed/v' || event_id || '"><img src="t&quot;" alt=""><a href="https://www.youtube.com/watch?v=v' || event_id || '" target="_blank" rel="noopener">Play</a></div>' END AS facade FROM events""", views=False)
def post_media(c: Catalog) -> DataFrame:
    e = F.col("event_id")
    s = e.cast("string")
    found = F.when(e % 3 == 0, F.concat(F.lit('{"reddit_video":{"hls_url":"h","fallback_url":"file'), s, F.lit('"}}'))).when(e % 3 == 1, F.concat(F.lit('{"reddit_video":{"hls_url":"stream'), s, F.lit('"}}')))
    none = F.lit(None).cast("string")
    items = F.lit('[{"media_id":"a"},{"media_id":"gone"},{"media_id":"b"}]')
    known = F.concat(F.lit('{"a":{"e":"Image","s":{"u":"one'), s, F.lit('&amp;x"}},"b":{"e":"AnimatedImage","s":{"gif":"a.gif","mp4":"a.mp4"}}}'))
    small = F.create_map(F.lit("medium"), F.lit("m"), F.lit("high"), F.concat(F.lit("big"), s))
    return c.table("events").select(
        "event_id", media.video_url(none, found, none).alias("video"), media.thumbnail(small).alias("thumbnail"), F.array_join(F.transform(media.gallery(items, known), lambda x: x["url"]), " ").alias("gallery"),
        F.coalesce(media.facade("youtube", F.when(e % 3 != 2, F.concat(F.lit("v"), s)), "Play", F.lit('t"')), F.lit("")).alias("facade"),
    )


@query("article_assembled", """
    SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN '' ELSE '<header class="media-header">' || chr(10) || '<img src="/h?a&amp;b" alt="' || c_name || '">' || chr(10) || '</header>' || chr(10) || chr(10) END ||
           '<section data-sanitized-class="article-content"><p>x</p></section>' || CASE WHEN c_custkey % 2 = 0 THEN chr(10) || chr(10) || '<section data-sanitized-class="article-comments">c</section>' ELSE '' END AS html FROM customer""", views=False)
def article_assembled(c: Catalog) -> DataFrame:
    header = pages.header_html(F.when(_k() % 3 != 0, "/h?a&b"), F.col("c_name"))
    return c.table("customer").select("c_custkey", pages.article_html(F.lit("<p>x</p>"), header, F.when(_k() % 2 == 0, "c")).alias("html"))


@query("page_main_text", "SELECT c_custkey AS page_id, c_name AS name FROM customer", views=False)
def page_main_text(c: Catalog) -> DataFrame:
    """Main texts long enough to count, by the heading that they start with."""
    found = pages.generic_content(pages.plain_text(pages.blocks(pages.main_content(tree(c), ignore=(".c", "nav", "a[href*=status]")))).withColumn("plain_text", F.concat("plain_text", F.lit(" " * 80))))
    return found.select("page_id", text.strip(F.substring_index("plain_text", "\n\n", 1)).alias("name"))


PARTS = """<body><article><header class="top"><img src="/logo.png"></header><header class="media-header"><img src="/lead{k}.jpg"></header>
<figure><img src="/a{k}.jpg"><img src="/b{k}.jpg"><figcaption>Caption of {n}</figcaption></figure><figure><p>No image</p><figcaption>Only words</figcaption></figure>
<table><tr><th>Name</th><td></td><td>{n}</td></tr><tr><td>{k}</td><td><table><tr><td>in</td><td>ner</td></tr></table></td></tr></table>
<blockquote><p>Said</p><a href="https://x.com/u/status/{k}">there</a></blockquote><blockquote><p>Quote of {n}</p></blockquote>
<div class="youtube-embed big"><img src="/t{k}.jpg"><a href="https://www.youtube.com/watch?v=video{k}abc">Play</a></div>
<video poster="/p{k}.jpg"><source src="/v{k}.webm"><source src="/v{k}.mp4"></video><audio src="/s{k}.mp3"></audio><pre><code class="hl language-sql">SELECT {k}
</code></pre><hr></article></body>"""


@query("page_block_kinds", """
    SELECT c_custkey AS page_id, row_number() OVER (PARTITION BY c_custkey ORDER BY n) AS position, kind, text, image_ref, embed_provider, language, caption FROM customer, LATERAL (VALUES
        (1, 'image', '', '/lead' || c_custkey || '.jpg', NULL, NULL, NULL), (2, 'image', '', '/a' || c_custkey || '.jpg', NULL, NULL, 'Caption of ' || c_name), (3, 'image', '', '/b' || c_custkey || '.jpg', NULL, NULL, NULL),
        (4, 'paragraph', 'No image', NULL, NULL, NULL, NULL), (5, 'paragraph', 'Only words', NULL, NULL, NULL, NULL), (6, 'paragraph', 'Name — ' || c_name, NULL, NULL, NULL, NULL), (7, 'paragraph', c_custkey::VARCHAR, NULL, NULL, NULL, NULL),
        (8, 'paragraph', 'in — ner', NULL, NULL, NULL, NULL), (9, 'embed', '', 'https://x.com/u/status/' || c_custkey, 'tweet', NULL, NULL), (10, 'quote', 'Quote of ' || c_name, NULL, NULL, NULL, NULL),
        (11, 'embed', '', 'https://www.youtube.com/watch?v=video' || c_custkey || 'abc', 'youtube', NULL, '/t' || c_custkey || '.jpg'), (12, 'embed', '', '/v' || c_custkey || '.webm', 'video', NULL, '/p' || c_custkey || '.jpg'),
        (13, 'embed', '', '/s' || c_custkey || '.mp3', 'audio', NULL, NULL), (14, 'code', 'SELECT ' || c_custkey || chr(10), NULL, NULL, 'sql', NULL), (15, 'divider', '', NULL, NULL, NULL, NULL)) t(n, kind, text, image_ref, embed_provider, language, caption)""", views=False)
def page_block_kinds(c: Catalog) -> DataFrame:
    html = F.replace(F.replace(F.lit(PARTS), F.lit("{k}"), _k().cast("string")), F.lit("{n}"), F.col("c_name"))
    found = pages.blocks(pages.main_content(pages.nodes(c.spread("customer").select(_k().alias("page_id"), html.alias("html")), stored=False)))
    at = F.row_number().over(Window.partitionBy("page_id").orderBy("pos"))
    return found.select("page_id", at.cast("long").alias("position"), "kind", "text", "image_ref", "embed_provider", "language", "caption")

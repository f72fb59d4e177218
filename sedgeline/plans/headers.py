"""Queries over header chains and copies of headers, on rows that differ by their number."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sedgeline.catalog import Catalog
from sedgeline.operators import blocks, headers, media, pages
from sedgeline.plans.relational import query


def _k(c: str) -> Column:
    return F.col(c).cast("string")


def _known(c: Catalog) -> headers.Fetch:
    """Looks addresses up in a table: every one of a customer's pages but each fifth has a picture, and so have few others."""
    n = F.col("c_custkey")
    page = c.table("customer").where(n % 5 != 0).select(F.concat(F.lit("https://site.example/a/"), _k("c_custkey")).alias("address"), F.concat(F.lit("/pic"), _k("c_custkey")).alias("image"))
    still = c.table("customer").where(n % 4 != 0).select(F.concat(F.lit("https://img.youtube.com/vi/video"), _k("c_custkey"), F.when(n % 4 == 1, "abc/maxresdefault.jpg").otherwise("abc/hqdefault.jpg")).alias("address")).withColumn("image", F.col("address"))
    forum = c.table("part").select(F.concat(F.lit("https://www.reddit.com/r/forum"), _k("p_partkey"), F.lit("/about.json")).alias("address"), F.concat(F.lit("/icon"), _k("p_partkey")).alias("image"))
    table = page.unionByName(still).unionByName(forum)
    return lambda asked: asked.join(table, "address").select("address", "image")


@query("article_headers", """
    SELECT k AS article_id, CASE k % 6 WHEN 0 THEN 'override' WHEN 1 THEN CASE WHEN k <= (SELECT max(p_partkey) FROM part) THEN 'forum' END WHEN 2 THEN CASE WHEN k % 4 = 0 THEN NULL ELSE 'video' END WHEN 4 THEN NULL ELSE CASE WHEN k % 5 <> 0 THEN 'page' END END AS stage,
        CASE k % 6 WHEN 0 THEN 'https://upload.wikimedia.org/wikipedia/commons/0/0d/Nintendo.svg' WHEN 1 THEN CASE WHEN k <= (SELECT max(p_partkey) FROM part) THEN '/icon' || k END
            WHEN 2 THEN CASE k % 4 WHEN 0 THEN NULL WHEN 1 THEN 'https://img.youtube.com/vi/video' || k || 'abc/maxresdefault.jpg' ELSE 'https://img.youtube.com/vi/video' || k || 'abc/hqdefault.jpg' END WHEN 4 THEN NULL ELSE CASE WHEN k % 5 <> 0 THEN '/pic' || k END END AS image
    FROM (SELECT c_custkey AS k FROM customer)""", views=False)
def article_headers(c: Catalog) -> DataFrame:
    k, n = _k("c_custkey"), F.col("c_custkey")
    page = F.concat(F.lit("https://site.example/a/"), k)
    url = (
        F.when(n % 6 == 0, F.concat(F.lit("https://en-americas-support.nintendo.com/app/"), k)).when(n % 6 == 1, F.concat(F.lit("https://www.reddit.com/r/forum"), k, F.lit("/comments/ab1/x")))
        .when(n % 6 == 2, F.concat(F.lit("https://youtu.be/video"), k, F.lit("abc"))).when(n % 6 == 4, F.concat(F.lit("https://v.redd.it/"), k)).otherwise(page)
    )
    return headers.article_headers(c.table("customer").select(n.alias("article_id"), url.alias("url")), _known(c))


@query("post_headers", """
    SELECT k AS post_id, CASE k % 12 WHEN 0 THEN 'override' WHEN 1 THEN 'video' WHEN 2 THEN 'video' WHEN 3 THEN 'gif' WHEN 4 THEN 'quoted' WHEN 5 THEN 'quoted' WHEN 6 THEN 'gallery' WHEN 7 THEN 'picture' WHEN 8 THEN 'text' WHEN 9 THEN CASE WHEN k % 5 <> 0 THEN 'text' ELSE 'thumbnail' END
            WHEN 10 THEN 'thumbnail' ELSE CASE WHEN k % 5 <> 0 THEN 'page' END END AS stage,
        CASE k % 12 WHEN 0 THEN 'https://upload.wikimedia.org/wikipedia/commons/0/0d/Nintendo.svg' WHEN 1 THEN 'https://youtu.be/video' || k || 'abc' WHEN 2 THEN 'https://www.youtube.com/watch?v=video' || k || 'abc' WHEN 3 THEN 'https://media.giphy.com/media/Id' || k || '/giphy.gif'
            WHEN 4 THEN 'https://x.com/u/status/' || k WHEN 5 THEN 'https://mobile.twitter.com/u/status/' || k WHEN 6 THEN CASE WHEN k % 24 = 6 THEN 'one' || k || '&a.gif' ELSE 'two' || k || '&b' END WHEN 7 THEN 'https://i.redd.it/' || k || '.jpg?a&b' WHEN 8 THEN 'https://h/p' || k || '.PNG'
            WHEN 9 THEN CASE WHEN k % 5 <> 0 THEN '/pic' || k ELSE 'https://reddit.com/thumb' || k END WHEN 10 THEN CASE WHEN k % 24 = 10 THEN 'https://preview/' || k || '?x&y' ELSE 'https://small/' || k END ELSE CASE WHEN k % 5 <> 0 THEN '/pic' || k END END AS image
    FROM (SELECT c_custkey AS k FROM customer)""", views=False)
def post_headers(c: Catalog) -> DataFrame:
    k, n = _k("c_custkey"), F.col("c_custkey")
    kind, none = n % 12, F.lit(None).cast("string")
    at = lambda before, after="": F.concat(F.lit(before), k, F.lit(after))
    page, thread = at("https://site.example/a/"), at("https://www.reddit.com/r/f/comments/", "/title/")
    url = (
        F.when(kind == 0, at("https://en-americas-support.nintendo.com/")).when(kind == 1, at("https://youtu.be/video", "abc")).when(kind == 3, at("https://giphy.com/gifs/funny-Id")).when(kind == 4, at("https://x.com/u/status/"))
        .when(kind == 7, at("https://i.redd.it/", ".jpg?a&amp;b")).when(kind == 10, at("https://v.redd.it/")).when(kind == 11, page).otherwise(thread)
    )
    body = (
        F.when(kind == 2, at("see https://h/x then [this](https://www.youtube.com/watch?v=video", "abc)")).when(kind == 5, at("as https://mobile.twitter.com/u/status/", " says")).when(kind == 8, at("first https://h/page then https://h/p", ".PNG, and so on"))
        .when(kind == 9, F.concat(F.lit("https://x.example/comments/a/b/c "), page)).otherwise(none)
    )
    body = F.when(kind == 9, F.concat(page, F.lit(" https://h/r/f/comments/a1/b/c9 https://h/late.png"))).otherwise(body)
    known = F.concat(F.lit('{"a":{"e":"'), F.when(n % 24 == 6, "AnimatedImage").otherwise("Image"), F.lit('","s":{"gif":"one'), k, F.lit('&amp;a.gif","u":"two'), k, F.lit('&amp;b"}}}'))
    shown = F.when(n % 24 == 10, at('{"images":[{"source":{"url":"https://preview/', '?x&amp;y"}}]}')).when(kind == 10, F.concat(F.lit('{"images":[{"resolutions":[{"url":"tiny"},{"url":"https://small/'), k, F.lit('"}]}]}')))
    posts = c.table("customer").select(
        n.alias("post_id"), url.alias("url"), kind.isin(2, 5, 8, 9).alias("is_self"), body.alias("selftext"), (kind == 6).alias("is_gallery"), F.when(kind == 6, '{"items":[{"media_id":"a"},{"media_id":"b"}]}').alias("gallery_data"), F.when(kind == 6, known).alias("media_metadata"),
        shown.alias("preview"), F.when(kind == 9, at("/thumb")).otherwise("self").alias("thumbnail"),
    )
    return headers.post_headers(posts, _known(c))


def _texts(tree: DataFrame) -> DataFrame:
    """``page_id, shown``: what is left of a page, in order."""
    rows = blocks.nested_blocks(tree)
    said = F.coalesce("image_ref", F.array_join(F.transform("runs", lambda r: r["text"]), ""))
    return rows.groupBy("page_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", said.alias("x")))), lambda r: r["x"]), " | ").alias("shown"))


@query("header_copies", """
    SELECT c_custkey AS page_id, CASE WHEN c_custkey % 3 = 0 THEN '/img/h.jpg | ' ELSE '' END || 'with text | ' || CASE WHEN c_custkey % 3 = 0 THEN 'https://cdn.example/img/h.jpg?w=300 | ' ELSE '' END || '/img/other.jpg | end' AS shown FROM customer""", views=False)
def header_copies(c: Catalog) -> DataFrame:
    """Two of three pages have a header that shows the picture of another host and size; the rest have another picture."""
    html = '<body><div><p><img src="/img/h.jpg"></p></div><p>with text<img src="https://cdn.example/img/h.jpg?w=300"></p><img src="/img/other.jpg"><p>end</p></body>'
    tree = pages.nodes(c.spread("customer").select(F.col("c_custkey").alias("page_id"), F.lit(html).alias("html")), stored=False)
    image = F.when(F.col("c_custkey") % 3 == 0, "/img/none.jpg").otherwise(F.concat(F.lit("https://h.example/x/../img/h.jpg#"), _k("c_custkey")))
    return _texts(headers.without_copies(tree, c.table("customer").select(F.col("c_custkey").alias("page_id"), image.alias("image"))))


@query("leading_image", """
    SELECT k AS page_id, CASE k % 6 WHEN 0 THEN 'text  | /b.jpg' WHEN 1 THEN 'after' WHEN 2 THEN 'first | /a.jpg' WHEN 3 THEN 'rest' WHEN 4 THEN '/a.jpg | none' ELSE 'words | /a.jpg' END AS shown FROM (SELECT c_custkey AS k FROM customer)""", views=False)
def leading_image(c: Catalog) -> DataFrame:
    """A picture that comes first: bare, in a paragraph, after text, in a link, on a page without a header, after words in its paragraph."""
    n = F.col("c_custkey") % 6
    html = (
        F.when(n == 0, '<body><div> <img src="/a.jpg"><p>text <img src="/b.jpg"></p></div></body>').when(n == 1, '<body><div><!-- c --><p> <br><img src="/a.jpg"><br> <br>  after</p></div></body>').when(n == 2, '<body><div>first<img src="/a.jpg"></div></body>')
        .when(n == 3, '<body><p><a href="/"><img src="/a.jpg"></a> rest</p><p> </p></body>').when(n == 4, '<body><div><img src="/a.jpg"><p>none</p></div></body>').otherwise('<body><div><p>words<img src="/a.jpg"></p></div></body>')
    )
    tree = pages.nodes(c.spread("customer").select(F.col("c_custkey").alias("page_id"), html.alias("html")), stored=False)
    return _texts(headers.without_leading_image(tree, c.table("customer").where("c_custkey % 6 <> 4").select(F.col("c_custkey").alias("page_id"))))


@query("player_headers", """
    SELECT k AS page_id, '<header class="media-header"><div class="media-player" style="width: 100%;">' || CASE
            WHEN k % 5 = 0 THEN '<iframe src="https://www.tagesschau.de/play/' || k || '" poster="https://www.tagesschau.de/p' || k || '.jpg" width="100%" height="' || CASE WHEN k % 2 = 0 THEN '200' ELSE '315' END || '" frameborder="0" allowfullscreen scrolling="no"></iframe>'
            WHEN k % 2 = 0 THEN '<audio controls preload="auto"' || poster || ' style="width: 100%;"><source src="https://m/' || k || '.mp3" type="audio/mpeg">Your browser does not support the audio element.</audio>'
            ELSE '<video controls preload="auto"' || poster || ' style="width: 100%;"><source src="https://m/' || k || '.mp4?a&amp;b" type="video/mp4">Your browser does not support the video element.</video>' END || '</div></header>' AS html, image
    FROM (SELECT *, coalesce(' poster="' || image || '"', '') AS poster FROM (SELECT c_custkey AS k, CASE WHEN c_custkey % 5 = 0 THEN 'https://www.tagesschau.de/p' || c_custkey || '.jpg' ELSE CASE c_custkey % 3 WHEN 0 THEN 'https://s/' || c_custkey WHEN 1 THEN 'https://near/' || c_custkey END END AS image FROM customer))
    WHERE k % 7 <> 3""", views=False)
def player_headers(c: Catalog) -> DataFrame:
    """Players with shared code, of sound only, of both; pictures of their own, of a stream, near them, or none; some are no JSON."""
    k, n = _k("c_custkey"), F.col("c_custkey")
    at = lambda before, after="": F.concat(F.lit(before), k, F.lit(after))
    code = F.when(n % 5 == 0, at('"poster":"/p', '.jpg",')).otherwise("")
    plugin = F.when(n % 5 == 0, at(',"pluginData":{"sharing@web":{"embedCode":"&lt;iframe width=1 src=\\"/play/', '$params$\\"&gt;&lt;/iframe&gt;"}}')).otherwise("")
    own = F.when(n % 3 == 0, at('"thumbnail":"https://s/', '",')).otherwise("")
    video = F.when(n % 2 == 0, "").otherwise(at(',{"isAudioOnly":false,"media":[{"url":"javascript:x","mimeType":"video/mp4"},{"url":"https://m/', '.mp4?a&b","mimeType":"video/mp4"}]}'))
    described = F.concat(F.lit('{"mc":{'), code, F.lit('"streams":[{'), own, F.lit('"isAudioOnly":true,"media":[{"url":"https://m/'), k, F.lit('.mp3","mimeType":"audio/mpeg"}]}'), video, F.lit("]}"), plugin, F.lit("}"))
    coded = F.replace(F.replace(F.when(n % 7 == 3, "{no json").otherwise(described), F.lit("&"), F.lit("&amp;")), F.lit('"'), F.lit("&quot;"))
    near = F.when(n % 3 == 1, at('<img src="https://near/', '">')).otherwise("")
    other = '<div class="mediaplayer" data-v-type="MediaPlayer" data-v="{&quot;mc&quot;:{&quot;streams&quot;:[{&quot;media&quot;:[{&quot;url&quot;:&quot;https://late&quot;,&quot;mimeType&quot;:&quot;video/x&quot;}]}]}}"></div>'
    html = F.concat(F.lit(f"<body>{other}<div>"), near, F.lit('<div class="x MediaPlayer teaser-top__player" data-v-type="MediaPlayer" data-v="'), coded, F.lit('"></div></div></body>'))
    return media.player_headers(pages.nodes(c.spread("customer").select(n.alias("page_id"), html.alias("html"))))

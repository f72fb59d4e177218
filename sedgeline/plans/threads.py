"""Queries over comments in four dialects and a site from its fetched pages to blocks."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sedgeline import scratch
from sedgeline.catalog import Catalog
from sedgeline.operators import blocks, pages, threads
from sedgeline.plans.relational import query
from sedgeline.sources import sites


def _k() -> Column:
    return F.col("c_custkey").cast("string")


def _each(one: Callable[[Column], Column], most: int = 5) -> Column:
    """HTML of as many comments as a customer's number says, 0 to ``most - 1``."""
    n = (F.col("c_custkey") % most).cast("int")
    return F.when(n > 0, F.array_join(F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), one), "")).otherwise("")


def _tree(c: Catalog, html: Column) -> DataFrame:
    return pages.nodes(c.spread("customer").select(F.col("c_custkey").alias("page_id"), html.alias("html")), within=False)


def _bases(c: Catalog) -> DataFrame:
    return c.table("customer").select(F.col("c_custkey").alias("page_id"), F.concat(F.lit("https://site.example/"), _k()).alias("base"))


def _sql(quote: str, kept: str = "true", most: int = 3, title: str = "'https://site.example/' || k || '#comments'") -> str:
    """SQL of a page's section; ``quote`` is SQL of comment ``i`` of customer ``k``."""
    return f"""
        SELECT k AS page_id, '<section><h3><a href="' || {title} || '">Comments</a></h3>' || string_agg({quote}, '' ORDER BY i) || '</section>' AS html
        FROM (SELECT c_custkey AS k FROM customer), range(1, 5) t(i) WHERE i <= k % 5 AND i <= {most} AND {kept} GROUP BY k"""


_QUOTE = "'<blockquote><p><strong>' || {author} || '</strong>' || {time} || ' | <a href=\"' || {url} || '\">Source</a></p><div>' || {body} || '</div></blockquote>'"


@query("comments_scroll", _sql(_QUOTE.format(author="CASE WHEN i = 2 THEN 'Unknown' ELSE 'U &amp; ' || i END", time="CASE WHEN i = 1 THEN ' (1.2.26 10:0' || i || ')' ELSE '' END", url="'https://site.example/' || k || '#' || CASE WHEN i = 3 THEN 'comments' ELSE 'c' || i END", body="'<div>Said <b>' || k || '</b>.' || i || '<a>x</a></div>'")), views=False)
def comments_scroll(c: Catalog) -> DataFrame:
    one = lambda i: F.concat(
        F.lit('<div class="MtnComment"'), F.when(i != 3, F.concat(F.lit(' id="c'), i.cast("string"), F.lit('"'))).otherwise(""), F.lit(">"), F.when(i == 2, "").otherwise(F.concat(F.lit('<span class="MtnCommentAccountName"> U &amp; '), i.cast("string"), F.lit("</span>"))),
        F.when(i == 1, '<span class="MtnCommentTime"><span>1.2.26</span> <span>10:01</span></span>').otherwise(""), F.lit('<div class="MtnCommentText" onclick="x">Said <b class="y">'), _k(), F.lit("</b>."), i.cast("string"), F.lit('<a href="javascript:y">x</a><script>z</script></div></div>'),
    )
    html = F.concat(F.lit('<body><div class="MtnComment"><div class="MtnCommentText">outside</div></div><div class="MtnCommentScroll">'), _each(one), F.lit("</div></body>"))
    found = threads.comments(_tree(c, html), threads.DIALECTS["mactechnews"], _bases(c), 3)
    return threads.quoted(found.join(pages.shuffled(_bases(c)), "page_id"), F.concat("base", F.lit("#comments")))


@query("comments_nested", _sql(_QUOTE.format(author="'Name ' || i", time="' (' || CASE WHEN i = 2 THEN 'yesterday' ELSE 'day ' || i END || ')'", url="'https://site.example/' || k || '#r' || i", body="'<p>Reply ' || i || '</p>'"), "NOT (i = 3 AND k % 2 = 0)"), views=False)
def comments_nested(c: Catalog) -> DataFrame:
    """Each reply lies within the comment that it answers."""
    one = lambda i: F.concat(
        F.lit('<div class="wpd-comment"><div class="wpd-comment-right" id="r'), i.cast("string"), F.lit('"><div class="wpd-comment-author"><b>Name</b> '), i.cast("string"), F.lit('</div><div class="wpd-comment-date"'), F.when(i == 2, "").otherwise(F.concat(F.lit(' title=" day '), i.cast("string"), F.lit('"'))),
        F.lit('> yesterday </div><div class="wpd-comment-text">'), F.when((i == 3) & (F.col("c_custkey") % 2 == 0), " ").otherwise(F.concat(F.lit("<p>Reply "), i.cast("string"), F.lit("</p>"))), F.lit("</div>"),
    )
    ends = F.repeat(F.lit("</div></div>"), (F.col("c_custkey") % 5).cast("int"))
    found = threads.comments(_tree(c, F.concat(F.lit('<div class="wpd-thread-list">'), _each(one), ends, F.lit("</div>"))), threads.DIALECTS["mein_mmo"], _bases(c), 3)
    return threads.quoted(found.join(pages.shuffled(_bases(c)), "page_id"), F.concat("base", F.lit("#comments")))


@query("comments_posts", """
    WITH kept AS (SELECT conv_id, turn, role, length(text) AS score FROM conversations WHERE role <> 'assistant' AND turn % 7 <> 3),
        ranked AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY score DESC, turn) AS n FROM kept)
    SELECT conv_id AS page_id, '<section>' || string_agg('<blockquote><p><strong>' || role || '</strong> | <a href="https://reddit.com/r/' || turn || '">Source</a></p><div><p>turn <strong>' || turn || '</strong></p></div></blockquote>', '' ORDER BY n) || '</section>' AS html FROM ranked WHERE n <= 4 GROUP BY conv_id""", views=False)
def comments_posts(c: Catalog) -> DataFrame:
    turn = F.col("turn").cast("string")
    rows = c.table("conversations").select(
        F.col("conv_id").alias("page_id"), F.col("turn").alias("id"), F.when(F.col("role") == "assistant", "Helper_BOT").otherwise(F.col("role")).alias("author"), F.when(F.col("turn") % 7 == 3, "[removed]").otherwise(F.concat(F.lit("turn **"), turn, F.lit("**"))).alias("body"),
        F.length("text").alias("score"), F.concat(F.lit("/r/"), turn).alias("permalink"),
    )
    return threads.quoted(threads.post_comments(rows, 4))


@query("site_blocks", """
    WITH p AS (SELECT c_custkey AS k, c_name, c_custkey % 4 AS n, c_custkey % 3 = 0 AS led, c_custkey % 7 = 0 AS empty FROM customer),
    rows_ AS (
        SELECT k, 0 AS o, 'image' AS kind, '/lead' || k || '.jpg' AS said FROM p WHERE led
        UNION ALL SELECT k, 1, 'paragraph', CASE WHEN empty THEN 'Summary of ' || c_name ELSE 'Text of ' || c_name END FROM p
        UNION ALL SELECT k, 2, 'image', '/lead' || k || '.jpg?w=3' FROM p WHERE NOT led AND NOT empty
        UNION ALL SELECT k, 3, 'heading', 'Comments' FROM p WHERE n > 0
        UNION ALL SELECT k, 3 + i, 'paragraph', CASE WHEN n = 3 THEN 'user' || i ELSE 'Unknown' END || ' | Source' FROM p, range(1, 4) t(i) WHERE i <= least(n, 2)
        UNION ALL SELECT k, 3.5 + i, 'paragraph', CASE WHEN n = 3 THEN 'subject ' ELSE 'said ' END || i FROM p, range(1, 4) t(i) WHERE i <= least(n, 2))
    SELECT k AS page_id, string_agg(kind || ':' || said, ' / ' ORDER BY o) AS shown FROM rows_ GROUP BY k""", views=False)
def site_blocks(c: Catalog) -> DataFrame:
    """Pages of one source from fetch to blocks: content, summary, lead picture and its copy, and the forum page that a page leads
    to, with comments in one of two dialects."""
    k, n = _k(), (F.col("c_custkey") % 4).cast("int")
    body = F.when(F.col("c_custkey") % 7 == 0, "").otherwise(F.concat(F.lit('<div id="meldung"><div class="ad">buy</div><p>Text of '), F.col("c_name"), F.lit('</p><p><img src="https://cdn.example/../lead'), k, F.lit('.jpg?w=3"></p><aside>more</aside></div>')))
    talk = F.concat(F.lit('<script type="application/ld+json">{"discussionUrl":"/forum/'), k, F.lit('"}</script>'))
    fetched = c.spread("customer").select(F.col("c_custkey").alias("page_id"), F.concat(F.lit("https://site.example/a/"), k).alias("url"), F.col("c_name").alias("title"), F.concat(talk, F.lit("<body>"), body, F.lit("</body>")).alias("html"), F.concat(F.lit("Summary of "), "c_name").alias("summary"))
    listed = lambda i: F.concat(F.lit('<li class="posting_element"><span class="pseudonym">user'), i.cast("string"), F.lit('</span><a class="posting_subject" href="/p/'), i.cast("string"), F.lit('"> subject '), i.cast("string"), F.lit("</a></li>"))
    full = lambda i: F.concat(F.lit('<div class="posting"><div class="text"><p>said '), i.cast("string"), F.lit("</p></div></div>"))
    posts = F.when(n == 3, F.concat(F.lit("<ul>"), _each(listed, 4), F.lit("</ul>"))).otherwise(_each(full, 4))
    forums = c.table("customer").select(F.concat(F.lit("https://site.example/forum/"), k).alias("url"), posts.alias("html"))
    lead = c.table("customer").where("c_custkey % 3 = 0").select(F.col("c_custkey").alias("page_id"), F.concat(F.lit("/lead"), k, F.lit(".jpg")).alias("image"))
    made = sites.site_documents(fetched, sites.SITES["heise"], forums, (threads.DIALECTS["heise_list"], threads.DIALECTS["heise"]), 2, lead)
    rows = blocks.nested_blocks(pages.nodes(scratch.table(made, "documents"), stored=False)).where("kind not in ('blockquote')")
    said = F.coalesce(F.regexp_replace("image_ref", r"^https://cdn\.example/\.\./", "/"), text_of())
    return rows.groupBy("page_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", F.concat("kind", F.lit(":"), said).alias("x")))), lambda r: r["x"]), " / ").alias("shown"))


def text_of() -> Column:
    return F.array_join(F.transform("runs", lambda r: r["text"]), "")

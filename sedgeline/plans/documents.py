"""Queries over pages, with SQL where regular expressions can tell the result."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sedgeline.catalog import Catalog
from sedgeline.operators import markdown, pages
from sedgeline.plans.relational import query


def tree(c: Catalog) -> DataFrame:
    return pages.nodes(c.table("pages"), stored=False)


def bases(c: Catalog) -> DataFrame:
    return c.table("pages").select("page_id", F.col("url").alias("base"))


@query("page_title", "SELECT page_id, replace(replace(replace(regexp_extract(html, '<title>([^<]*)', 1), '&lt;', '<'), '&gt;', '>'), '&amp;', '&') AS title FROM pages WHERE contains(html, '<title>')", views=False)
def page_title(c: Catalog) -> DataFrame:
    return pages.titles(c.table("pages"))


@query("page_links", "SELECT page_id, unnest(regexp_extract_all(replace(html, '&amp;', '&'), '<a href=\"([^\"]*)\"', 1)) AS href FROM pages", views=False)
def page_links(c: Catalog) -> DataFrame:
    return pages.links(tree(c), bases(c)).select("page_id", "href")


@query("page_comments", "SELECT page_id, len(regexp_extract_all(html, '<!--')) AS comments FROM pages WHERE contains(html, '<!--')", views=False)
def page_comments(c: Catalog) -> DataFrame:
    return tree(c).where("tag = '#comment'").groupBy("page_id").agg(F.count(F.lit(1)).alias("comments"))


@query("page_element_counts", "SELECT page_id, len(regexp_extract_all(html, '<article[ >]')) AS articles, len(regexp_extract_all(html, '<li[ >]')) AS items, len(regexp_extract_all(html, 'class=\"ad\"')) AS ads FROM pages", views=False)
def page_element_counts(c: Catalog) -> DataFrame:
    ads = F.coalesce(F.col("attrs")["class"] == "ad", F.lit(False))
    return tree(c).groupBy("page_id").agg(F.count_if(F.col("tag") == "article").alias("articles"), F.count_if(F.col("tag") == "li").alias("items"), F.count_if(ads).alias("ads"))


@query("page_blocks")
def page_blocks(c: Catalog) -> DataFrame:
    return pages.blocks(pages.main_content(tree(c), ignore=(".ad",)))


@query("tree_rebuild")
def tree_rebuild(c: Catalog) -> DataFrame:
    return pages.rebuilt_tree(pages.stored_blocks(page_blocks(c))).select("article_id", "kind", "depth", "path", "text")


@query("wire_documents")
def wire_documents(c: Catalog) -> DataFrame:
    return pages.wire_document(pages.stored_blocks(page_blocks(c)))


@query("wire_round_trip")
def wire_round_trip(c: Catalog) -> DataFrame:
    return pages.read_wire(wire_documents(c))


@query("post_html", """
    SELECT conv_id, turn, '<p>' || x || '</p>
<ul><li>' || x || '</li><li><strong>' || turn || '</strong></li></ul>
<h2>' || role || '</h2>' AS html
    FROM (SELECT conv_id, turn, role, trim(regexp_replace(text, '[^A-Za-z ]', 'e', 'g') || 'e') AS x FROM conversations)""", views=False)
def post_html(c: Catalog) -> DataFrame:
    plain = F.trim(F.concat(F.regexp_replace("text", "[^A-Za-z ]", "e"), F.lit("e")))
    body = F.concat(plain, F.lit("\n\n- "), plain, F.lit("\n- **"), F.col("turn").cast("string"), F.lit("**\n## "), F.col("role"))
    posts = c.table("conversations").select(F.struct("conv_id", "turn").alias("key"), body.alias("body"))
    return markdown.to_html(posts, "key", "body").select("key.conv_id", "key.turn", "html")


@query("post_lists", """
    SELECT conv_id, turn, (SELECT string_agg('<ul><li>l' || i, '' ORDER BY i) FROM range(0, turn % 6 + 1) t(i)) || repeat('</li></ul>', turn % 6 + 1) || chr(10) || repeat('<blockquote>', turn % 11 + 1) || '<p>said</p>' || repeat('</blockquote>', turn % 11) || '<p>back</p></blockquote>' AS html FROM conversations""", views=False)
def post_lists(c: Catalog) -> DataFrame:
    """Lists and quotes as deep as the turn says."""
    turn = F.col("turn")
    items = F.array_join(F.transform(F.sequence(F.lit(0).cast("long"), (turn % 6).cast("long")), lambda i: F.concat(F.repeat(F.lit("  "), i.cast("int")), F.lit("- l"), i.cast("string"))), "\n")
    body = F.concat(items, F.lit("\n\n"), F.repeat(F.lit(">"), (turn % 11 + 1).cast("int")), F.lit(" said\n> back"))
    posts = c.table("conversations").select(F.struct("conv_id", "turn").alias("key"), body.alias("body"))
    return markdown.to_html(posts, "key", "body").select("key.conv_id", "key.turn", "html")


@query("fn_entities", "SELECT page_id, html LIKE '%&amp;%' AS coded, replace(replace(replace(replace(html, '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&amp;', '&') AS decoded FROM pages", views=False)
def fn_entities(c: Catalog) -> DataFrame:
    return c.table("pages").select("page_id", F.contains("html", F.lit("&amp;")).alias("coded"), markdown.decode_entities(F.col("html")).alias("decoded"))

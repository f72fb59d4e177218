"""Queries over nested blocks, their trees and wire documents, on pages whose nesting varies from row to row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sedgeline import scratch
from sedgeline.catalog import Catalog
from sedgeline.operators import blocks, pages, trees
from sedgeline.plans.relational import query

#: How deep a customer's page nests lists and quotes, and whether its quote holds a list.
DEPTH, QUOTES, LISTED = "(c_custkey % 5 + 1)", "(c_custkey % 4)", "c_custkey % 2 = 0"


def html() -> Column:
    k = F.col("c_custkey")
    depth, quotes = (k % 5 + 1).cast("int"), (k % 4).cast("int")
    listed = F.when(k % 2 == 0, '<ol>loose<li>one</li><p>dropped</p><li><img data-src="/i.jpg"></li></ol>').otherwise("")
    return F.concat(
        F.lit("<body>"), F.repeat(F.lit("<ul><li>"), depth), F.lit("deep <b>"), F.col("c_name"), F.lit("</b>"), F.repeat(F.lit("</li><li> </li></ul>"), depth), F.repeat(F.lit("<blockquote>"), quotes), F.lit("<p>said</p>"), listed,
        F.repeat(F.lit("</blockquote>"), quotes), F.lit("<blockquote><ul><li></li></ul></blockquote>end <form>no</form>of page</body>"),
    )


def nested(c: Catalog) -> DataFrame:
    found = pages.nodes(c.spread("customer").select(F.col("c_custkey").alias("page_id"), html().alias("html")), stored=False)
    return blocks.nested_blocks(pages.main_content(found))


def told(c: Catalog) -> DataFrame:
    """The pages' trees, stored."""
    return scratch.table(trees.stored(nested(c)), "trees")


def typed(c: Catalog) -> DataFrame:
    """The pages' typed blocks; the table of their trees goes once the blocks' ways are stored."""
    with scratch.step(c.spark, "told") as path:
        rows = told(c)
    made = trees.typed(rows)
    scratch.drop(c.spark, path, made)
    return made


def articles(c: Catalog) -> DataFrame:
    return c.table("customer").select(F.col("c_custkey").alias("article_id"))


_QUOTED = f"CASE WHEN {QUOTES} = 0 THEN '' ELSE '1' || repeat('.0', {QUOTES} - 1) || '.' END"
_ROWS = f"""
    rows_ AS (
        SELECT c_custkey AS article_id, '0' || repeat('.0.0', i) AS path, 'list' AS kind, NULL AS text FROM customer, range(0, {DEPTH}) t(i)
        UNION ALL SELECT c_custkey, '0' || repeat('.0.0', i) || '.0', 'list_item', NULL FROM customer, range(0, {DEPTH}) t(i)
        UNION ALL SELECT c_custkey, '0' || repeat('.0.0', {DEPTH} - 1) || '.0.0', 'paragraph', 'deep ' || c_name FROM customer
        UNION ALL SELECT c_custkey, '1' || repeat('.0', i), 'blockquote', NULL FROM customer, range(0, {QUOTES}) t(i)
        UNION ALL SELECT c_custkey, CASE WHEN {QUOTES} = 0 THEN '1' ELSE {_QUOTED} || '0' END, 'paragraph', 'said' FROM customer
        UNION ALL SELECT c_custkey, CASE WHEN {QUOTES} = 0 THEN '2' ELSE {_QUOTED} || '1' END || p, kind, text FROM customer, (VALUES ('', 'list', NULL), ('.0', 'list_item', NULL), ('.1', 'list_item', NULL), ('.0.0', 'paragraph', 'one'), ('.1.0', 'image', '/i.jpg')) t(p, kind, text) WHERE {LISTED}
        UNION ALL SELECT c_custkey, CASE WHEN {QUOTES} = 0 AND {LISTED} THEN '3' ELSE '2' END, 'paragraph', 'end of page' FROM customer)"""


@query("nested_blocks", f"WITH {_ROWS} SELECT * FROM rows_", views=False)
def nested_blocks(c: Catalog) -> DataFrame:
    """Blocks by their way from the top of the page."""
    path = F.array_join(F.transform("way", lambda w: w["position"].cast("string")), ".")
    said = F.when(F.col("kind") == "paragraph", F.array_join(F.transform("runs", lambda r: r["text"]), "")).otherwise(F.col("image_ref"))
    return typed(c).select("article_id", path.alias("path"), "kind", said.alias("text"))


@query("nested_text", f"SELECT c_custkey AS page_id, 'deep ' || c_name || chr(10) || chr(10) || 'said' || CASE WHEN {LISTED} THEN chr(10) || chr(10) || 'one' ELSE '' END || chr(10) || chr(10) || 'end of page' AS plain_text FROM customer", views=False)
def nested_text(c: Catalog) -> DataFrame:
    return blocks.plain_text(nested(c))


def _paragraph(*runs: tuple[str, str]) -> str:
    """SQL of a paragraph on the wire; runs are SQL of texts and styles."""
    made = " || ',' || ".join("'{\"text\":\"' || " + t + " || '\",\"styles\":[" + s + "],\"link\":null}'" for t, s in runs)
    return "'{\"type\":\"paragraph\",\"runs\":[' || " + made + " || ']}'"


_DOCUMENT = f"""
    docs AS (SELECT c_custkey AS article_id, 1 AS version, '{{"version":1,"blocks":[' || repeat('{{"type":"list","ordered":false,"items":[[', {DEPTH}) || {_paragraph(("'deep '", ""), ("c_name", '"bold"'))} || repeat(']]}}', {DEPTH}) || ',' || repeat('{{"type":"blockquote","blocks":[', {QUOTES}) || {_paragraph(("'said'", ""))} ||
        CASE WHEN {LISTED} THEN ',{{"type":"list","ordered":true,"items":[[' || {_paragraph(("'one'", ""))} || '],[{{"type":"image","ref":"/i.jpg","caption":[]}}]]}}' ELSE '' END || repeat(']}}', {QUOTES}) || ',' || {_paragraph(("'end '", ""), ("'of page'", ""))} || ']}}' AS document FROM customer)"""


@query("tree_documents", f"WITH {_DOCUMENT} SELECT * FROM docs", views=False)
def tree_documents(c: Catalog) -> DataFrame:
    return trees.documents(typed(c), articles(c))


@query("tree_round_trip", f"WITH {_ROWS}, {_DOCUMENT} SELECT article_id, document, (SELECT count(*) FROM rows_ r WHERE r.article_id = d.article_id) AS blocks FROM docs d", views=False)
def tree_round_trip(c: Catalog) -> DataFrame:
    """Documents of the rows that documents were read into, and how many rows that were."""
    with scratch.step(c.spark, "first") as before:
        first = tree_documents(c)
    with scratch.step(c.spark, "read") as path:
        back = scratch.table(trees.read_documents(first), "trees")
    scratch.drop(c.spark, before)
    counts, made = scratch.table(trees.block_counts(back), "counts"), trees.documents(trees.typed(back), articles(c))
    scratch.drop(c.spark, path, made)
    return made.join(pages.shuffled(counts), "article_id").select("article_id", "document", "blocks")


@query("tree_replaced", f"""
    WITH {_ROWS} SELECT article_id, count(*) AS blocks FROM rows_ WHERE article_id % 3 <> 0 GROUP BY article_id UNION ALL SELECT c_custkey, 1 FROM customer WHERE c_custkey % 3 = 0 AND c_custkey % 2 = 0""", views=False)
def tree_replaced(c: Catalog) -> DataFrame:
    """Of every third article the tree is replaced, by one paragraph if its number is even, else by nothing."""
    old, path = told(c), scratch.new_path(c.spark, "stored-trees")
    trees.write_trees(path, old, articles(c))
    third = articles(c).where("article_id % 3 = 0")
    fresh = old.where("article_id % 6 = 0 AND parent_id IS NULL AND position = 1").withColumns({"kind": F.lit("paragraph"), "position": F.lit(0)})
    trees.write_trees(path, fresh, third)
    return trees.block_counts(trees.read_trees(path, old))


_STRAY = """
    (0, 'r', NULL, 0, 'list'), (0, 'i', 'r', 0, 'list_item'), (0, 'p', 'i', 0, 'paragraph'), (0, 's', 'r', 1, 'paragraph'), (0, 't', NULL, 1, 'list_item'), (0, 'u', 't', 0, 'paragraph'), (0, 'o', 'gone', 0, 'paragraph'), (0, 'q', NULL, 2, 'blockquote'),
    (0, 'x', 'q', 0, 'mystery'), (0, 'y', 'x', 0, 'paragraph'), (0, 'z', 'q', 1, 'list_item'), (0, 'w', 'p', 0, 'paragraph'), (0, 'n', 'r', 2, 'list'), (0, 'm', 'n', 0, 'divider'), (1, 'd', NULL, 0, 'divider'), (1, 'h', 'd', 0, 'heading')"""


@query("tree_typed", """
    SELECT c_custkey AS article_id, path, kind FROM customer, (VALUES (0, '0', 'list'), (0, '0.0', 'list_item'), (0, '0.0.0', 'paragraph'), (0, '0.1', 'list_item'), (0, '0.1.0', 'paragraph'), (0, '2', 'blockquote'), (0, '0.2', 'list_item'), (0, '0.2.0', 'list'), (0, '0.2.0.0', 'list_item'),
        (0, '0.2.0.0.0', 'divider'), (1, '0', 'divider')) t(half, path, kind) WHERE c_custkey % 2 = half""", views=False)
def tree_typed(c: Catalog) -> DataFrame:
    """Rows with strays, orphans, unknown kinds and items out of place: half of the customers have one set, half the other."""
    k = F.col("c_custkey").cast("string")
    sets = c.spark.sql(f"SELECT * FROM (VALUES {_STRAY}) t(half, name, above, position, kind)")  # sixteen rows
    rows = c.table("customer").join(F.broadcast(sets), F.col("c_custkey") % 2 == F.col("half"))
    name = lambda n: F.concat(k, F.lit("/"), F.col(n))
    shown = rows.select(F.col("c_custkey").alias("article_id"), name("name").alias("block_id"), name("above").alias("parent_id"), "position", "kind")
    empty = c.spark.createDataFrame([], trees.STORED)
    path = F.array_join(F.transform("way", lambda w: w["position"].cast("string")), ".")
    return trees.typed(empty.unionByName(shown, allowMissingColumns=True)).select("article_id", path.alias("path"), "kind")

"""Trees of blocks: stored rows with parents, typed rebuild, replacement of an article's tree, and the wire document.

A row learns its way from the root among the rows of its article, level by level; where a parent is in another article, by
doubling: in each round it takes over what the ancestor that it knows has learned.  Sorted by these ways, an article's rows are in the order of its document, so the nested JSON is one pass: a row opens itself, and closes
those of its ancestors that the next row no longer lies in.

Defined results: orphans, rows of unknown kinds and rows below a block that holds none are left out with all below them, and
so are items at the top or in other things than lists; other blocks right in a list get an item of their own.  An article
without blocks has an empty document.  Rows that are each other's ancestors are an error, and so is a document of another
version; unknown blocks and styles of a document are skipped, absent values are empty.  A document of some thousand levels
is more than JSON readers take and is an error; rows have no such bound.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StructField, StructType

from sedgeline import scratch
from sedgeline.operators.blocks import RUN

#: Kinds that are stored, names on the wire, providers, styles.
NAMES = {"paragraph": "paragraph", "heading": "heading", "list": "list", "blockquote": "blockquote", "image": "image", "embed": "embed", "code_block": "codeBlock", "divider": "divider"}
PROVIDERS = ("youtube", "dailymotion", "tweet", "video", "generic")
STYLES = ("bold", "italic", "code", "strikethrough")
VERSION = 1
BUCKETS = 64
READ_ROWS = 5000  # of many small documents, sent on together

STORED = f"article_id long, block_id string, parent_id string, position int, kind string, level int, ordered boolean, runs array<{RUN}>, text string, image_ref string, embed_provider string, embed_url string, thumbnail string, title string, language string"
_COLUMNS = [c.split()[0] for c in STORED.replace(f"array<{RUN}>", "x").split(", ")]
_OWN = _COLUMNS[5:]


def _id(*parts: Column) -> Column:
    return F.sha2(F.concat_ws("/", *parts), 256)


def stored(blocks: DataFrame) -> DataFrame:
    """Nested blocks of pages as ``STORED`` rows; ids are hashes of page and place, so a second run gives the same."""
    own = lambda c: F.when(F.col(c).isNotNull(), _id(F.col("page_id").cast("string"), F.col(c).cast("string")))
    return blocks.select(F.col("page_id").alias("article_id"), own("pos").alias("block_id"), own("parent_pos").alias("parent_id"), "position", "kind", *_OWN)


def with_ways(rows: DataFrame, **learned: Column) -> DataFrame:
    """Rows that hang together from a root (no ``parent_id``) down, with an array for each of ``learned``: its values from
    the root to the row itself.

    Rows are dealt by ``article_id``, so that a row's ancestors are at hand, and written once.  Only if a parent is in
    another article than its row, or an article has two rows of one id, ways are learned by joins."""
    told = rows.where("block_id is not null").select(*rows.columns, *[c.alias(n) for n, c in learned.items()])
    fields = [StructField(f.name, ArrayType(f.dataType), True) if f.name in learned else f for f in told.schema.fields]
    schema = StructType([StructField(f.name, f.dataType, True) for f in fields] + [StructField("__state", IntegerType(), True)])
    names, spark = list(learned), rows.sparkSession

    def walked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _whole_articles(batches):
            yield from _walked(table, names).to_batches()

    with scratch.step(spark, "ways") as path:
        out = scratch.table(told.repartition("article_id").sortWithinPartitions("article_id").mapInArrow(walked, schema), "tree")
    states = {r["__state"] for r in out.select("__state").distinct().collect()}
    lost = out.where(F.col("__state") == LOST).select(F.col("parent_id").alias("block_id"))
    if TWICE in states or (LOST in states and not out.select("block_id").join(lost.hint("merge"), "block_id", "left_semi").isEmpty()):
        scratch.drop(spark, path)
        return _ways_by_joins(rows, **learned)
    if CIRCLE in states:
        raise ValueError("blocks that are their own ancestors")
    return out.where(F.col("__state") == ROOTED).drop("__state")


#: What becomes of a row: it hangs from a root, has no parent, hangs from such a row, from itself, or its id is not its own.
ROOTED, LOST, BELOW_LOST, CIRCLE, TWICE = range(5)


def _whole_articles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Rows sorted by article, those of one article together."""
    held: list[pa.RecordBatch] = []
    for b in batches:
        if not b.num_rows:
            continue
        first, last = held[0]["article_id"][0] if held else b["article_id"][0], b["article_id"][-1]
        if first.equals(last) and first.is_valid == last.is_valid:
            held.append(b)
            continue
        codes = b["article_id"].dictionary_encode(null_encoding="encode").indices.to_numpy()
        start = int(np.argmax(codes == codes[-1]))
        yield pa.Table.from_batches([*held, b.slice(0, start)])
        held = [b.slice(start)]
    if held:
        yield pa.Table.from_batches(held)


def _walked(table: pa.Table, learned: list[str]) -> pa.Table:
    """Whole articles with the arrays of ``learned`` and ``__state``."""
    m, coded = table.num_rows, lambda c: c.dictionary_encode(null_encoding="encode").combine_chunks().indices.to_numpy().astype(np.int64)
    names = coded(pa.chunked_array([*table["block_id"].chunks, *table["parent_id"].chunks], table["block_id"].type))
    article, root = coded(table["article_id"]) * (len(names) + 1), table["parent_id"].is_null().to_numpy()
    ids, ups = article + names[:m], article + names[m:]
    order = np.argsort(ids, kind="stable")
    at = np.minimum(np.searchsorted(ids[order], ups), m - 1)
    found = ~root & (ids[order][at] == ups)
    up = np.concatenate((np.where(found, order[at], np.where(root, m, m + 1)), [m, m + 1]))  # all end in one of the last two
    steps, end = np.concatenate((np.ones(m, np.int64), [0, 0])), up.copy()
    for _ in range(m.bit_length() + 1):
        steps, end = steps + steps[end], end[end]
    state = np.select([end[:m] == m, (end[:m] == m + 1) & ~found, end[:m] == m + 1], [ROOTED, LOST, BELOW_LOST], CIRCLE).astype(np.int32)
    twice = ids[order][1:] == ids[order][:-1]
    state[order[1:][twice]] = TWICE
    lengths = np.where(end[:m] == m, steps[:m], 0)
    offsets = np.concatenate(([0], np.cumsum(lengths)))
    flat, now = np.zeros(offsets[-1], np.int64), np.flatnonzero(lengths)
    place = offsets[1:][now] - 1
    while len(now):  # a turn for each level
        flat[place] = now
        now, place = up[now], place - 1
        now, place = now[now < m], place[now < m]
    for name in learned:
        values = table[name].combine_chunks().take(pa.array(flat))
        table = table.set_column(table.column_names.index(name), name, pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), values))
    return table.append_column("__state", pa.array(state))


def _ways_by_joins(rows: DataFrame, **learned: Column) -> DataFrame:
    """:func:`with_ways`, wherever a row's parent is: in each round a row takes over what the ancestor that it knows has learned."""
    rows = scratch.table(rows, "tree")
    last = rows.count().bit_length() + 1
    state = rows.select("block_id", F.col("parent_id").alias("up"), *[F.array(c).alias(n) for n, c in learned.items()])
    done, waiting = state.where("up is null"), state.where("up is not null")
    for n in range(last + 1):
        if waiting.isEmpty():
            break
        if n == last:
            raise ValueError("blocks that are their own ancestors")
        above = done.unionByName(waiting).select(F.col("block_id").alias("up"), F.col("up").alias("__up"), *[F.col(c).alias(f"__{c}") for c in learned])
        step = waiting.join(above, "up").select("block_id", F.col("__up").alias("up"), *[F.concat(f"__{c}", c).alias(c) for c in learned])
        step = scratch.table(step, "tree-ways")
        done, waiting = done.unionByName(step.where("up is null")), step.where("up is not null")
    return rows.join(done.drop("up"), "block_id")


def typed(rows: DataFrame) -> DataFrame:
    """``STORED`` rows as blocks may hold each other, with ``way`` (places from the root) and ``kinds`` along it."""
    above = rows.select(F.col("block_id").alias("parent_id"), F.col("kind").alias("__above"))
    kind, holder = F.col("kind"), F.col("__above")
    block, item = kind.isin(*NAMES), kind == "list_item"
    fits = F.when(F.col("parent_id").isNull(), block).when(holder == "list", block | item).when(holder.isin("list_item", "blockquote"), block).otherwise(F.lit(False))
    kept = rows.join(above.hint("merge"), "parent_id", "left").where(fits).withColumn("stray", F.coalesce((holder == "list") & block, F.lit(False)))
    wrapped = _id(F.col("block_id"), F.lit("item"))
    moved = {"parent_id": F.when(F.col("stray"), wrapped).otherwise(F.col("parent_id")), "position": F.when(F.col("stray"), 0).otherwise(F.col("position"))}
    own = F.struct(*[moved.get(c, F.col(c)).alias(c) for c in _COLUMNS])
    item = {"article_id": F.col("article_id"), "block_id": wrapped, "parent_id": F.col("parent_id"), "position": F.col("position"), "kind": F.lit("list_item")}
    around = F.struct(*[item.get(c, F.lit(None).cast(rows.schema[c].dataType)).alias(c) for c in _COLUMNS])
    every = kept.select(F.inline(F.filter(F.array(own, F.when(F.col("stray"), around)), lambda x: x.isNotNull())))  # a stray with its item
    return with_ways(every, way=F.struct("position", F.xxhash64("block_id").alias("tie")), kinds=F.col("kind"))


def block_counts(rows: DataFrame) -> DataFrame:
    """``article_id, blocks``: rows of each article's tree."""
    return rows.groupBy("article_id").agg(F.count(F.lit(1)).alias("blocks"))


# --- replacement


def replaced(old: DataFrame, fresh: DataFrame, articles: DataFrame) -> DataFrame:
    """Rows of all articles: those of ``articles`` (``article_id``) have their fresh rows only, if any, the others their old ones."""
    return old.join(articles.select("article_id").distinct(), "article_id", "left_anti").unionByName(fresh.join(articles.select("article_id").distinct(), "article_id", "left_semi"))


def write_trees(path: str, fresh: DataFrame, articles: DataFrame, buckets: int = BUCKETS) -> None:
    """Replace the trees of ``articles`` in the table at ``path`` in one write: only their buckets are written again.

    An article without rows leaves a mark, so that a bucket with nothing else is replaced too."""
    spark, bucket = fresh.sparkSession, F.pmod(F.xxhash64("article_id"), F.lit(buckets)).cast("int")
    ids = articles.select("article_id").distinct()
    marks = ids.join(fresh.select("article_id").distinct(), "article_id", "left_anti").select("article_id", *[F.lit(None).cast(f.dataType).alias(f.name) for f in fresh.schema.fields if f.name != "article_id"])
    rows = fresh.unionByName(marks).withColumn("bucket", bucket)
    if _exists(path, fresh):
        touched = ids.select(bucket.alias("bucket")).distinct()  # at most so many buckets
        old = spark.read.parquet(path).join(F.broadcast(touched), "bucket", "left_semi").join(ids, "article_id", "left_anti")
        rows = rows.unionByName(old.select(*rows.columns))
    rows.repartition("bucket").write.partitionBy("bucket").mode("overwrite").option("partitionOverwriteMode", "dynamic").parquet(path)


def read_trees(path: str, like: DataFrame) -> DataFrame:
    """All rows of the table at ``path``."""
    return like.sparkSession.read.parquet(path).where("block_id is not null").select(*like.columns)


def _exists(path: str, like: DataFrame) -> bool:
    p = like.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(like.sparkSession._jsc.hadoopConfiguration()).exists(p)


# --- wire documents


def _wire_runs(runs: str) -> Column:
    styles = lambda r: F.filter(F.array(*[F.when(r[s], s) for s in STYLES]), lambda x: x.isNotNull())
    return F.transform(F.coalesce(runs, F.array().cast(f"array<{RUN}>")), lambda r: F.struct(F.coalesce(r["text"], F.lit("")).alias("text"), styles(r).alias("styles"), F.nullif(r["link"], F.lit("")).alias("link")))


def _json(*fields: Column) -> Column:
    return F.to_json(F.struct(*fields), {"ignoreNullFields": "false"})


def _opened() -> Column:
    """What a row writes before the blocks that it holds; a block without any is written whole."""
    kind = lambda name: F.lit(NAMES[name]).alias("type")
    told = lambda c: F.nullif(F.col(c), F.lit(""))
    level = F.least(F.greatest(F.coalesce("level", F.lit(1)), F.lit(1)), F.lit(6))
    provider = F.when(F.col("embed_provider").isin(*PROVIDERS), F.col("embed_provider")).otherwise(F.lit("generic"))
    listed = F.concat(F.lit('{"type":"list","ordered":'), F.coalesce("ordered", F.lit(False)).cast("string"), F.lit(',"items":['))
    forms = {
        "paragraph": _json(kind("paragraph"), _wire_runs("runs").alias("runs")), "heading": _json(kind("heading"), level.alias("level"), _wire_runs("runs").alias("runs")), "list": listed, "list_item": F.lit("["), "blockquote": F.lit('{"type":"blockquote","blocks":['),
        "image": _json(kind("image"), F.coalesce("image_ref", F.lit("")).alias("ref"), _wire_runs("runs").alias("caption")),
        "embed": _json(kind("embed"), provider.alias("provider"), told("thumbnail").alias("thumbnailRef"), F.coalesce("embed_url", F.lit("")).alias("externalURL"), told("title").alias("title")),
        "code_block": _json(kind("code_block"), F.coalesce("text", F.lit("")).alias("text"), told("language").alias("language")), "divider": _json(kind("divider")),
    }
    return F.coalesce(*[F.when(F.col("kind") == k, c) for k, c in forms.items()])


def documents(rows: DataFrame, articles: DataFrame) -> DataFrame:
    """``article_id, version, document`` of each of ``articles`` from its rows of :func:`typed`."""
    order = Window.partitionBy("article_id").orderBy("way")
    depth, after = F.size("way"), F.coalesce(F.lead(F.size("way")).over(order), F.lit(1))
    closing = {"list": "]}", "list_item": "]", "blockquote": "]}"}
    ended = F.slice("kinds", F.col("after"), F.greatest(F.col("depth") - F.col("after") + 1, F.lit(0)))
    closed = F.array_join(F.transform(F.reverse(ended), lambda k: F.coalesce(*[F.when(k == n, c) for n, c in closing.items()], F.lit(""))), "")
    lines = rows.withColumns({"depth": depth, "after": after, "comma": F.coalesce(F.lag(depth).over(order) >= depth, F.lit(False)), "n": F.row_number().over(order)})
    parts = lines.select("article_id", "n", F.concat(F.when(F.col("comma"), ",").otherwise(""), _opened(), closed).alias("part"))
    told = parts.groupBy("article_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "part"))), lambda p: p["part"]), "").alias("body"))  # one article's
    whole = F.concat(F.lit(f'{{"version":{VERSION},"blocks":['), F.coalesce("body", F.lit("")), F.lit("]}"))
    return articles.select("article_id").distinct().join(told.hint("merge"), "article_id", "left").select("article_id", F.lit(VERSION).alias("version"), whole.alias("document"))


def _text(x: object) -> str:
    return x if isinstance(x, str) else ""


def _level(x: object) -> int:
    try:
        return min(max(int(float(x)), 1), 6) if isinstance(x, (int, float, str)) and not isinstance(x, bool) else 1
    except (ValueError, OverflowError):
        return 1


def _runs(items: object) -> list[dict]:
    out = []
    for x in items if isinstance(items, list) else []:
        if isinstance(x, dict):
            styles = x["styles"] if isinstance(x.get("styles"), list) else []
            out.append({"text": _text(x.get("text")), **{s: s in styles for s in STYLES}, "link": _text(x.get("link"))})
    return out


def _own_values(kind: str, x: dict) -> dict:
    """A wire block's own columns."""
    if kind in ("paragraph", "heading"):
        return {"runs": _runs(x.get("runs"))} | ({"level": _level(x.get("level", 1))} if kind == "heading" else {})
    if kind == "list":
        return {"ordered": bool(x.get("ordered"))}
    if kind == "image":
        return {"image_ref": _text(x.get("ref")), "runs": _runs(x.get("caption"))}
    if kind == "embed":
        provider = _text(x.get("provider"))
        return {"embed_provider": provider if provider in PROVIDERS else "generic", "embed_url": _text(x.get("externalURL")), "thumbnail": _text(x.get("thumbnailRef")), "title": _text(x.get("title"))}
    return {"text": _text(x.get("text")), "language": _text(x.get("language"))} if kind == "code_block" else {}


def decoded(article: int | None, document: str) -> Iterator[dict]:
    """Rows of a wire document, from the top down; ids are the places from the root."""
    try:
        read = json.loads(document)
    except RecursionError:
        raise ValueError("a document of too many levels") from None
    if not isinstance(read, dict) or isinstance(read.get("version"), bool) or read.get("version") != VERSION:
        raise ValueError(f"unknown document version: {document[:40]}")
    kinds = {wire: kind for kind, wire in NAMES.items()}
    waiting = [(read.get("blocks"), None)]
    while waiting:
        blocks, parent = waiting.pop()
        known = [x for x in blocks if isinstance(x, dict) and isinstance(x.get("type"), str) and x["type"] in kinds] if isinstance(blocks, list) else []
        for at, x in enumerate(known):
            kind, name = kinds[x["type"]], f"{parent or article}.{at}"
            yield {"article_id": article, "block_id": name, "parent_id": parent, "position": at, "kind": kind} | _own_values(kind, x)
            if kind == "blockquote":
                waiting.append((x.get("blocks"), name))
            if kind == "list":
                for i, held in enumerate(x["items"] if isinstance(x.get("items"), list) else []):
                    yield {"article_id": article, "block_id": f"{name}.{i}", "parent_id": name, "position": i, "kind": "list_item"}
                    waiting.append((held, f"{name}.{i}"))


def read_documents(docs: DataFrame) -> DataFrame:
    """``STORED`` rows of ``article_id, document``."""
    flags = [pa.field(s, pa.bool_()) for s in STYLES]
    run = pa.list_(pa.struct([pa.field("text", pa.string()), *flags, pa.field("link", pa.string())]))
    special = {"article_id": pa.int64(), "position": pa.int32(), "level": pa.int32(), "ordered": pa.bool_(), "runs": run}
    schema = pa.schema([(c, special.get(c, pa.string())) for c in _COLUMNS])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            held: list[dict] = []
            for article, document in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                if document.is_valid:
                    held += decoded(article, document.as_py())
                if len(held) > READ_ROWS:
                    yield pa.RecordBatch.from_pylist(held, schema=schema)
                    held = []
            if held:
                yield pa.RecordBatch.from_pylist(held, schema=schema)

    return docs.select(F.col("article_id").cast("long"), "document").mapInArrow(read, STORED)

"""Exact dedup with a heavy-hitter split, in DataFrame functions only.

1. One pass digests every whole text (A-Z lower-cased, UTF-8, SHA-256) into a narrow table (row id, id, digest).
2. A Misra-Gries sketch (``approx_top_k`` is the frequent-items variant of it: bounded counters, merged map-side) names
   the digests that may be frequent.  At most ``max_heavy`` of them, so the candidate list has a fixed size.
3. The candidates' true counts and staying rows are computed exactly; these verified winners are broadcast and label
   their copies without a shuffle, so a group of a third of all rows never meets in one task.
4. All other digests are grouped by an ordinary shuffle with map-side partial aggregation.

The sketch steers only how a digest is processed: a frequent digest that it misses is still grouped right.

Defined results: a null text counts as empty, so null and empty texts are copies of each other.  A null id is smaller
than any other.  Rows repeated with the same id and text: one of them stays.  An empty table gives an empty table.
Other columns, whatever their names, are ignored by :func:`exact_groups` and pass through :func:`drop_exact_copies`.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField

from sedgeline.llm import scratch

SKETCH_ITEMS = 4096
MAX_HEAVY = 512


def text_digest(text: Column) -> Column:
    """Lower-case hex SHA-256 of the text with A-Z (only) lower-cased; null counts as empty."""
    lowered = F.translate(F.coalesce(text, F.lit("")), string.ascii_uppercase, string.ascii_lowercase)
    return F.sha2(lowered, 256)


def _groups(docs: DataFrame, id_col: str, text_col: str, max_heavy: int) -> DataFrame:
    """One row per input row: ``doc_id, text_sha256, n, w`` (null for texts that are alone) ``, rid, heavy``."""
    rows = scratch.table(
        docs.select(F.col(id_col).alias("doc_id"), text_digest(F.col(text_col)).alias("text_sha256")).withColumn("rid", F.monotonically_increasing_id()),
        "digests",
    )
    sketch = rows.agg(F.expr(f"approx_top_k(text_sha256, {max_heavy}, {SKETCH_ITEMS})").alias("top"))
    candidates = sketch.select(F.explode_outer("top").alias("t")).where("t.count > 1").select(F.col("t.item").alias("text_sha256"))
    winner = F.max(F.struct("doc_id", "rid"))
    # at most max_heavy rows on either side of the next two broadcasts
    heavy = rows.join(F.broadcast(candidates), "text_sha256").groupBy("text_sha256").agg(winner.alias("w"), F.count(F.lit(1)).alias("n")).where("n > 1")
    heavy = scratch.table(heavy, "heavy")
    labelled = rows.join(F.broadcast(heavy), "text_sha256", "left")
    rest = rows.join(F.broadcast(heavy.select("text_sha256")), "text_sha256", "left_anti")
    groups = rest.groupBy("text_sha256").agg(winner.alias("w"), F.count(F.lit(1)).alias("n")).where("n > 1")
    return labelled.where("n is not null").withColumn("heavy", F.lit(True)).unionByName(rest.join(groups, "text_sha256", "left").withColumn("heavy", F.lit(False)))


def _kept() -> Column:
    return F.col("n").isNull() | (F.col("w.rid") == F.col("rid"))


def _orderable(field: StructField) -> Column:
    """A column by which rows can be ordered: itself, or its JSON where a map or variant in it has no order."""
    kind = field.dataType.simpleString()
    c = F.col(f"`{field.name}`")
    return F.to_json(F.struct(c.alias("c"))) if "map<" in kind or "variant" in kind else c


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_heavy: int = MAX_HEAVY) -> DataFrame:
    """One row per input row: ``doc_id, keep_id, group_size, kept, text_sha256``.  ``keep_id`` is the group's largest id."""
    return _groups(docs, id_col, text_col, max_heavy).select(
        "doc_id",
        F.when(F.col("n").isNull(), F.col("doc_id")).otherwise(F.col("w.doc_id")).alias("keep_id"),
        F.coalesce("n", F.lit(1).cast("long")).alias("group_size"),
        _kept().alias("kept"),
        "text_sha256",
    )


def drop_exact_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_heavy: int = MAX_HEAVY) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns.

    Copies of heavy digests go map-side: the digests and their winners' ids are broadcast.  Of the rest, the list of
    copies (ids and digests) is anti-joined.  Where copies share even their id, the smallest row of them stays (maps count by
    their JSON); only then rows are grouped as a whole."""
    own, winner_id, loser_id = "__sedgeline_own", "__sedgeline_winner", "__sedgeline_id"
    groups = scratch.table(_groups(docs, id_col, text_col, max_heavy).where("n is not null").withColumn("kept", _kept()), "groups")
    twins = F.col("doc_id").eqNullSafe(F.col("w.doc_id"))
    out = docs.withColumn(own, text_digest(F.col(text_col)))
    heavy = groups.where("heavy and kept").select(F.col("text_sha256").alias("__sedgeline_heavy"), F.col("doc_id").alias(winner_id))
    out = out.join(F.broadcast(heavy), F.col(own) == F.col("__sedgeline_heavy"), "left")  # at most max_heavy rows
    out = out.where(F.col("__sedgeline_heavy").isNull() | F.col(id_col).eqNullSafe(F.col(winner_id))).drop("__sedgeline_heavy", winner_id)
    losers = scratch.table(groups.where(~F.col("heavy") & ~F.col("kept") & ~twins).select(F.col("doc_id").alias(loser_id), F.col("text_sha256").alias("__sedgeline_digest")).distinct(), "losers")
    out = out.join(losers, (F.col(own) == F.col("__sedgeline_digest")) & F.col(id_col).eqNullSafe(F.col(loser_id)), "left_anti")
    if groups.where(~F.col("kept") & twins).limit(1).count():
        order = F.struct(*[_orderable(f).alias(f"c{i}") for i, f in enumerate(docs.schema.fields)])
        out = out.groupBy(id_col, own).agg(F.min_by(F.struct(*docs.columns), order).alias("__sedgeline_row")).select("__sedgeline_row.*")
    return out.select(*docs.columns)

"""Full-text search: folded tokens, phrases that are ANDed, the last token as a prefix.

Two forms with the same result: a filter over folded text for one pass, and a token table (an inverted index) for
repeated searches.  :func:`stored` writes it once, partitioned by the token's first letter and sorted by token, so that a
lookup reads the partitions and row groups of its own tokens.  A lookup scans the table once, however many tokens it has.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sedgeline import scratch
from sedgeline.functions import text

COLUMNS = ("name", "plain_text")
BUCKETS, SALTS = 64, 8


@dataclass(frozen=True)
class Phrase:
    tokens: tuple[str, ...]
    prefix: bool = False


def _tokens(raw: str) -> tuple[str, ...]:
    return tuple(t for t in re.split(r"[\W_]+", text.fold_text(raw)) if t)


def compile_term(term: str) -> list[Phrase] | None:
    """Words between white space, each a phrase of its tokens; null if nothing is left to search for.

    Control characters are deleted, so they don't part a word."""
    words = [_tokens(re.sub(r"[\x00-\x1f\x7f]", "", w)) for w in re.split(r"[\s\ufeff]+", term)]
    words = [w for w in words if w]
    return [Phrase(w, i == len(words) - 1) for i, w in enumerate(words)] or None


def token_text(c: Column) -> Column:
    """The tokens of a text between single spaces, with one at either end."""
    return F.concat(F.lit(" "), F.regexp_replace(text.fold(F.coalesce(c, F.lit(""))), text.SEPARATORS, " "), F.lit(" "))


def phrase_in(token_text: Column, phrase: Phrase) -> Column:
    """Whether the phrase's tokens follow each other, the last as a prefix if asked for."""
    return F.contains(token_text, F.lit(" " + " ".join(phrase.tokens) + ("" if phrase.prefix else " ")))


def search(rows: DataFrame, term: str, columns: tuple[str, ...] = COLUMNS) -> DataFrame:
    """Rows where each phrase lies within one of the columns; all rows if there is nothing to search for."""
    for p in compile_term(term) or []:
        rows = rows.where(reduce(Column.__or__, [phrase_in(token_text(F.col(c)), p) for c in columns]))
    return rows


def index(rows: DataFrame, key: str, columns: tuple[str, ...] = COLUMNS) -> DataFrame:
    """Token table ``key, column, pos, token``."""
    parts = [rows.select(key, F.lit(c).alias("column"), F.posexplode(text.tokens(F.coalesce(F.col(c), F.lit("")))).alias("pos", "token")) for c in columns]
    return reduce(DataFrame.unionByName, parts)


def refreshed(old: DataFrame, before: DataFrame, now: DataFrame, key: str, columns: tuple[str, ...] = COLUMNS) -> DataFrame:
    """The token table after changes: only rows whose text changed are tokenized again."""
    told = F.sha2(F.to_json(F.struct(*columns)), 256).alias("__told")  # texts don't move, their hashes do
    same = before.select(key, told).join(now.select(key, told), [key, "__told"], "left_semi").select(key)
    changed = now.join(same, key, "left_anti")
    return old.join(same, key, "left_semi").unionByName(index(changed, key, columns))


def _bucket(token: Column) -> Column:
    """Partition of a token: by its first letter, which a prefix has too."""
    return F.pmod(F.xxhash64(F.left(token, F.lit(1))), F.lit(BUCKETS)).cast("int")


def stored(tokens: DataFrame, label: str = "search-index") -> DataFrame:
    """The token table, written to the shared folder with its ``bucket`` as partition."""
    path = scratch.new_path(tokens.sparkSession, label)
    rows = tokens.withColumn("bucket", _bucket(F.col("token")))
    salt = F.pmod(F.xxhash64(*[c for c in tokens.columns if c != "token"]), F.lit(SALTS))  # a frequent word is dealt to several tasks
    rows.repartition("bucket", "token", salt).sortWithinPartitions("bucket", "token").write.partitionBy("bucket").parquet(path)
    return tokens.sparkSession.read.schema(rows.schema).parquet(path)


def lookup(tokens: DataFrame, key: str, term: str) -> DataFrame:
    """Keys that match, from the token table.

    One scan keeps the rows of the wanted tokens, each with the phrase and place that it serves; a phrase is where all
    places of one start are there, a match is a key with all phrases."""
    phrases = compile_term(term)
    if phrases is None:
        return tokens.select(key).distinct()
    wanted = [(n, i, t, p.prefix and i == len(p.tokens) - 1) for n, p in enumerate(phrases) for i, t in enumerate(p.tokens)]
    hit = lambda t, prefix: F.col("token").startswith(t) if prefix else F.col("token") == t
    if "bucket" in tokens.columns:  # literals, so that partitions are pruned
        tokens = tokens.where(F.col("bucket").isin([_bucket(F.lit(t)) for t in sorted({t[0] for _, _, t, _ in wanted})]))
    uses = F.array_compact(F.array(*[F.when(hit(t, prefix), F.struct(F.lit(n).alias("phrase"), F.lit(i).alias("i"))) for n, i, t, prefix in wanted]))
    rows = tokens.where(reduce(Column.__or__, [hit(t, prefix) for _, _, t, prefix in wanted])).select(key, "column", "pos", F.explode(uses).alias("use"))
    rows = rows.select(key, "column", "use.phrase", "use.i", (F.col("pos") - F.col("use.i")).alias("at"))
    size = reduce(lambda c, np: c.when(F.col("phrase") == np[0], len(np[1].tokens)), enumerate(phrases), F.when(F.lit(False), 0))
    whole = rows.groupBy(key, "column", "phrase", "at").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") == size)
    return whole.groupBy(key).agg(F.count_distinct("phrase").alias("n")).where(F.col("n") == len(phrases)).select(key)


# --- identifiers

GRAM, LEAST_QUERY, MOST_FOUND = 3, 2, 10


def grams(folded: Column) -> Column:
    """The distinct pieces of ``GRAM`` signs of a folded name, and its first two signs marked as such."""
    inner = F.transform(F.sequence(F.lit(1), F.greatest(F.length(folded) - GRAM + 1, F.lit(1))), lambda i: F.substring(folded, i, F.lit(GRAM)))
    inner = F.filter(inner, lambda g: F.length(g) == GRAM)
    return F.array_distinct(F.concat(F.array(F.concat(F.lit("^"), F.left(folded, F.lit(LEAST_QUERY)))), inner))


def identifier_index(names: DataFrame) -> DataFrame:
    """``gram, value, label, folded`` of identifiers ``value, label``, each label once with its smallest value."""
    rows = names.groupBy("label").agg(F.min("value").alias("value")).withColumn("folded", F.trim(text.fold(F.col("label"))))
    return rows.select(F.explode(grams(F.col("folded"))).alias("gram"), "value", "label", "folded")


def identifier_search(queries: DataFrame, index: DataFrame, most: int = MOST_FOUND) -> DataFrame:
    """``query_id, position, value, label`` of the best ``most`` identifiers for queries ``query_id, q``.

    An identifier must share at least half of a query's pieces; those that begin with the query go first, then those that
    share more, then shorter labels, then smaller values.  Queries and identifiers meet by pieces, so no query scans all
    names; only as many of a query's rarest pieces are looked up as one that shares half of them cannot do without, and what
    meets is counted in full.  Queries of less than two signs find nothing."""
    asked = queries.select("query_id", F.trim(text.fold(F.col("q"))).alias("folded_q")).where(F.length("folded_q") >= LEAST_QUERY).withColumn("pieces", grams(F.col("folded_q")))
    texts = asked.select("folded_q", "pieces").distinct().withColumn("n", F.size("pieces"))  # equal queries are answered once
    common = index.groupBy("gram").agg(F.count(F.lit(1)).alias("names"))
    pieces = texts.select("folded_q", "n", F.explode("pieces").alias("gram")).join(common, "gram", "left")
    # of n pieces half are shared, so one at least of any n // 2 + 1: the rarest are looked up
    rarest = pieces.withColumn("__r", F.row_number().over(Window.partitionBy("folded_q").orderBy(F.coalesce("names", F.lit(0)), "gram"))).where("__r <= n div 2 + 1 and names is not null")
    met = rarest.select("folded_q", "gram").join(index, "gram").select("folded_q", "value", "label", "folded").distinct()
    both = met.join(texts, "folded_q").withColumn("shared", F.size(F.array_intersect("pieces", grams(F.col("folded"))))).withColumn("begins", F.startswith("folded", "folded_q"))
    order = Window.partitionBy("folded_q").orderBy(F.desc("begins"), F.desc("shared"), F.length("label"), "value")
    ranked = both.where(F.col("shared") * 2 >= F.col("n")).withColumn("position", F.row_number().over(order)).where(F.col("position") <= most)
    return asked.select("query_id", "folded_q").join(ranked, "folded_q").select("query_id", "position", "value", "label")

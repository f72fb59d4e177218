"""Personal data by bootstrapped contextual extraction, in DataFrame functions only.

*Seeds.*  Four patterns find e-mail addresses, IP addresses, card numbers and phone numbers in whole texts.  Positions
come from splitting a text at the pattern: the pieces between matches and the matches alternate, so running sums of
their lengths (a window over the matches of one document) are the offsets, in code points.

*Patterns.*  Words (runs of letters) before and after a seed are its lexical patterns: the two words before, the two
after, and one of each, however long they or what lies between are.  *Candidates* are other tokens that look like
identifiers (a digit or @, six characters or more, outside every seed), groups of digits with spaces, brackets or other
separators between them, and addresses whose signs are spelled out ("name (at) host dot org").
Patterns and values form a bipartite graph.  Round by round a pattern's score for a kind is the weight of its values known
to be of the kind, against ``PRIOR`` more, all known ones of other kinds, those candidates that can't be of the kind, and ``DOUBT`` of those
that might be and aren't known yet.  A value's score is the noisy-or of its patterns' scores; only patterns with ``SUPPORT``
different seeds or sure values and a score of ``SURE`` or more pass anything on, and only to candidates that may be of
the kind by ``FITS`` and ``DIGITS``.  Values of score ``SURE`` or more are new identifiers wherever they stand in such a
context; from the next round on they count for patterns as seeds do.  Rounds go on until none adds a value.

All scoring is grouping with map-side aggregation and joins of score tables; a hot pattern ("the") is one more key for
the aggregation, and its low score keeps it out of the join.

The learned spans never overlap a seed; they are added to the seeds, which all stay.

Defined results: a null text is empty and has no span; null ids and repeated rows are judged each by themselves; an
empty table gives an empty table; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sedgeline.llm import scratch

KINDS = ("email", "ip", "card", "phone")
SUPPORT = 5
SURE = 0.9
PRIOR = 0.25
DOUBT = 0.02

_LOCAL = "A-Za-z0-9._%+-"
#: A sign that no text keeps; it stands for one space or hyphen between digits, see ``_prepared``.
_JOINT = "\ue000"
#: Java patterns with the matches of the plain ones.  A match may start at the end of the one before or where no run
#: of its characters is cut; runs are possessive, and so are groups that repeat, which Java else enters once more for each
#: turn, as deep as the text is long.  So scanning is linear in the text and flat, whatever it holds.
PATTERNS = {
    "email": rf"(?:\G|(?<![{_LOCAL}]))[{_LOCAL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": f"[0-9][0-9{_JOINT}]+",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
#: Cheap tests that a text may hold a match at all.
MAY_HOLD = {"email": "@[A-Za-z0-9-]+\\.[A-Za-z0-9-]", "ip": r"[0-9]\.[0-9]+\.[0-9]+\.[0-9]", "card": "[0-9](?:[ -]?[0-9]){11}", "phone": r"\+[0-9]"}
_TOKEN = r"\-A-Za-z0-9._%+@/=:"
_GROUPS = rf"(?<![{_TOKEN}(])\(?[0-9]++(?:[ ()/.-]{{1,3}}[0-9]++){{1,18}}(?![{_TOKEN}])"
#: A host name has at most 127 labels.
_LABELS = 125
_DOT = r"(?> ?[\[({<]? ?(?:dot|DOT) ?[\])}>]? ?|\.)"
_SPELLED = rf"(?<![{_LOCAL}])[{_LOCAL}]++(?: ?[\[({{<] ?(?:at|AT|@) ?[\])}}>] ?| at | AT )[A-Za-z0-9-]++(?:{_DOT}[A-Za-z0-9-]++){{0,{_LABELS}}}{_DOT}[A-Za-z]{{2,}}+(?![{_TOKEN}])"
CANDIDATE = rf"{_SPELLED}|{_GROUPS}|(?<![{_TOKEN}])(?=[{_TOKEN}&&[^0-9@]]*+[0-9@])[{_TOKEN}]{{6,}}+"
#: What a learned value of a kind may look like, and how many digits it may have.
FITS = {"email": "^[^@]+@[^@]+$|^[^ ]+ ?.?(?:at|@).? ?[^ ]+", "ip": "^[0-9a-f]*(?:[.:][0-9a-f]*){3,7}$", "card": "^[0-9][0-9 -]*$", "phone": "^[+(]?[0-9][0-9 ()./-]*$"}
DIGITS = {"card": (12, 19), "phone": (9, 15)}


def _prepared(kind: str, text: Column) -> Column:
    """Text of the same length in which a card number is one run."""
    if kind != "card":
        return text
    return F.regexp_replace(F.translate(text, _JOINT, "x"), "(?<=[0-9])[ -](?=[0-9])", _JOINT)


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    """Whether at most 19 digits pass the Luhn test."""
    n = F.length(digits)
    each = F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: F.struct((F.pmod(n - i, F.lit(2)) == 1).alias("twice"), F.substring(digits, i, F.lit(1)).cast("int").alias("d")))
    return F.aggregate(each, F.lit(0), lambda s, x: s + F.when(~x["twice"], x["d"]).otherwise(F.when(x["d"] > 4, x["d"] * 2 - 9).otherwise(x["d"] * 2))) % 10 == 0


def _valid(kind: str, value: Column) -> Column:
    if kind == "ip":
        small = F.transform(F.split(value, r"\."), lambda p: F.regexp_replace(p, "^0+(?=[0-9])", ""))
        return F.forall(small, lambda p: (F.length(p) < 3) | ((F.length(p) == 3) & (p <= "255")))
    if kind == "card":
        d = _digits(value)
        return F.when(F.length(d).between(12, 19), _luhn(d)).otherwise(F.lit(False))
    if kind == "phone":
        return F.length(_digits(value)).between(9, 15)
    return F.lit(True)


def _two_words(text: Column) -> Column:
    """The first two runs of letters, empty where there is none."""
    return F.array(*[F.regexp_extract(text, r"^[^\p{L}]*+(\p{L}*+)[^\p{L}]*+(\p{L}*+)", k) for k in (1, 2)])


def matches(texts: DataFrame) -> DataFrame:
    """From ``rid, text``: one row per seed, and per token (kind null) that looks like an identifier:
    ``rid, kind, start, end, value, before, after`` (the two words next to it on either side, nearest first, up to the next match of the same pattern).

    One scan: a text's gaps and matches for all patterns that it may hold.  Offsets are running sums over the document's
    own matches of a pattern."""
    held = []
    for kind in (*KINDS, None):
        may, pattern, text = (MAY_HOLD[kind], PATTERNS[kind], _prepared(kind, F.col("text"))) if kind else (CANDIDATE, CANDIDATE, F.col("text"))
        gaps = F.transform(F.split(text, pattern, -1), lambda g: F.struct(F.length(g).cast("long").alias("size"), F.transform(_two_words(F.reverse(g)), F.reverse).alias("tail"), _two_words(g).alias("head")))
        held.append(F.when(F.col("text").rlike(may), F.struct(F.lit(kind).cast("string").alias("kind"), gaps.alias("gaps"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("found"))))
    rows = texts.select("rid", F.explode(F.filter(F.array(*held), lambda x: x.isNotNull())).alias("x")).where("size(x.found) > 0")
    parts = F.arrays_zip(F.col("x.found").alias("value"), F.col("x.gaps").alias("gap"), F.slice("x.gaps", 2, F.size("x.gaps")).alias("next"))
    # the arrays are a column of their own below the explosion, or each of its rows would carry all of them
    rows = rows.select("rid", F.col("x.kind").alias("kind"), parts.alias("parts")).select("rid", "kind", F.posexplode("parts").alias("i", "m")).where("m.value is not null")
    end = F.sum(F.col("m.gap.size") + F.length("m.value")).over(Window.partitionBy("rid", "kind").orderBy("i").rowsBetween(Window.unboundedPreceding, 0))
    rows = rows.select("rid", "kind", F.col("m.value").alias("value"), F.col("m.gap.tail").alias("before"), F.col("m.next.head").alias("after"), end.alias("end"))
    valid = F.coalesce(*[F.when(F.col("kind") == k, _valid(k, F.col("value"))) for k in KINDS], F.lit(True))
    return rows.where(valid).select("rid", "kind", (F.col("end") - F.length("value")).alias("start"), "end", "value", "before", "after")


def without_overlaps(found: DataFrame) -> DataFrame:
    """The tokens among ``found`` that overlap no seed."""
    rise = Window.partitionBy("rid").orderBy("start", F.col("kind").isNull()).rowsBetween(Window.unboundedPreceding, 0)
    fall = Window.partitionBy("rid").orderBy(F.desc("start"), F.col("kind").isNull()).rowsBetween(Window.unboundedPreceding, 0)
    both = found.withColumn("before_end", F.max(F.when(F.col("kind").isNotNull(), F.col("end"))).over(rise)).withColumn("after_start", F.min(F.when(F.col("kind").isNotNull(), F.col("start"))).over(fall))
    free = (F.coalesce("before_end", F.lit(-1)) <= F.col("start")) & (F.coalesce("after_start", F.col("end")) >= F.col("end"))
    return both.where(F.col("kind").isNull() & free).drop("before_end", "after_start")


def _patterns(places: DataFrame) -> DataFrame:
    """``pattern, value, kind``: the lexical patterns of places, each combination once."""
    at = lambda side, i: F.lower(F.get(F.col(side), F.lit(i)))
    rows = places.select("kind", F.lower("value").alias("value"), F.col("before").alias("l"), F.col("after").alias("r"))
    forms = F.array(
        F.concat(at("l", 1), F.lit(" "), at("l", 0), F.lit(" _")),
        F.concat(F.lit("_ "), at("r", 0), F.lit(" "), at("r", 1)),
        F.concat(at("l", 0), F.lit(" _ "), at("r", 0)),
    )
    return rows.select("kind", "value", F.explode(forms).alias("pattern")).distinct()


def _fits(kind: Column, value: Column) -> Column:
    """Whether a lower-cased value may be of a kind."""
    tests = [F.when(kind == k, value.rlike(FITS[k]) & (F.length(_digits(value)).between(*DIGITS[k]) if k in DIGITS else F.lit(True))) for k in KINDS]
    return F.coalesce(*tests, F.lit(False))


def learned_values(base: DataFrame, candidates: DataFrame) -> DataFrame:
    """``value, kind, score`` of the candidates that the patterns of seeds lead to."""
    graph = scratch.table(_patterns(base).unionByName(_patterns(candidates)), "pii-graph")
    unknown = graph.where("kind is null").select("pattern", "value")
    seeds = graph.where("kind is not null").select("pattern", "value", "kind", F.lit(1.0).alias("score"))
    fits = [F.count_if(_fits(F.lit(k), F.col("value"))).alias(f"fits_{k}") for k in KINDS]
    others = unknown.groupBy("pattern").agg(F.count(F.lit(1)).alias("values"), *fits)
    known, count, learned = seeds, -1, None
    while True:
        weights = known.groupBy("pattern", "kind").agg(F.sum("score").alias("weight"), F.count(F.lit(1)).alias("support"))
        totals = known.groupBy("pattern").agg(F.sum("score").alias("total"))
        may = F.coalesce(*[F.when(F.col("kind") == k, F.col(f"fits_{k}")) for k in KINDS], F.lit(0))
        against = F.col("total") + PRIOR + DOUBT * may + F.coalesce(F.col("values") - may, F.lit(0))
        scores = weights.where(F.col("support") >= SUPPORT).join(totals, "pattern").join(others, "pattern", "left")
        scores = scores.select("pattern", "kind", (F.col("weight") / against).alias("p")).where(F.col("p") >= SURE)
        reached = unknown.join(scores, "pattern").where(_fits(F.col("kind"), F.col("value")))
        learned = reached.groupBy("value", "kind").agg((1 - F.exp(F.sum(F.log(1 - F.least("p", F.lit(0.999)))))).alias("score")).where(F.col("score") >= SURE)
        learned = scratch.table(learned, "pii-learned")
        before, count = count, learned.count()
        if count == 0 or count <= before:
            return learned
        passed = unknown.join(learned, "value").select("pattern", "value", "kind", "score")
        known = seeds.unionByName(passed)


def personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: ``doc_id, found``: spans ``start, kind_no, end, kind, learned`` in order."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    if rows.groupBy("doc_id").count().where("count > 1 or doc_id is null").limit(1).count():
        rows = scratch.table(rows.withColumn("rid", F.monotonically_increasing_id()), "pii-rows")
    else:
        rows = rows.withColumn("rid", F.col("doc_id").cast("long"))
    found = scratch.table(matches(rows), "pii-matches")
    base, candidates = found.where("kind is not null"), scratch.table(without_overlaps(found), "pii-candidates")
    best = learned_values(base, candidates).groupBy("value").agg(F.max_by("kind", F.struct("score", "kind")).alias("kind"))
    more = candidates.drop("kind").withColumn("value", F.lower("value")).join(best, "value")
    number = F.array_position(F.lit(list(KINDS)), F.col("kind")).cast("int")
    spans = base.withColumn("learned", F.lit(False)).unionByName(more.withColumn("learned", F.lit(True)))
    of = spans.groupBy("rid").agg(F.array_sort(F.collect_list(F.struct("start", number.alias("kind_no"), "end", "kind", "learned"))).alias("found"))  # one document's
    return rows.select("rid", "doc_id").join(of, "rid", "left").select("doc_id", F.coalesce("found", F.array().cast(of.schema["found"].dataType)).alias("found"))


def span_report(docs: DataFrame, **columns) -> DataFrame:
    """One row per input row: ``doc_id, n_email, n_ip, n_card, n_phone`` (seeds), ``base_sha256, spans, n_learned``."""
    found = personal_data(docs, **columns)
    line = lambda a: F.array_join(F.transform(a, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    base = F.filter("found", lambda s: ~s["learned"])
    kinds = F.transform(base, lambda s: s["kind"])
    counts = [(F.size(kinds) - F.size(F.array_remove(kinds, k))).cast("long").alias(f"n_{k}") for k in KINDS]
    return found.select("doc_id", *counts, F.sha2(line(base), 256).alias("base_sha256"), line(F.col("found")).alias("spans"), F.size(F.filter("found", lambda s: s["learned"])).cast("long").alias("n_learned"))

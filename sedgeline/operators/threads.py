"""Comments below articles, in four dialects, as quotes of one form.

A dialect is a row of selectors.  Along the page each comment finds the next author, time and text element within itself,
and each text node the element of such a kind that it lies in, by running values; what they say is grouped by element and
joined to the comments by its place.  The comments and the elements found in them are stored, as several steps read them.  Texts are written as HTML again by sorting the starts and ends of their elements.

Defined results: the first ``most`` comment elements count, those without a text are left out after that; an author that is
absent or blank is ``Unknown``; a comment's text is cleaned as show notes are.  Pages without a thread have no row.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sedgeline import scratch
from sedgeline.functions import markup, text
from sedgeline.operators import markdown, pages

UNKNOWN, SOURCE, TITLE = "Unknown", "Source", "Comments"


@dataclass(frozen=True)
class Dialect:
    """``items`` and the other selectors are alternatives: of items the first kind that a page has, of authors and texts the
    first that a comment has.  ``whole``: the text element itself belongs to the text.  ``link``: where a comment's address
    comes from: its own id, the id of an element in it, or the target of a link in it."""

    items: tuple[str, ...]
    author: tuple[str, ...]
    body: tuple[str, ...]
    thread: tuple[str, ...] = ()
    time: tuple[str, ...] = ()
    time_attr: str = ""
    whole: bool = True
    link: tuple[str, str] = ("own", "")
    title_only: bool = False
    longest_author: int = 1_000_000
    base: str = ""


#: Selectors by dialect.
DIALECTS = {
    "heise_list": Dialect(items=("li.posting_element",), author=(".tree_thread_list--written_by_user", ".pseudonym"), body=("a.posting_subject",), link=("href", "a.posting_subject"), title_only=True, base="https://www.heise.de/"),
    "heise": Dialect(items=("[id^='posting_']", ".posting", ".a-comment"), author=("a[href*='/forum/heise-online/Meinungen']", ".pseudonym", ".username", "strong"), body=(".text", ".posting-content", ".comment-body", "p"), longest_author=49),
    "mactechnews": Dialect(thread=("div.MtnCommentScroll",), items=("div.MtnComment",), author=("span.MtnCommentAccountName",), time=("span.MtnCommentTime",), body=("div.MtnCommentText",)),
    "mein_mmo": Dialect(thread=("div.wpd-thread-list",), items=("div.wpd-comment",), author=("div.wpd-comment-author",), time=("div.wpd-comment-date",), time_attr="title", body=("div.wpd-comment-text",), whole=False, link=("id", "div.wpd-comment-right")),
}


def _along() -> object:
    return Window.partitionBy("page_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)


def inner_html(tree: DataFrame, heads: DataFrame, whole: bool = True) -> DataFrame:
    """``page_id, head, html`` of elements ``page_id, pos, last`` that don't hold each other: what lies in them, as HTML."""
    rows = pages.below(tree, heads)
    marks = heads.select("page_id", "pos", F.struct("pos", "last").alias("__head"))
    head = F.last("__head", ignorenulls=True).over(_along())
    rows = rows.join(pages.shuffled(marks), ["page_id", "pos"], "left").withColumn("head", head).where("head is not null")
    rows = rows if whole else rows.where(F.col("pos") != F.col("head.pos"))
    element = ~F.startswith("tag", F.lit("#"))
    named = F.array_join(F.transform(F.map_entries("attrs"), lambda e: F.concat(F.lit(" "), e["key"], F.lit('="'), text.escape_attr(e["value"]), F.lit('"'))), "")
    start = F.when(element, F.concat(F.lit("<"), "tag", named, F.lit(">"))).when(F.col("tag") == "#text", F.replace(F.replace(F.replace(F.col("text"), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))).otherwise("")
    begun = rows.select("page_id", F.col("head.pos").alias("head"), F.struct(F.col("pos").alias("at"), F.lit(0).alias("end"), F.lit(0).alias("inner"), start.alias("x")).alias("e"))
    ended = rows.where(element & ~F.col("tag").isin(*sorted(markup.VOID))).select("page_id", F.col("head.pos").alias("head"), F.struct(F.col("last").alias("at"), F.lit(1).alias("end"), (-F.col("pos")).alias("inner"), F.concat(F.lit("</"), "tag", F.lit(">")).alias("x")).alias("e"))
    every = begun.unionByName(ended).groupBy("page_id", "head").agg(F.array_sort(F.collect_list("e")).alias("e"))  # of one element
    return every.select("page_id", "head", F.array_join(F.transform("e", lambda e: e["x"]), "").alias("html"))


def _first_of(tree: DataFrame, items: DataFrame, wanted: dict[str, tuple[str, ...]]) -> DataFrame:
    """``page_id, item`` and, for each name of ``wanted``, the first element in the item (its ``pos, last``, attributes) of
    the first of the name's selectors that finds any, or null.  One pass over the pages for all of them."""
    marks = {(name, s): f"__m{i}" for i, (name, s) in enumerate((name, s) for name, selectors in wanted.items() for s in selectors)}
    rows = tree
    for (_, s), m in marks.items():
        rows = pages.marked(rows, (s,), m)
    any_ = reduce(Column.__or__, [F.col(m) for m in marks.values()])
    rows = rows.where(any_).select("page_id", "pos", "last", "attrs", *marks.values(), F.lit(False).alias("__item"))
    heads = items.select("page_id", "pos", "last", F.lit(True).alias("__item"))
    both = rows.unionByName(heads, allowMissingColumns=True)
    back = Window.partitionBy("page_id").orderBy(F.desc("pos"), "__item").rowsBetween(Window.unboundedPreceding, 0)  # an item comes after its own element
    both = both.withColumns({f"__f{m}": F.last(F.when(F.col(m), F.struct("pos", "last", "attrs")), ignorenulls=True).over(back) for m in marks.values()}).where("__item")
    hit = lambda name: F.coalesce(*[F.when(F.col(f"__f{m}.pos") <= F.col("last"), F.col(f"__f{m}")) for (n, _), m in marks.items() if n == name])
    return both.select("page_id", F.col("pos").alias("item"), *[hit(name).alias(name) for name in wanted])


def _texts(tree: DataFrame, found: DataFrame, name: str) -> DataFrame:
    """``page_id, item, name``: trimmed text of the found elements, the parts of a time joined by blanks."""
    heads = found.select("page_id", F.col(f"{name}.pos").alias("pos"), F.col(f"{name}.last").alias("last")).distinct()
    rows = pages.below(tree, heads).join(pages.shuffled(heads.select("page_id", "pos", F.lit(True).alias("__is"))), ["page_id", "pos"], "left")
    rows = rows.withColumn("head", F.last(F.when(F.col("__is"), F.struct("pos", "last")), ignorenulls=True).over(_along())).where("tag = '#text' AND head.last >= pos")
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("pos", "text"))), lambda x: x["text"])
    said = F.array_join(F.filter(F.transform(ordered, text.strip), lambda x: x != ""), " ") if name == "time" else text.strip(F.array_join(ordered, ""))
    told = rows.groupBy("page_id", F.col("head.pos").alias("at")).agg(said.alias("said"))  # of one element
    return found.select("page_id", "item", F.col(f"{name}.pos").alias("at"), F.col(f"{name}.attrs").alias("attrs")).join(pages.shuffled(told), ["page_id", "at"], "left").select("page_id", "item", F.col("said").alias(name), F.col("attrs").alias(f"{name}_attrs"))


def comments(tree: DataFrame, dialect: Dialect, addresses: DataFrame, most: int) -> DataFrame:
    """``page_id, position, author, time, url, body`` (HTML) of a page's first ``most`` comments; ``addresses`` has ``page_id, base``."""
    scope = pages.inside_selected(tree, dialect.thread, first_only=True) if dialect.thread else tree
    rank = F.lit(None).cast("int")
    for i, s in enumerate(dialect.items):
        scope = pages.marked(scope, (s,), f"__k{i}")
        rank = F.coalesce(rank, F.when(F.col(f"__k{i}"), i))
    items = scope.withColumn("rank", rank).where("rank is not null").withColumn("best", F.min("rank").over(Window.partitionBy("page_id"))).where("rank = best")
    items = items.withColumn("position", F.row_number().over(Window.partitionBy("page_id").orderBy("pos"))).where(F.col("position") <= most).select("page_id", "pos", "last", "position", "attrs")
    items = scratch.table(items, "comment-items")
    wanted = {f"author{i}": (s,) for i, s in enumerate(dialect.author)} | {"time": dialect.time, "body": dialect.body} | {"link": (dialect.link[1],) if dialect.link[0] != "own" else ()}
    first = scratch.table(_first_of(tree, items, {k: s for k, s in wanted.items() if s}), "comment-parts")
    of = lambda part, name: first.where(F.col(part).isNotNull()).select("page_id", "item", F.col(part).alias(name))
    told = lambda part, name: _texts(tree, of(part, name), name)
    rows = items.join(pages.shuffled(addresses), "page_id").withColumnRenamed("pos", "item").withColumnRenamed("attrs", "own")
    # of several kinds of authors the first that says something short enough
    names = [told(f"author{i}", "author").select("page_id", "item", F.when((F.col("author") != "") & (F.length("author") <= dialect.longest_author), F.col("author")).alias(f"author{i}")) for i in range(len(dialect.author))]
    for n in names:
        rows = rows.join(pages.shuffled(n), ["page_id", "item"], "left")
    rows = rows.withColumn("author", F.coalesce(*[F.col(f"author{i}") for i in range(len(names))], F.lit(UNKNOWN))).drop(*[f"author{i}" for i in range(len(names))])
    if dialect.time:
        times = told("time", "time")
        given = F.nullif(text.strip(F.col("time_attrs")[dialect.time_attr]), F.lit("")) if dialect.time_attr else F.lit(None)
        rows = rows.join(pages.shuffled(times.select("page_id", "item", F.coalesce(given, F.col("time")).alias("time"))), ["page_id", "item"], "left")
    else:
        rows = rows.withColumn("time", F.lit(None).cast("string"))
    bodies = of("body", "body")
    if dialect.title_only:
        body = _texts(tree, bodies, "body").select("page_id", "item", F.concat(F.lit("<p>"), text.escape_html(F.coalesce("body", F.lit(""))), F.lit("</p>")).alias("body"))
    else:
        at = bodies.select("page_id", "item", F.col("body.pos").alias("head"), F.col("body.last").alias("last"))
        html = inner_html(pages.clean_notes(tree), at.select("page_id", F.col("head").alias("pos"), "last").distinct(), dialect.whole)
        body = at.join(pages.shuffled(html), ["page_id", "head"]).where(text.strip(F.col("html")) != "").select("page_id", "item", F.col("html").alias("body"))
    rows = rows.join(pages.shuffled(body), ["page_id", "item"])
    kind = dialect.link[0]
    if kind == "own":
        named = F.coalesce(F.nullif(F.col("own")["id"], F.lit("")), F.when(F.lit(not dialect.thread), F.concat(F.lit("comment-"), (F.col("position") - 1).cast("string"))).otherwise(F.lit("comments")))
        rows = rows.withColumn("url", F.concat("base", F.lit("#"), named))
    else:
        linked = of("link", "link").select("page_id", "item", F.col("link.attrs").alias("link"))
        rows = rows.join(pages.shuffled(linked), ["page_id", "item"], "left")
        url = pages.resolve(F.coalesce(F.col("link")["href"], F.lit("")), F.lit(dialect.base)) if kind == "href" else F.concat("base", F.lit("#"), F.coalesce(F.nullif(F.col("link")["id"], F.lit("")), F.lit("comments")))
        rows = rows.withColumn("url", url)
    return rows.select("page_id", "position", "author", "time", "url", "body")


def post_comments(rows: DataFrame, most: int) -> DataFrame:
    """Comments of posts (``page_id, id, author, body`` in markdown, ``score, permalink``) of people, best first, as :func:`comments` gives them."""
    low = F.lower("author")
    person = (F.col("author") != "") & ~(low.endswith("_bot") | low.endswith("-bot") | (low == "automoderator"))
    kept = rows.where((F.col("body") != "") & ~F.col("body").isin("[deleted]", "[removed]") & person)
    at = F.row_number().over(Window.partitionBy("page_id").orderBy(F.coalesce("score", F.lit(0)).desc(), "id"))
    kept = kept.withColumn("position", at).where(F.col("position") <= most)
    html = markdown.to_html(kept.select(F.struct("page_id", "id").alias("key"), "body"), "key", "body").select("key.page_id", "key.id", "html")
    return kept.drop("body").join(pages.shuffled(html), ["page_id", "id"]).select("page_id", "position", "author", F.lit(None).cast("string").alias("time"), F.concat(F.lit("https://reddit.com"), "permalink").alias("url"), F.col("html").alias("body"))


def quoted(found: DataFrame, heading: Column | None = None) -> DataFrame:
    """``page_id, html``: a page's comments as quotes in a section; ``heading`` is the address of its title, by page."""
    link = lambda url, label: F.when(text.is_safe_url(url), F.concat(F.lit('<a href="'), text.escape_html(url), F.lit(f'">{label}</a>'))).otherwise(F.lit(label))
    when = F.when(F.coalesce("time", F.lit("")) != "", F.concat(F.lit(" ("), text.escape_html(F.col("time")), F.lit(")"))).otherwise("")
    quote = F.concat(F.lit("<blockquote><p><strong>"), text.escape_html(F.col("author")), F.lit("</strong>"), when, F.lit(" | "), link(F.col("url"), SOURCE), F.lit("</p><div>"), F.col("body"), F.lit("</div></blockquote>"))
    first = heading if heading is not None else F.lit(None).cast("string")
    lines = found.select("page_id", "position", quote.alias("q"), first.alias("h"))
    made = lines.groupBy("page_id").agg(F.first("h", ignorenulls=True).alias("h"), F.array_sort(F.collect_list(F.struct("position", "q"))).alias("q"))  # one page's
    title = F.when(F.col("h").isNotNull(), F.concat(F.lit("<h3>"), link(F.col("h"), TITLE), F.lit("</h3>"))).otherwise("")
    return made.select("page_id", F.concat(F.lit("<section>"), title, F.array_join(F.transform("q", lambda x: x["q"]), ""), F.lit("</section>")).alias("html"))

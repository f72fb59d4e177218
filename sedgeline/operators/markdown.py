"""Markdown of forum posts to HTML, as DataFrame work: lines, islands of equal kind, and inline rules.

A post's lines are exploded and classified; neighbouring lines of one kind form a block (an island found by a running
count of changes); a block's lines are joined again by their kind's rule.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from sedgeline.functions import text

#: Signs that a backslash protects, and stand-ins outside of any text.
_PROTECTED = "\\*_~^`[]()>#!|"
_STAND_INS = "".join(chr(0xE100 + i) for i in range(len(_PROTECTED)))
_LINK = r"\[([^\]]*)\]\((https?://[^)\s]+|mailto:[^)\s]+|/[^)\s]*)\)"


def _protect(c: Column) -> Column:
    for sign, stand_in in zip(_PROTECTED, _STAND_INS, strict=True):
        c = F.replace(c, F.lit("\\" + sign), F.lit(stand_in))
    return c


def inline(c: Column) -> Column:
    """Escaped text with styles, spoilers, superscripts and links."""
    c = text.escape_html(_protect(c))
    rules = [
        (r"`([^`]+)`", "<code>$1</code>"), (r"&gt;!(.+?)!&lt;", '<span class="spoiler">$1</span>'), (_LINK, '<a href="$2">$1</a>'), (r"(^|[\s(])(https?://[^\s<>()]+[^\s<>().,;:!?])", '$1<a href="$2">$2</a>'),
        (r"\*\*(.+?)\*\*", "<strong>$1</strong>"), (r"(?<![A-Za-z0-9])__(.+?)__(?![A-Za-z0-9])", "<strong>$1</strong>"), (r"\*([^*\s][^*]*?)\*", "<em>$1</em>"),
        (r"(?<![A-Za-z0-9/])_([^_\s][^_]*?)_(?![A-Za-z0-9])", "<em>$1</em>"), (r"~~(.+?)~~", "<del>$1</del>"), (r"\^\(([^)]+)\)", "<sup>$1</sup>"), (r"\^([^\s^<]+)", "<sup>$1</sup>"),
    ]
    for pattern, replacement in rules:
        c = F.regexp_replace(c, pattern, replacement)
    return F.translate(c, _STAND_INS, _PROTECTED)


#: From this indentation on an item of the other kind belongs to the list before it.
NESTED = 2


@F.pandas_udf(ArrayType(StringType()))
def list_tags(indents: pd.Series, kinds: pd.Series) -> pd.Series:
    """For each item of a list what stands before its text and, after a NUL, behind it."""
    out = []
    for widths, names in zip(indents, kinds, strict=True):
        before, after, open_ = [], [], []
        for width, name in zip(widths, names, strict=True):
            ended = ""
            while len(open_) > 1 and width <= open_[-2][0]:
                ended += f"</li></{open_.pop()[1]}>"
            if after:
                after[-1] = ended
            if open_ and width <= open_[-1][0]:
                open_[-1] = (width, open_[-1][1])
                before.append("</li><li>")
            else:
                open_.append((width, name))
                before.append(f"<{name}><li>")
            after.append("")
        if after:
            after[-1] = "".join(f"</li></{n}>" for _, n in reversed(open_))
        out.append([f"{b}\0{a}" for b, a in zip(before, after, strict=True)])
    return pd.Series(out)


def lines(posts: DataFrame, key: str, body: str) -> DataFrame:
    """Lines with their kind and block: ``key, n, line, kind, depth, block``."""
    rows = posts.select(key, F.posexplode(F.split(F.regexp_replace(F.coalesce(F.col(body), F.lit("")), "\r\n?", "\n"), "\n")).alias("n", "line"))
    order = Window.partitionBy(key).orderBy("n")
    upto = order.rowsBetween(Window.unboundedPreceding, 0)
    listed = ("ul", "ol")
    fence = F.col("line").rlike(r"^\s*```")
    fences = F.sum(fence.cast("int")).over(upto)
    inside = (F.col("fences") % 2 == 1) | F.col("fence")
    quotes = F.regexp_extract("line", r"^((?:\s*+>(?!!))++)", 1)
    kind = (
        F.when(inside, "code").when(F.trim("line") == "", "blank").when(F.col("line").rlike(r"^#{1,6}\s*[^#\s]"), "heading").when(quotes != "", "quote").when(F.col("line").rlike(r"^\s*[-*+]\s+\S"), "ul")
        .when(F.col("line").rlike(r"^\s*[0-9]+[.)]\s+\S"), "ol").when(F.col("line").rlike(r"^\s*+(?:(?:-\s*+){3,}+|(?:\*\s*+){3,}+|(?:_\s*+){3,}+)$"), "hr").when(F.col("line").rlike(r"^[^|]*\|.*$") & F.col("line").rlike(r"\|"), "table").otherwise("p")
    )
    rows = rows.withColumn("fence", fence).withColumn("fences", fences).withColumn("kind", kind)
    indent = F.length(F.replace(F.regexp_extract("line", r"^(\s*)", 1), F.lit("\t"), F.lit("    ")))
    rows = rows.withColumn("depth", F.when(F.col("kind").isin(*listed), indent).otherwise(F.length(F.regexp_replace(quotes, r"[^>]", ""))))
    # an item goes on with the list before it if it is indented or of the kind of that list's own items
    both = F.col("kind").isin(*listed) & F.coalesce(F.lag("kind").over(order).isin(*listed), F.lit(False))
    of_list = F.last(F.when(F.col("kind").isin(*listed) & (F.col("depth") < NESTED), F.col("kind")), ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, -1))
    changes = F.when(both, (F.col("depth") < NESTED) & (F.coalesce(of_list, F.col("kind")) != F.col("kind"))).otherwise(F.lag("kind").over(order) != F.col("kind"))
    starts = F.coalesce(changes | F.col("kind").isin("heading", "hr"), F.lit(True)) | (F.col("fence") & (F.col("fences") % 2 == 1))
    return rows.withColumn("starts", starts).withColumn("block", F.sum(F.col("starts").cast("int")).over(upto)).select(key, "n", "line", "kind", "depth", "block", "fence")


def _cells(row: Column, tag: str) -> Column:
    parts = F.split(F.regexp_replace(F.trim(row), r"^\||\|$", ""), r"\|")
    return F.concat(F.lit("<tr>"), F.array_join(F.transform(parts, lambda p: F.concat(F.lit(f"<{tag}>"), inline(F.trim(p)), F.lit(f"</{tag}>"))), ""), F.lit("</tr>"))


def to_html(posts: DataFrame, key: str, body: str) -> DataFrame:
    """``key, html`` of each post."""
    rows = lines(posts, key, body).where("kind <> 'blank'")
    parts = F.array_sort(F.collect_list(F.struct("n", "line", "depth", "fence", "kind")))
    blocks = rows.groupBy(key, "block").agg(parts.alias("x")).withColumns({"one": F.get("x", F.lit(0))["line"], "kind": F.get("x", F.lit(0))["kind"]})
    lists = F.col("kind").isin("ul", "ol")
    blocks = blocks.withColumn("tags", F.when(lists, list_tags(F.when(lists, F.transform("x", lambda x: x["depth"])).otherwise(F.array().cast("array<int>")), F.when(lists, F.transform("x", lambda x: x["kind"])).otherwise(F.array().cast("array<string>")))))
    joined = lambda f, sep="": F.array_join(F.transform("x", f), sep)
    level = F.length(F.regexp_extract("one", "^(#+)", 1)).cast("string")
    own = lambda x: inline(F.regexp_replace(x["line"], r"^\s*([-*+]|[0-9]+[.)])\s+", ""))
    item = lambda x, i: F.concat(F.substring_index(F.get("tags", i), "\0", 1), own(x), F.substring_index(F.get("tags", i), "\0", -1))
    near = lambda i: F.coalesce(F.get("x", i)["depth"], F.lit(0))
    deeper = lambda x, i: F.greatest(x["depth"] - near(i), F.lit(0)).cast("int")
    quote = lambda x, i: F.concat(F.repeat(F.lit("<blockquote>"), deeper(x, i - 1)), F.lit("<p>"), inline(F.trim(F.regexp_replace(x["line"], r"^(?:\s*+>)++", ""))), F.lit("</p>"), F.repeat(F.lit("</blockquote>"), deeper(x, i + 1)))
    is_table = F.get("x", F.lit(1))["line"].rlike(r"^[\s|:-]*-[\s|:-]*$")
    table = F.concat(F.lit("<table>"), _cells(F.col("one"), "th"), F.array_join(F.transform(F.slice("x", 3, F.greatest(F.size("x") - 2, F.lit(0))), lambda x: _cells(x["line"], "td")), ""), F.lit("</table>"))
    paragraph = F.concat(F.lit("<p>"), joined(lambda x: inline(F.trim(x["line"])), " "), F.lit("</p>"))
    html = (
        F.when(F.col("kind") == "code", F.concat(F.lit("<pre><code>"), F.array_join(F.transform(F.filter("x", lambda x: ~x["fence"]), lambda x: text.escape_html(x["line"])), "\n"), F.lit("</code></pre>")))
        .when(F.col("kind") == "heading", F.concat(F.lit("<h"), level, F.lit(">"), inline(F.trim(F.regexp_replace("one", r"^#+|#+\s*$", ""))), F.lit("</h"), level, F.lit(">")))
        .when(F.col("kind") == "quote", joined(quote)).when(F.col("kind").isin("ul", "ol"), joined(item))
        .when(F.col("kind") == "hr", F.lit("<hr>")).when((F.col("kind") == "table") & F.coalesce(is_table, F.lit(False)), table).otherwise(paragraph)
    )
    made = blocks.select(key, "block", html.alias("html")).groupBy(key).agg(F.array_sort(F.collect_list(F.struct("block", "html"))).alias("b"))  # one post's
    done = made.select(key, F.array_join(F.transform("b", lambda b: b["html"]), "\n").alias("html"))
    return posts.select(key).join(done, key, "left").select(key, F.coalesce("html", F.lit("")).alias("html"))


def decode_entities(c: Column) -> Column:
    """Numeric references by code point, out-of-range ones left alone, then the named ones of XML and the no-break space."""
    pattern = r"&#(x[0-9A-Fa-f]{1,6}|[0-9]{1,7});"
    codes = F.regexp_extract_all(c, F.lit(pattern), F.lit(1))
    whole = F.regexp_extract_all(c, F.lit(pattern), F.lit(0))

    def sign(x: Column) -> Column:
        n = F.when(x["code"].startswith("x"), F.conv(F.substring(x["code"], 2, 9), 16, 10)).otherwise(x["code"]).cast("long")
        fits = n.between(1, 0x10FFFF) & ~n.between(0xD800, 0xDFFF)
        return F.when(fits, F.decode(F.unhex(F.lpad(F.hex(n), 8, "0")), "UTF-32")).otherwise(x["whole"])

    gaps = F.split(c, pattern, -1)
    pieces = F.arrays_zip(gaps.alias("gap"), codes.alias("code"), whole.alias("whole"))
    out = F.array_join(F.transform(pieces, lambda x: F.concat(x["gap"], F.when(x["code"].isNull(), "").otherwise(sign(x)))), "")
    return text.unescape_basic(F.replace(F.when(F.contains(c, F.lit("&#")), out).otherwise(c), F.lit("&nbsp;"), F.lit("\xa0")))

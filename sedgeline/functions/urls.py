"""Addresses: resolution of references against a base as RFC 3986 has it, with the percent-normalising of browsers.

A reference is cut into scheme, authority, path, query and fragment; the path is merged with the base's and its dot
segments are removed by one fold over the segments, the kept ones being a stack.  Web addresses get a lower-case scheme and
host, no default port, a path of at least ``/`` and percent codes for what may not stand in an address.

Defined results: a null reference gives null, an empty one or an unsafe scheme the empty text; a null or relative base
leaves a relative reference as it is.  Other schemes (mail) pass unchanged.  Patterns have no repeated groups, so their
cost is linear in the address; the fold is entered only for paths with dot segments.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from sedgeline.functions import text

#: What is written as percent codes in a path, and in a query or fragment.
IN_PATH, IN_REST = r"[^\x21-\x7e]|[\"<>`{}^]", r"[^\x21-\x7e]|[\"<>]"
PORTS = {"http": ":80", "https": ":443"}


def _let(value: Column, f: Callable[[Column], Column]) -> Column:
    """``f`` of a value that is computed once, however often ``f`` names it."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def scheme(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.-]*):", 1))


def parts(url: Column) -> Column:
    """``whole, scheme, authority`` (with its slashes), ``path, query, fragment`` (with their signs); what is absent is empty."""
    cut = lambda c, pattern: F.regexp_extract(c, pattern, 1)
    rest = F.regexp_replace(url, r"^[A-Za-z][A-Za-z0-9+.-]*:", "")
    own_path = lambda c: cut(F.when(c.startswith("//"), F.regexp_replace(c, "^//[^/?#]*", "")).otherwise(c), "^([^?#]*)")
    return _let(
        F.struct(url.alias("u"), rest.alias("rest")),
        lambda x: F.struct(
            x["u"].alias("whole"), scheme(x["u"]).alias("scheme"), cut(x["rest"], r"^(//[^/?#]*)").alias("authority"), own_path(x["rest"]).alias("path"), cut(x["u"], r"^[^?#]*(\?[^#]*)").alias("query"), cut(x["u"], "^[^#]*(#(?s:.*))$").alias("fragment"),
        ),
    )


def without_dots(p: Column) -> Column:
    """A path without ``.`` and ``..`` segments; what would climb above the root stays there."""
    segments = F.split(p, "/")
    dot, dots = (".", "%2e"), ("..", ".%2e", "%2e.", "%2e%2e")
    last = F.lower(F.element_at(segments, -1))
    kept = F.aggregate(
        segments, F.array().cast("array<string>"),
        lambda done, s: F.when(F.lower(s).isin(*dots), F.slice(done, 1, F.when(F.size(done) > 1, F.size(done) - 1).otherwise(F.size(done)))).when(F.lower(s).isin(*dot), done).otherwise(F.concat(done, F.array(s))),
    )
    joined = F.concat(F.array_join(kept, "/"), F.when(last.isin(*dot, *dots), "/").otherwise(""))
    clean = F.when(p.startswith("/") & ~joined.startswith("/"), F.concat(F.lit("/"), joined)).otherwise(joined)
    return F.when(F.rlike(p, F.lit(r"(?i)(?:^|/)(?:\.|%2e)(?:(?:\.|%2e))?(?:/|$)")), clean).otherwise(p)


def percent(c: Column, unsafe: str) -> Column:
    """Signs of a class as percent codes of their UTF-8 bytes."""
    coded = F.transform(F.split(c, ""), lambda x: F.when(F.rlike(x, F.lit(f"^(?:{unsafe})$")), F.regexp_replace(F.hex(F.encode(x, "UTF-8")), "(..)", "%$1")).otherwise(x))
    return F.when(F.rlike(c, F.lit(unsafe)), F.array_join(coded, "")).otherwise(c)


def _normal(x: Column) -> Column:
    """An address of ``parts`` in its normal form if it is a web address; others as they are."""
    login, host = F.regexp_extract(x["authority"], "^//([^@]*@)", 1), F.lower(F.regexp_replace(F.regexp_replace(x["authority"], "^//", ""), "^[^@]*@", ""))
    port = F.coalesce(*[F.when(x["scheme"] == name, F.regexp_replace(host, f"{p}$", "")) for name, p in PORTS.items()])
    clean = _let(F.when(x["path"] == "", "/").otherwise(x["path"]), lambda p: _let(without_dots(p), lambda q: percent(q, IN_PATH)))
    whole = F.concat(x["scheme"], F.lit("://"), login, F.regexp_replace(port, ":$", ""), clean, percent(x["query"], IN_REST), percent(x["fragment"], IN_REST))
    return F.when(x["scheme"].isin(*PORTS) & (x["authority"] != ""), whole).otherwise(x["whole"])


def normal(url: Column) -> Column:
    """A web address in its normal form; others as they are."""
    return _let(parts(url), _normal)


def _joined(u: Column, b: Column) -> Column:
    """A reference's address, both being ``parts``."""
    root = F.concat(b["scheme"], F.lit(":"), b["authority"])
    folder = F.regexp_replace(b["path"], "[^/]*$", "")
    merged = F.when((b["authority"] != "") & (folder == ""), F.concat(F.lit("/"), u["path"])).otherwise(F.concat(folder, u["path"]))
    return (
        F.when((u["scheme"] != "") | (F.coalesce(b["scheme"], F.lit("")) == ""), u["whole"]).when(u["authority"] != "", F.concat(b["scheme"], F.lit(":"), u["whole"])).when(u["path"].startswith("/"), F.concat(root, u["whole"]))
        .when(u["path"] != "", F.concat(root, merged, u["query"], u["fragment"])).when(u["query"] != "", F.concat(root, b["path"], u["query"], u["fragment"])).otherwise(F.concat(root, b["path"], b["query"], u["fragment"]))
    )


def resolve(url: Column, base: Column) -> Column:
    """The absolute address of a reference; empty if that is unsafe."""
    clean = F.regexp_replace(F.regexp_replace(url, r"^[\x00-\x20]+|[\x00-\x20]+$", ""), r"[\t\r\n]", "")
    safe = lambda c: F.when(text.is_safe_url(c), normal(c)).when(c.isNotNull(), "")
    return _let(F.struct(parts(clean).alias("u"), parts(base).alias("b")), lambda x: F.when(x["u"]["whole"] == "", "").otherwise(_let(_joined(x["u"], x["b"]), safe)))


def direct_gif(url: Column) -> Column:
    """The file that a Giphy page or player shows; null for other addresses."""
    found = F.regexp_extract(url, r"(?i)giphy\.com/(?:gifs|embed)/(?:[\w-]*-)?([a-zA-Z0-9]+)(?:[/?#]|$)", 1)
    return F.when(found != "", F.concat(F.lit("https://media.giphy.com/media/"), found, F.lit("/giphy.gif")))

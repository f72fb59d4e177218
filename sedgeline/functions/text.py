"""Text, URL, date, number, hash and JSON functions as column expressions."""

from __future__ import annotations

import re
import unicodedata
from functools import cache, reduce

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# --- strings


def collapse(c: Column) -> Column:
    """Each run of white space, no-break spaces included, as one space."""
    return F.regexp_replace(c, r"(?U)\s+", " ")


def strip(c: Column) -> Column:
    """Without white space of any kind at both ends."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def escape_html(c: Column) -> Column:
    for sign, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        c = F.replace(c, F.lit(sign), F.lit(entity))
    return c


def escape_attr(c: Column) -> Column:
    for sign, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        c = F.replace(c, F.lit(sign), F.lit(entity))
    return c


def unescape_basic(c: Column) -> Column:
    """Named entities of XML; the ampersand last, so nothing is decoded twice."""
    for entity, sign in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"), ("&#39;", "'"), ("&amp;", "&")):
        c = F.replace(c, F.lit(entity), F.lit(sign))
    return c


def base_filename(c: Column) -> Column:
    """File name without extension, size suffixes (``-300x200``, ``-2``) and one short hash.

    The suffixes are looked for in the run of signs that they may hold, and end where the last other sign is."""
    name = F.regexp_replace(c, r"\.[^.]*$", "")
    tail = F.regexp_extract(name, "([-0-9x]*)$", 1)
    parts = F.split(tail, "-")
    sized = F.transform(parts, lambda p, i: (i > 0) & p.rlike("^[0-9]+(?:x[0-9]+)?$"))
    trailing = F.coalesce(F.array_position(F.reverse(sized), F.lit(False)), F.lit(1)) - 1
    kept = F.array_join(F.slice(parts, 1, (F.size(parts) - trailing).cast("int")), "-")
    return F.regexp_replace(F.concat(F.left(name, F.length(name) - F.length(tail)), kept), "-[a-zA-Z0-9]{3,6}$", "")


def selector_list(c: Column) -> Column:
    """Parts between commas or line ends, trimmed, without empty ones."""
    return F.filter(F.transform(F.split(c, r"[\n,]"), strip), lambda x: x != "")


def display_name(first: Column, last: Column) -> Column:
    return F.trim(F.concat_ws(" ", F.coalesce(first, F.lit("")), F.coalesce(last, F.lit(""))))


def short_count(n: Column) -> Column:
    """1234 as 1.2K, 2500000 as 2.5M."""
    tenth = lambda d: F.format_string("%.1f", F.floor(n / d * 10 + 0.5) / 10)
    return F.when(n >= 1_000_000, F.concat(tenth(1_000_000), F.lit("M"))).when(n >= 1000, F.concat(tenth(1000), F.lit("K"))).otherwise(n.cast("string"))


def join_parts(parts: Column, separator: str = "\n\n") -> Column:
    """Trimmed parts that aren't empty."""
    return F.array_join(F.filter(F.transform(parts, strip), lambda x: x != ""), separator)


def contains_any(c: Column, terms: list[str]) -> Column:
    """Case-insensitive; terms are plain text."""
    return reduce(Column.__or__, [F.contains(F.lower(c), F.lit(t.lower())) for t in terms]) if terms else F.lit(False)


# --- folding and search tokens

SEPARATORS = r"[^\p{L}\p{N}]+"


MARKS = r"\p{Mn}+"


@cache
def _fold_map() -> tuple[str, str]:
    """All characters that decompose to a base letter and combining marks, and those letters."""
    parts = ((c, unicodedata.normalize("NFD", c)) for c in map(chr, range(0xC0, 0x20000)))
    pairs = [(c, d[0]) for c, d in parts if d[0] != c and all(unicodedata.category(m) == "Mn" for m in d[1:])]
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


def fold(c: Column) -> Column:
    """Lower case without accents, whether composed or written as combining marks."""
    return F.regexp_replace(F.translate(F.lower(c), *_fold_map()), MARKS, "")


def fold_text(raw: str) -> str:
    """The same of a plain string."""
    folded = raw.lower().translate(str.maketrans(*_fold_map()))
    return "".join(c for c in folded if unicodedata.category(c) != "Mn")


def tokens(c: Column) -> Column:
    return F.filter(F.split(fold(c), SEPARATORS), lambda x: x != "")


# --- URLs


def url_scheme(c: Column) -> Column:
    return F.lower(F.regexp_extract(c, r"^\s*([A-Za-z][A-Za-z0-9+.-]*):", 1))


def is_safe_url(c: Column) -> Column:
    """Not empty, and without a scheme or with one of http, https, mailto."""
    s = url_scheme(c)
    return (F.trim(F.coalesce(c, F.lit(""))) != "") & s.isin("", "http", "https", "mailto")


def host(c: Column) -> Column:
    return F.lower(F.regexp_extract(c, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1))


def host_is(c: Column, domain: str) -> Column:
    """The domain itself or one below it."""
    h = host(c)
    return (h == domain) | h.endswith("." + domain)


def first_match(c: Column, patterns: list[str]) -> Column:
    """First group of the first pattern that matches, else null."""
    return F.coalesce(*[F.nullif(F.regexp_extract(c, p, 1), F.lit("")) for p in patterns])


#: Fixed forms of video and post addresses.
VIDEO_FORMS = [r"youtu\.be/([A-Za-z0-9_-]{6,})", r"[?&]v=([A-Za-z0-9_-]{6,})", r"youtube(?:-nocookie)?\.com/(?:embed|v|shorts|live)/([A-Za-z0-9_-]{6,})"]
CLIP_FORMS = [r"dailymotion\.com/(?:embed/)?video/([A-Za-z0-9]+)", r"dai\.ly/([A-Za-z0-9]+)", r"dailymotion\.com/.*[?&]video=([A-Za-z0-9]+)"]
SUBREDDIT_FORMS = [r"reddit\.com/r/([A-Za-z0-9_]+)", r"^/?r/([A-Za-z0-9_]+)", r"^([A-Za-z0-9_]+)$"]


def video_id(c: Column) -> Column:
    return first_match(c, VIDEO_FORMS)


def clip_id(c: Column) -> Column:
    return first_match(c, CLIP_FORMS)


def status_id(c: Column) -> Column:
    return F.nullif(F.regexp_extract(c, "/status/([0-9]+)", 1), F.lit(""))


def actor_and_post(c: Column) -> Column:
    form = "/profile/([^/]+)/post/([^/?#]+)"
    return F.struct(F.nullif(F.regexp_extract(c, form, 1), F.lit("")).alias("actor"), F.nullif(F.regexp_extract(c, form, 2), F.lit("")).alias("post"))


def subreddit(c: Column) -> Column:
    """Name from an address or name; null unless 2 to 21 word characters."""
    name = first_match(F.trim(c), SUBREDDIT_FORMS)
    return F.when(name.rlike("^[A-Za-z0-9_]{2,21}$"), name)


def links_in_text(c: Column) -> Column:
    """Addresses of markdown links, all of them, then other addresses, each once, without trailing punctuation."""
    marked = F.regexp_extract_all(c, F.lit(r"\[[^\]]*\]\((https?://[^)\s]+)\)"), F.lit(1))
    plain = F.regexp_extract_all(F.regexp_replace(c, r"\[[^\]]*\]\((https?://[^)\s]+)\)", " "), F.lit(r"(https?://[^\s<>\"]+)"), F.lit(1))
    plain = F.array_distinct(F.transform(plain, lambda u: F.regexp_replace(u, r"[.,;:!?)\]]+$", "")))
    return F.concat(marked, F.filter(plain, lambda u: ~F.array_contains(marked, u)))


def page_query(url: Column, n: Column) -> Column:
    return F.when(n <= 1, url).otherwise(F.concat(url, F.when(F.contains(url, F.lit("?")), "&page=").otherwise("?page="), n.cast("string")))


def page_path(url: Column, n: Column) -> Column:
    return F.when(n <= 1, url).otherwise(F.concat(F.regexp_replace(url, "/+$", ""), F.lit("/"), n.cast("string"), F.lit("/")))


def media_kind(c: Column) -> Column:
    path = F.lower(F.regexp_extract(c, r"^([^?#]*)", 1))
    return F.when(path.rlike(r"\.(gifv?|mp4|webm)$"), "video").when(path.rlike(r"\.(jpe?g|png|webp|avif)$"), "image")


def percent_encode(c: Column) -> Column:
    return F.replace(F.url_encode(c), F.lit("+"), F.lit("%20"))


# --- dates and durations


def date_or(c: Column, now: Column) -> Column:
    """A date in ISO or feed form, else ``now``."""
    plain = F.regexp_replace(F.trim(c), r"^[A-Za-z]{3,9},\s*", "")  # the day's name says nothing new
    forms = ["d MMM yyyy HH:mm:ss Z", "d MMM yyyy HH:mm:ss z", "d MMM yyyy HH:mm Z"]
    return F.coalesce(F.try_to_timestamp(c), *[F.try_to_timestamp(plain, F.lit(f)) for f in forms], now)


def iso_millis(c: Column) -> Column:
    return F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


def day_text(c: Column) -> Column:
    return F.date_format(c, "MMM dd, yyyy")


def duration_seconds(c: Column) -> Column:
    """``90``, ``1:30`` or ``1:01:30``; null for anything else."""
    parts = F.split(F.trim(c), ":")
    n = F.transform(parts, lambda p: F.when(p.rlike("^[0-9]+$"), F.try_to_number(p, F.lit("999999999")).cast("long")))
    total = F.aggregate(n, F.lit(0).cast("long"), lambda s, x: s * 60 + x)
    return F.when(F.size(parts) <= 3, total)


def duration_text(seconds: Column) -> Column:
    h, m, s = F.floor(seconds / 3600), F.floor(seconds % 3600 / 60), seconds % 60
    two = lambda x: F.lpad(x.cast("string"), 2, "0")
    return F.when(h > 0, F.concat(h.cast("string"), F.lit(":"), two(m), F.lit(":"), two(s))).otherwise(F.concat(m.cast("string"), F.lit(":"), two(s)))


# --- numbers


def percent(c: Column) -> Column:
    return F.least(F.greatest(F.floor(c), F.lit(0)), F.lit(100)).cast("int")


def int_within(c: Column, low: int, high: int, fallback: int) -> Column:
    """Truncated number if it lies within the bounds, else the fallback (not the bound)."""
    n = F.expr("try_cast(NULL AS double)") if c is None else c.try_cast("double")
    n = F.when(n >= 0, F.floor(n)).otherwise(F.ceil(n))
    return F.when(n.between(low, high), n).otherwise(F.lit(fallback)).cast("int")


def heading_level(c: Column) -> Column:
    return F.least(F.greatest(F.floor(F.coalesce(F.nanvl(c.cast("double"), F.lit(1.0)), F.lit(1.0))), F.lit(1)), F.lit(6)).cast("int")


def pixels(c: Column) -> Column:
    return F.regexp_replace(F.trim(c), "px$", "").try_cast("int")


def too_small(width: Column, height: Column, least: int) -> Column:
    """Only where both sides are known."""
    return F.coalesce((width < least) | (height < least), F.lit(False)) & width.isNotNull() & height.isNotNull()


# --- JSON


def is_json(c: Column) -> Column:
    return F.try_parse_json(c).isNotNull()


def lenient_json(c: Column) -> Column:
    """The text as JSON, else what a code fence holds, else from the first brace to the last."""
    fenced = F.regexp_extract(c, r"(?s)```(?:json)?\s*(.*?)\s*```", 1)
    braced = F.regexp_extract(c, r"(?s)(\{.*\})", 1)
    return F.coalesce(*[F.when(F.try_parse_json(x).isNotNull() & (x != ""), x) for x in (c, fenced, braced)])


def options_from_base64(c: Column) -> Column:
    """A JSON object in base64, else null."""
    raw = F.decode(F.try_to_binary(c, F.lit("base64")), "UTF-8")
    return F.when(F.schema_of_variant(F.try_parse_json(raw)).startswith("OBJECT"), raw)


def image_refs(c: Column, scheme: str = "image") -> Column:
    """Content hashes that a text refers to as ``<scheme>://<hash>``, each once, in order."""
    return F.array_distinct(F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(f"{re.escape(scheme)}://([0-9a-f]{{64}})"), F.lit(1)))


def options(raw: Column, defaults: dict[str, Column], able: dict[str, Column] | None = None) -> Column:
    """Options of a JSON object as strings: known ones alone, with defaults where they are missing; null for those that
    are bound to a capability which isn't there."""
    parts = []
    for name, default in defaults.items():
        value = F.coalesce(F.get_json_object(raw, f"$.{name}"), default.cast("string"))
        parts.append((F.when(able[name], value) if able and name in able else value).alias(name))
    return F.struct(*parts)


# --- providers


def known_provider(url: Column) -> Column:
    """The first provider that knows an address of a video or post; null if none does."""
    return (
        F.when(host_is(url, "youtube.com") | host_is(url, "youtu.be") | host_is(url, "youtube-nocookie.com"), F.when(video_id(url).isNotNull(), "youtube"))
        .when(host_is(url, "dailymotion.com") | host_is(url, "dai.ly"), F.when(clip_id(url).isNotNull(), "dailymotion"))
        .when(host_is(url, "bsky.app"), F.when(actor_and_post(url)["post"].isNotNull(), "bluesky")).when(host_is(url, "twitter.com") | host_is(url, "x.com"), F.when(status_id(url).isNotNull(), "twitter"))
    )


def provider_of(url: Column) -> Column:
    """The same, ``generic`` for others."""
    return F.coalesce(known_provider(url), F.lit("generic"))


# --- decoding

#: Charsets whose bytes Spark decodes under the same name, and the two that share one table.
CHARSETS = {"utf-16": "UTF-16", "utf-16be": "UTF-16BE", "utf-16le": "UTF-16LE", "us-ascii": "US-ASCII"}
#: What windows-1252 has where latin-1 has control codes 128 to 159.
WINDOWS_1252 = "\u20ac\x81\u201a\u0192\u201e\u2026\u2020\u2021\u02c6\u2030\u0160\u2039\u0152\x8d\u017d\x8f\x90\u2018\u2019\u201c\u201d\u2022\u2013\u2014\u02dc\u2122\u0161\u203a\u0153\x9d\u017e\u0178"


#: Names that pages declare for charsets of one byte a sign, by Python's name of each.
SINGLE = {
    "cp1250": ("windows-1250", "cp1250"), "cp1251": ("windows-1251", "cp1251"), "cp1253": ("windows-1253", "cp1253"), "cp1254": ("windows-1254", "iso-8859-9", "latin5"), "cp1255": ("windows-1255", "cp1255"), "cp1256": ("windows-1256", "cp1256"), "cp1257": ("windows-1257", "cp1257"),
    "cp1258": ("windows-1258", "cp1258"), "iso8859-2": ("iso-8859-2", "latin2"), "iso8859-3": ("iso-8859-3",), "iso8859-4": ("iso-8859-4",), "iso8859-5": ("iso-8859-5",), "iso8859-6": ("iso-8859-6",), "iso8859-7": ("iso-8859-7",), "iso8859-8": ("iso-8859-8",), "iso8859-10": ("iso-8859-10",),
    "iso8859-13": ("iso-8859-13",), "iso8859-14": ("iso-8859-14",), "iso8859-15": ("iso-8859-15", "latin9"), "iso8859-16": ("iso-8859-16",), "koi8-r": ("koi8-r",), "koi8-u": ("koi8-u",), "mac-roman": ("macintosh",), "cp866": ("ibm866", "cp866"),
}
#: The same for charsets of several bytes.
SEVERAL = {"shift_jis": ("shift_jis", "shift-jis", "sjis"), "euc_jp": ("euc-jp",), "iso2022_jp": ("iso-2022-jp",), "euc_kr": ("euc-kr", "ks_c_5601-1987"), "gb18030": ("gb18030", "gbk", "gb2312"), "big5": ("big5", "big5-hkscs")}


@cache
def _upper_half(codec: str) -> str:
    """The signs of bytes 128 to 255; bytes without one stay control codes, as in browsers."""
    signs = (bytes([b]).decode(codec, "replace") for b in range(0x80, 0x100))
    return "".join(chr(0x80 + i) if x == "\ufffd" else x for i, x in enumerate(signs))


@F.pandas_udf(StringType())
def _decoded(bodies: pd.Series, codecs: pd.Series) -> pd.Series:
    return pd.Series([None if b is None or c is None else bytes(b).decode(c, "replace") for b, c in zip(bodies, codecs, strict=True)])


def decode_text(body: Column, charset: Column) -> Column:
    """Bytes by declared charset unless that is latin-1 or unknown, else UTF-8 if valid, else latin-1 as browsers read it,
    which is windows-1252.  Charsets of one byte a sign are tables; those of several bytes are read by Python."""
    cs = F.lower(F.trim(F.coalesce(charset, F.lit(""))))
    latin = F.decode(body, "ISO-8859-1")
    western = F.translate(latin, "".join(map(chr, range(0x80, 0xA0))), WINDOWS_1252)
    out = F.when(cs == "windows-1252", western)
    for name, known in CHARSETS.items():
        out = out.when(cs == name, F.decode(body, known))
    for codec, names in SINGLE.items():
        out = out.when(cs.isin(*names), F.translate(latin, "".join(map(chr, range(0x80, 0x100))), _upper_half(codec)))
    codec = F.coalesce(*[F.when(cs.isin(*names), F.lit(c)) for c, names in SEVERAL.items()])
    out = out.when(codec.isNotNull(), _decoded(F.when(codec.isNotNull(), body), codec))
    return out.when(F.is_valid_utf8(body.cast("string")), F.decode(body, "UTF-8")).otherwise(western)

"""Feed documents, OPML and JSON listings as tables, read with Spark's own XML and JSON functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sedgeline.functions import text

_LINK = "array<struct<_href:string,_rel:string,_type:string,_VALUE:string>>"
_MEDIA = "array<struct<_url:string,_type:string,_length:string>>"
_TEXT = "array<struct<_VALUE:string,_type:string>>"
ITEM = f"title string, link {_LINK}, guid {_TEXT}, id string, description string, summary {_TEXT}, content {_TEXT}, `content:encoded` string, encoded string, pubDate string, `dc:date` string, date string, published string, updated string, `dc:creator` string, author string, enclosure {_MEDIA}, `media:thumbnail` {_MEDIA}, `itunes:duration` string"
AUDIO = r"(?i)\.(mp3|m4a|aac|ogg|opus|wav|flac)([?#]|$)"


def _given(*columns: str | Column) -> Column:
    """The first that is not empty."""
    return F.coalesce(*[F.nullif(text.strip(F.col(c) if isinstance(c, str) else c), F.lit("")) for c in columns])


def entries(feeds: DataFrame, xml: str = "xml") -> DataFrame:
    """Entries of RSS or Atom documents, in order: the columns of ``feeds`` but the document, ``position, is_atom`` and
    ``title, url, guid, content, published, author, enclosures, thumbnail, duration``.

    ``<item>`` wins over ``<entry>``.  A document without either gives no row; see :func:`unreadable`."""
    keep = [c for c in feeds.columns if c != xml]
    items = F.regexp_extract_all(xml, F.lit(r"(?s)<item[\s>].*?</item>"), F.lit(0))
    atoms = F.regexp_extract_all(xml, F.lit(r"(?s)<entry[\s>].*?</entry>"), F.lit(0))
    is_atom = F.size(items) == 0
    rows = feeds.select(*keep, is_atom.alias("is_atom"), F.posexplode(F.when(is_atom, atoms).otherwise(items)).alias("position", "raw"))
    # an entry for itself has no namespace declarations, so prefixed names are read as they are
    rows = rows.withColumn("e", F.from_xml("raw", ITEM, {"ignoreNamespace": "false", "attributePrefix": "_", "valueTag": "_VALUE"}))
    link = F.coalesce(
        F.get(F.filter("e.link", lambda x: F.coalesce(x["_rel"], F.lit("alternate")) == "alternate"), F.lit(0))["_href"], F.get("e.link", F.lit(0))["_VALUE"], F.get("e.link", F.lit(0))["_href"]
    )
    guid = F.coalesce(F.get("e.guid", F.lit(0))["_VALUE"], F.col("e.id"))
    rss = _given(F.col("e")["content:encoded"], F.col("e.encoded"), F.col("e.description"))
    atom = _given(F.get("e.content", F.lit(0))["_VALUE"], F.get("e.summary", F.lit(0))["_VALUE"])
    date = F.when(F.col("is_atom"), _given(F.col("e.published"), F.col("e.updated"))).otherwise(_given(F.col("e.pubDate"), F.col("e")["dc:date"], F.col("e.date")))
    return rows.select(
        *keep, "position", "is_atom", _given(F.col("e.title")).alias("title"), text.strip(link).alias("url"), _given(guid, link).alias("guid"), F.when(F.col("is_atom"), atom).otherwise(rss).alias("content"),
        date.alias("published"), _given(F.col("e")["dc:creator"], F.col("e.author")).alias("author"),
        F.transform(F.coalesce("e.enclosure", F.array().cast(_MEDIA)), lambda x: F.struct(x["_url"].alias("url"), x["_type"].alias("type"), x["_length"].try_cast("long").alias("length"))).alias("enclosures"),
        F.get(F.col("e")["media:thumbnail"], F.lit(0))["_url"].alias("thumbnail"), text.duration_seconds(F.col("e")["itunes:duration"]).alias("duration"),
    )


def unreadable(feeds: DataFrame, xml: str = "xml") -> DataFrame:
    """Documents without a single entry: an error of the source."""
    return feeds.where(~F.coalesce(F.col(xml), F.lit("")).rlike(r"<(item|entry)[\s>]"))


def as_articles(entry_rows: DataFrame, now: Column, limit: Column | int = 0) -> DataFrame:
    """Entries as articles; undated ones have no date, and of each feed the first ``limit`` are taken (0: all)."""
    n = limit if isinstance(limit, Column) else F.lit(limit)
    dated = text.date_or(F.col("published"), F.lit(None).cast("timestamp"))
    return entry_rows.where((n == 0) | (F.col("position") < n)).withColumn("date", dated).withColumn("shown_date", F.coalesce("date", now))


def episodes(entry_rows: DataFrame) -> DataFrame:
    """Entries with an audio enclosure: the first by type or file name."""
    audio = F.filter("enclosures", lambda x: F.coalesce(x["type"].startswith("audio/"), F.lit(False)) | F.coalesce(x["url"].rlike(AUDIO), F.lit(False)))
    return entry_rows.withColumn("audio", F.get(audio, F.lit(0))).where("audio is not null")


def within_age(rows: DataFrame, now: Column, days: Column | int) -> DataFrame:
    """Rows that are young enough; undated rows pass, and so does everything at 0 days."""
    d = days if isinstance(days, Column) else F.lit(days)
    return rows.where((d == 0) | F.col("date").isNull() | (F.col("date") >= now - F.make_dt_interval(days=d.cast("int"))))


# --- OPML


def opml(feeds: DataFrame) -> DataFrame:
    """One OPML document per ``user_id`` of rows ``user_id, feed_id, name, aggregator, identifier, tags`` (array)."""
    tags = F.array_join(F.transform("tags", text.percent_encode), ",")
    line = F.format_string('    <outline text="%s" title="%s" type="rss" xmlUrl="%s" aggregator="%s" tags="%s"/>', *[text.escape_attr(F.coalesce(c, F.lit(""))) for c in (F.col("name"), F.col("name"), F.col("identifier"), F.col("aggregator"), tags)])
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("name", "feed_id", line.alias("line")))), lambda x: x["line"]), "\n")  # one user's
    head = '<?xml version="1.0" encoding="UTF-8"?>\n<opml version="2.0">\n  <head><title>Feeds</title></head>\n  <body>\n'
    return feeds.groupBy("user_id").agg(body.alias("body")).select("user_id", F.concat(F.lit(head), F.col("body"), F.lit("\n  </body>\n</opml>\n")).alias("opml"))


def read_opml(documents: DataFrame, xml: str = "opml") -> DataFrame:
    """Leaf outlines in order: the other columns, ``position, name, identifier, aggregator, tags``."""
    keep = [c for c in documents.columns if c != xml]
    rows = documents.select(*keep, F.posexplode(F.regexp_extract_all(xml, F.lit(r"<outline\s[^>]*/>"), F.lit(0))).alias("position", "raw"))
    value = lambda name: text.unescape_basic(F.regexp_extract("raw", rf'\s{name}="([^"]*)"', 1))
    tags = F.filter(F.transform(F.split(value("tags"), ","), lambda x: F.try_url_decode(x)), lambda x: x != "")
    return rows.select(*keep, "position", _given(value("text"), value("title"), value("xmlUrl")).alias("name"), value("xmlUrl").alias("identifier"), F.coalesce(F.nullif(value("aggregator"), F.lit("")), F.lit("feed_content")).alias("aggregator"), tags.alias("tags"))


def classify_opml(outlines: DataFrame, feeds: DataFrame, known: list[str]) -> DataFrame:
    """``outcome`` of each outline: invalid (no address, then unknown aggregator), duplicate (stored, or earlier here), new."""
    key = ["user_id", "aggregator", "identifier"]
    rows = outlines.join(feeds.select(*key).distinct().withColumn("__stored", F.lit(True)), key, "left")
    again = F.row_number().over(Window.partitionBy(*key).orderBy("position")) > 1
    outcome = (
        F.when(F.coalesce("identifier", F.lit("")) == "", "invalid: no address").when(~F.col("aggregator").isin(known), "invalid: unknown aggregator")
        .when(F.col("__stored").isNotNull() | F.col("__again"), "duplicate").otherwise("new")
    )
    return rows.withColumn("__again", again).withColumn("outcome", outcome).drop("__stored", "__again")


# --- JSON listings

POST = "struct<id:string,title:string,author:string,selftext:string,url:string,permalink:string,created_utc:double,score:bigint,num_comments:bigint,is_self:boolean,thumbnail:string>"


def listing(documents: DataFrame, json: str = "json") -> DataFrame:
    """Posts of listings: children of kind ``t3`` in order."""
    keep = [c for c in documents.columns if c != json]
    schema = f"struct<data:struct<children:array<struct<kind:string,data:{POST}>>>>"
    rows = documents.select(*keep, F.posexplode(F.from_json(json, schema)["data"]["children"]).alias("position", "x")).where("x.kind = 't3'")
    return rows.select(*keep, "position", "x.data.*", F.timestamp_seconds("x.data.created_utc").alias("date"))


def worth_showing(posts: DataFrame, now: Column, least_comments: int = 5, least_hours: int = 48, most_days: int = 60) -> DataFrame:
    """Posts of people, with enough comments, neither too fresh nor too old."""
    age = F.unix_timestamp(now) - F.unix_timestamp("date")
    return posts.where((F.lower("author") != "automoderator") & (F.col("num_comments") >= least_comments) & (age >= least_hours * 3600) & (age <= most_days * 86_400))


def channel_id(identifiers: DataFrame, channels: DataFrame, column: str = "identifier") -> DataFrame:
    """Channel of an identifier: a literal id, an id in an address, the exact handle, else the first title that holds it."""
    c = F.trim(column)
    literal = F.coalesce(text.first_match(c, [r"^(UC[A-Za-z0-9_-]{22})$", r"/channel/(UC[A-Za-z0-9_-]{22})"]))
    wanted = F.lower(F.regexp_replace(F.coalesce(text.first_match(c, [r"/@([^/?#]+)", r"/(?:c|user)/([^/?#]+)"]), c), "^@", ""))
    rows = identifiers.withColumn("__id", literal).withColumn("__wanted", wanted)
    handle = rows.join(channels.select(F.lower("handle").alias("__wanted"), F.col("channel_id").alias("__handle")), "__wanted", "left")
    # containment by key: a title that holds a text holds all of its three-letter parts, so also the one that the fewest
    # titles have, and only titles with that part are compared
    open_ = handle.where("__id is null and __handle is null and __wanted <> ''").select("__wanted").distinct()
    grams = lambda c: F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.length(c) - 2, F.lit(1))), lambda i: F.substring(c, i, F.lit(3))))
    short = F.transform(F.sequence(F.lit(1), F.greatest(F.length("__t"), F.lit(1))), lambda i: F.array(F.substring(F.col("__t"), i, F.lit(1)), F.substring(F.col("__t"), i, F.lit(2))))
    parts = channels.select("channel_id", F.lower("title").alias("__t")).withColumn("__g", F.explode(F.array_distinct(F.concat(grams(F.col("__t")), F.flatten(short)))))
    counts = parts.groupBy("__g").agg(F.count(F.lit(1)).alias("__n"))
    rarest = open_.withColumn("__g", F.explode(grams(F.col("__wanted")))).join(counts, "__g", "left").groupBy("__wanted").agg(F.min_by("__g", F.struct(F.coalesce("__n", F.lit(0)), "__g")).alias("__g"))
    titles = rarest.join(parts, "__g").where(F.contains("__t", F.col("__wanted"))).groupBy("__wanted").agg(F.min("channel_id").alias("__title"))
    return handle.join(titles, "__wanted", "left").select(*identifiers.columns, F.coalesce("__id", "__handle", "__title").alias("channel_id"))


# --- files


def files(spark, folder: str) -> DataFrame:
    """Fetched documents on storage: ``path, body`` decoded by :func:`sedgeline.functions.text.decode_text`."""
    raw = spark.read.format("binaryFile").load(folder)
    return raw.select("path", "length", text.decode_text(F.col("content"), F.lit(None).cast("string")).alias("body"))

"""Header pictures: chains of strategies for articles and posts, and the removal of a header's copies in the body.

A chain is a cascade: its stages are tried in order, and a stage sees only rows that no earlier one solved.  Stages that
need nothing but the row are one expression; a stage that must look something up asks for each distinct address once, and
only for those of rows that are still open.  What moves between stages is a key and an address.

Defined results: a row that no stage solves has a null stage and picture; null addresses are skipped; keys may repeat, each
row is judged by itself if keys differ, rows of one key must be equal.  Lookups may miss addresses or tell null.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sedgeline import scratch
from sedgeline.functions import text, urls
from sedgeline.operators import pages
from sedgeline.operators.markdown import decode_entities

#: Gets distinct addresses (``address``), gives ``address, image`` of those that it knows.
Fetch = Callable[[DataFrame], DataFrame]
#: Pictures by the start of an address, endings of pictures, values that are no thumbnail.
OVERRIDES = {"https://en-americas-support.nintendo.com/": "https://upload.wikimedia.org/wikipedia/commons/0/0d/Nintendo.svg"}
ENDINGS = (".jpg", ".jpeg", ".png", ".webp", ".gif")
NO_THUMBNAIL = ("self", "default", "nsfw", "spoiler")
TWEET_HOSTS = ("twitter.com", "x.com")


@dataclass(frozen=True)
class Stage:
    """A strategy: the picture by the row itself, or the address to look it up by."""

    name: str
    image: Column | None = None
    address: Column | None = None


def cascade(rows: DataFrame, key: str, stages: list[Stage], fetch: Fetch) -> DataFrame:
    """``key, stage, image`` of each row: the first stage that gives a picture."""
    solved, todo, at = [], rows, 0
    while at < len(stages):
        if stages[at].address is None:
            upto = next((i for i in range(at, len(stages)) if stages[i].address is not None), len(stages))
            found = F.coalesce(*[F.when(s.image.isNotNull() & (s.image != ""), F.struct(F.lit(s.name).alias("stage"), s.image.alias("image"))) for s in stages[at:upto]])
            todo = scratch.table(todo.withColumn("__found", found), "header-rows")
            solved.append(todo.where("__found is not null").select(key, "__found.stage", "__found.image"))
            todo, at = todo.where("__found is null").drop("__found"), upto
        else:
            asked = todo.select(key, stages[at].address.alias("address")).where("address <> ''")
            answers = asked.join(fetch(asked.select("address").distinct()).where("image <> ''").groupBy("address").agg(F.min("image").alias("image")), "address")
            answers = scratch.table(answers.select(key, F.lit(stages[at].name).alias("stage"), "image").distinct(), "header-answers")
            solved.append(answers)
            todo, at = todo.join(answers.select(key), key, "left_anti"), at + 1
    out = todo.select(key, F.lit(None).cast("string").alias("stage"), F.lit(None).cast("string").alias("image"))
    for part in solved:
        out = part.unionByName(out)
    return out


def override(url: Column) -> Column:
    """The picture of the longest known start of an address."""
    return F.coalesce(*[F.when(url.startswith(start), F.lit(OVERRIDES[start])) for start in sorted(OVERRIDES, key=len, reverse=True)])


def _tweet(url: Column) -> Column:
    return text.host_is(url, TWEET_HOSTS[0]) | text.host_is(url, TWEET_HOSTS[1])


def _ends(url: Column, endings: tuple[str, ...], anywhere: bool = True) -> Column:
    low, out = F.lower(url), F.lit(False)
    for e in endings:
        out = out | (F.contains(low, F.lit(e)) if anywhere else low.endswith(e))
    return out


def _first(items: Column, test: Callable[[Column], Column]) -> Column:
    return F.get(F.filter(items, lambda x: F.coalesce(test(x), F.lit(False))), F.lit(0))


# --- articles


def embedded_thread(url: Column) -> Column:
    """Whether an address is a player of a forum's posts."""
    return F.contains(url, F.lit("vxreddit.com")) | (F.contains(url, F.lit("/embed")) & (F.contains(url, F.lit("reddit.com")) | F.contains(url, F.lit("v.redd.it"))))


def article_headers(articles: DataFrame, fetch: Fetch, key: str = "article_id", url: str = "url") -> DataFrame:
    """``key, stage, image`` of articles: override, embedded thread, the icon of a thread's forum, a video's still in two
    sizes, the page's own picture."""
    u = F.col(url)
    forum = F.when(~embedded_thread(u), F.nullif(F.regexp_extract(u, r"/r/(\w+)/comments/[a-zA-Z0-9]+", 1), F.lit("")))
    still = lambda size: F.concat(F.lit("https://img.youtube.com/vi/"), text.video_id(u), F.lit(f"/{size}.jpg"))
    page = F.when(~F.contains(u, F.lit("v.redd.it")) | embedded_thread(u), u)
    stages = [
        Stage("override", override(u)), Stage("embed", address=F.when(embedded_thread(u), u)), Stage("forum", address=F.concat(F.lit("https://www.reddit.com/r/"), forum, F.lit("/about.json"))),
        Stage("video", address=still("maxresdefault")), Stage("video", address=still("hqdefault")), Stage("page", address=page),
    ]
    return cascade(articles.where(u.isNotNull() & (u != "")).select(key, url), key, stages, fetch)


# --- posts of forums


def _preview(post: str) -> Column:
    """A post's preview: its source, else the last of its sizes."""
    read = F.from_json(F.col(post), "images array<struct<source:struct<url:string>,resolutions:array<struct<url:string>>>>")
    first = F.get(read["images"], F.lit(0))
    return decode_entities(F.coalesce(F.nullif(first["source"]["url"], F.lit("")), F.get(first["resolutions"], F.size(first["resolutions"]) - 1)["url"]))


def _gallery() -> Column:
    """The first picture of a gallery, animated or not."""
    items = F.from_json("gallery_data", "items array<struct<media_id:string>>")["items"]
    known = F.from_json("media_metadata", "map<string,struct<e:string,s:struct<u:string,gif:string,mp4:string>>>")
    one = F.try_element_at(known, F.get(items, F.lit(0))["media_id"])
    moving = F.when(one["e"] == "AnimatedImage", F.coalesce(F.nullif(one["s"]["gif"], F.lit("")), one["s"]["mp4"]))
    return F.when(F.col("is_gallery"), decode_entities(F.coalesce(moving, F.when(one["e"] == "Image", one["s"]["u"]))))


def post_headers(posts: DataFrame, fetch: Fetch, key: str = "post_id") -> DataFrame:
    """``key, stage, image`` of posts (``url, is_self, selftext, is_gallery, gallery_data, media_metadata, preview, thumbnail``):
    override, video, gif page, quoted post in address or text, gallery, picture address, picture of the text or of the page
    that its first link leads to, preview or thumbnail, picture of the linked page."""
    rows = posts.withColumns({"u": decode_entities(F.coalesce("url", F.lit(""))), "links": F.when(F.col("is_self"), text.links_in_text(F.coalesce("selftext", F.lit(""))))})
    before_thread = F.regexp_replace(F.coalesce("selftext", F.lit("")), r"(?s)https?://[^\s]*/comments/[a-zA-Z0-9]+/[^/\s]+/[a-zA-Z0-9]+.*$", "")
    rows = rows.withColumns({"own_links": F.when(F.col("is_self"), text.links_in_text(before_thread)), "shown": _preview("preview")})
    rows = scratch.table(rows.select(key, "u", "links", "own_links", "shown", "is_self", "is_gallery", "gallery_data", "media_metadata", "thumbnail"), "posts")
    u = F.col("u")
    thread = F.rlike(u, F.lit(r"(?i)https?://[^\s]*reddit\.com/r/[^/\s]+/comments/[a-zA-Z0-9]+/[^/\s]+/?$"))
    hosted = lambda x: F.contains(x, F.lit("v.redd.it"))
    told = _first(F.col("links"), lambda x: hosted(x) | text.video_id(x).isNotNull())
    video = F.when(hosted(u), F.lit(None)).when(text.video_id(u).isNotNull(), u).when(~F.coalesce(hosted(told), F.lit(False)), told)
    picture = ~thread & (_ends(u, (*ENDINGS, ".gifv", "i.redd.it")) | (F.contains(F.lower(u), F.lit("preview.redd.it")) & F.contains(F.lower(u), F.lit(".gif"))))
    thumb = F.when(F.col("thumbnail").isin(*NO_THUMBNAIL), F.lit(None)).when(F.startswith("thumbnail", F.lit("http")), decode_entities(F.col("thumbnail"))).when(F.startswith("thumbnail", F.lit("/")), decode_entities(F.concat(F.lit("https://reddit.com"), "thumbnail")))
    stages = [
        Stage("override", override(u)), Stage("video", video), Stage("gif", urls.direct_gif(u)), Stage("quoted", F.when(_tweet(u), u)), Stage("quoted", _first(F.col("links"), _tweet)), Stage("gallery", _gallery()), Stage("picture", F.when(picture, u)),
        Stage("text", _first(F.col("own_links"), lambda x: F.contains(F.lower(x), F.lit("preview.redd.it")) | _ends(x, ENDINGS))), Stage("text", address=_first(F.col("own_links"), lambda x: ~_tweet(x))),
        Stage("thumbnail", F.coalesce("shown", F.when(_ends(u, ENDINGS, False), u), thumb)), Stage("page", address=F.when(~F.col("is_self") & ~thread, u)),
    ]
    return cascade(rows, key, stages, fetch)


# --- copies in the body


def _back() -> object:
    return Window.partitionBy("page_id").orderBy(F.desc("pos")).rowsBetween(Window.unboundedPreceding, 0)


def _path_of(url: Column) -> Column:
    return urls.parts(urls.resolve(url, F.lit("https://example.com")))["path"]


def without_copies(tree: DataFrame, headers: DataFrame, upwards: bool = False) -> DataFrame:
    """The tree without pictures whose address has the path of the page's header (``page_id, image``), and without the
    paragraphs, boxes and figures that held them and hold nothing any more; with ``upwards`` also those around these."""
    keys = headers.where("image <> ''").select("page_id", _path_of(F.col("image")).alias("__path")).distinct()
    shows = (F.col("tag") == "img") & (pages.attr("src") != "") & ~F.startswith(pages.attr("src"), F.lit("data:"))
    copies = tree.where(shows).select("page_id", "pos", "last", _path_of(pages.attr("src")).alias("__path")).join(keys, ["page_id", "__path"], "left_semi")
    marked = tree.join(copies.select("page_id", "pos", F.lit(True).alias("__copy")), ["page_id", "pos"], "left").withColumn("__copy", F.coalesce("__copy", F.lit(False)))
    full = ((F.col("tag") == "#text") & (text.strip(F.col("text")) != "")) | (F.col("tag").isin("img", "iframe", "video", "a") & ~F.col("__copy"))
    next_of = lambda c, v: F.last(F.when(c, v), ignorenulls=True).over(_back())
    marked = marked.withColumns({"__full": next_of(full, F.col("pos")), "__gone": next_of(F.col("__copy"), F.struct("pos", "parent"))})
    held = (F.col("__gone.pos") <= F.col("last")) if upwards else (F.col("__gone.pos") <= F.col("last")) & (F.col("__gone.parent") == F.col("pos"))
    emptied = F.col("tag").isin("p", "div", "figure") & F.coalesce(held, F.lit(False)) & ~F.coalesce(F.col("__full") <= F.col("last"), F.lit(False))
    out = marked.withColumn("__out", pages.within_hit(F.col("__copy") | emptied))
    return out.where("NOT __out").select(*tree.columns)


def without_leading_image(tree: DataFrame, headers: DataFrame) -> DataFrame:
    """On pages with a header (``page_id``): the tree without a picture that comes before any other content, bare or in a
    link, in the body (or its only element) or a paragraph right in it; with a paragraph's breaks and blanks that follow."""
    pos, tag = F.col("pos"), F.col("tag")
    whole = Window.partitionBy("page_id")
    along = whole.orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    rows = tree.join(headers.select("page_id", F.lit(True).alias("__has")).distinct(), "page_id", "left")
    element = ~F.startswith("tag", F.lit("#"))
    rows = rows.withColumn("__body", F.coalesce(F.min(F.when(tag == "body", pos)).over(whole), F.min("parent").over(whole)))
    child = element & (F.col("parent") == F.col("__body"))
    rows = rows.withColumns({"__n": F.sum(child.cast("int")).over(whole), "__one": F.min(F.when(child, F.struct("pos", "tag"))).over(whole)})
    only = (F.col("__n") == 1) & ~F.col("__one.tag").isin("img", "p")
    rows = rows.withColumn("__box", F.when(only, F.col("__one.pos")).otherwise(F.col("__body")))
    passed = tag.isin("html", "head", "body", "p", "a", "br", "#comment") | ((tag == "#text") & (text.strip(F.col("text")) == "")) | (pos <= F.col("__box"))
    rows = rows.withColumn("__solid", F.sum((~passed).cast("int")).over(along))
    holder = {t: F.coalesce(F.try_element_at("within", F.lit(t)), F.lit(-1)) for t in ("p", "a")}
    outer = F.when(holder["p"] > F.col("__box"), holder["p"]).otherwise(F.lit(-1))
    in_link = (holder["a"] == F.col("parent")) & (outer >= 0)
    place = (F.col("parent") == F.col("__box")) | (F.col("parent") == outer) | in_link
    lead = (tag == "img") & (F.col("__solid") == 1) & ~passed & place & F.col("__has")
    rows = rows.withColumn("__lead", F.max(F.when(lead, F.struct(F.when(in_link, holder["a"]).otherwise(pos).alias("pos"), outer.alias("p")))).over(whole))
    gone = pages.within_hit(F.coalesce(pos == F.col("__lead.pos"), F.lit(False)))
    behind = F.coalesce((F.col("__lead.p") >= 0) & (F.try_element_at("within", F.lit("p")) == F.col("__lead.p")) & (pos > F.col("__lead.pos")), F.lit(False))
    rows = rows.withColumns({"__out": gone, "__behind": behind & ~gone})
    more = F.coalesce(F.sum(F.when(F.col("__behind") & (tag != "br") & ~((tag == "#text") & (text.strip(F.col("text")) == "")), 1)).over(along), F.lit(0))
    rows = rows.withColumn("__more", more)
    dropped = F.col("__out") | (F.col("__behind") & (F.col("__more") == 0))
    starts = F.col("__behind") & (F.col("__more") == 1) & (tag == "#text")
    return rows.where(~dropped).withColumn("text", F.when(starts, F.regexp_replace("text", r"(?U)^\s+", "")).otherwise(F.col("text"))).select(*tree.columns)

"""Images, frames, comments and pagers of node tables, and media of JSON posts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sedgeline.functions import text
from sedgeline.operators import pages

#: File names that say nothing about an image.
GENERIC = ("image", "img", "photo", "picture", "thumb", "default", "logo")
_NUMBER = r"([0-9]+)"


def file_name(url: Column) -> Column:
    return F.regexp_extract(F.regexp_extract(url, r"^([^?#]*)", 1), r"([^/]*)$", 1)


def same_image(tree: DataFrame, targets: DataFrame) -> DataFrame:
    """The first image of a page that shows ``targets`` (``page_id, image``): by address, else file name, else base name."""
    src, want = pages.attr("src"), F.col("image")
    base = text.base_filename(file_name(src))
    rank = F.when(src == want, 0).when((file_name(src) != "") & (file_name(src) == file_name(want)), 1).when((F.length(base) > 3) & ~F.lower(base).isin(*GENERIC) & (base == text.base_filename(file_name(want))), 2)
    hits = tree.where("tag = 'img'").join(targets, "page_id").withColumn("rank", rank).where("rank is not null")
    return hits.withColumn("__n", F.row_number().over(Window.partitionBy("page_id").orderBy("rank", "pos"))).where("__n = 1").drop("__n", "rank", "image")


def without_image(tree: DataFrame, targets: DataFrame) -> DataFrame:
    """The tree without that image, and without its paragraph, box or figure if nothing is left in it."""
    hit = same_image(tree, targets)
    left = pages.without(tree, hit)
    emptied = pages.empty_elements(left.where(F.col("tag").isin("p", "div", "figure") | F.startswith("tag", F.lit("#")) | F.col("tag").isin("img", "iframe", "video")))
    parents = emptied.join(hit.select("page_id", F.col("parent").alias("pos")), ["page_id", "pos"], "left_semi")
    return pages.without(left, parents)


def absolute(tree: DataFrame, bases: DataFrame) -> DataFrame:
    """Addresses of images and links made absolute; data, mail, phone and in-page ones stay."""
    keeps = F.lit(r"(?i)^(https?:|data:|mailto:|tel:|#)")
    joined = tree.join(bases, "page_id", "left")
    moved = F.transform_values("attrs", lambda k, v: F.when(k.isin("src", "href") & (v != "") & ~F.rlike(v, keeps), pages.resolve(v, F.col("base"))).otherwise(v))
    return joined.withColumn("attrs", F.when(F.col("tag").isin("img", "a") & F.col("base").isNotNull(), moved).otherwise(F.col("attrs"))).drop("base")


def foreign_frames(tree: DataFrame, hosts: tuple[str, ...]) -> DataFrame:
    """Frames of other hosts than those allowed."""
    allowed = F.lit(False)
    for h in hosts:
        allowed = allowed | text.host_is(pages.attr("src"), h)
    return tree.where((F.col("tag") == "iframe") & ~F.coalesce(allowed, F.lit(False)))


def trimmed(tree: DataFrame, blocks: tuple[str, ...] = ("p", "li", "h1", "h2", "h3", "h4", "h5", "h6", "blockquote", "td")) -> DataFrame:
    """Block elements' first and last own texts without the white space at the outer end."""
    parents = tree.select("page_id", F.col("pos").alias("parent"), F.col("tag").alias("parent_tag")).where(F.col("parent_tag").isin(*blocks))
    own = (F.col("tag") == "#text") & F.col("parent_tag").isin(*blocks)
    w = Window.partitionBy("page_id", "parent")
    marked = tree.join(parents, ["page_id", "parent"], "left").withColumn("__own", F.coalesce(own, F.lit(False))).withColumn("__first", F.min("pos").over(w)).withColumn("__last", F.max("pos").over(w))
    t = F.when(F.col("__own") & (F.col("pos") == F.col("__first")), F.regexp_replace("text", r"(?U)^\s+", "")).otherwise(F.col("text"))
    t = F.when(F.col("__own") & (F.col("pos") == F.col("__last")), F.regexp_replace(t, r"(?U)\s+$", "")).otherwise(t)
    return marked.withColumn("text", t).select(*tree.columns)


def page_numbers(tree: DataFrame, selectors: tuple[str, ...], pattern: str = r"(?:[?&]page=|/)([0-9]+)/?$") -> DataFrame:
    """``page_id, numbers`` of a pager's links, sorted, each once, always with 1."""
    rows = pages.marked(tree, selectors).withColumn("__in", pages.within_hit(F.col("__hit")))
    n = F.when(F.col("__in") & (F.col("tag") == "a"), F.regexp_extract(pages.attr("href"), pattern, 1).try_cast("int"))
    lists = rows.select("page_id", n.alias("n")).groupBy("page_id").agg(F.collect_set(F.when(F.col("n") > 0, F.col("n"))).alias("n"))
    return lists.select("page_id", F.array_sort(F.array_union(F.array(F.lit(1)), "n")).alias("numbers"))


def merged_pages(parts: DataFrame) -> DataFrame:
    """Parts ``article_id, number, plain_text`` of an article as one text, in order of their numbers."""
    return parts.groupBy("article_id").agg(F.array_sort(F.collect_list(F.struct("number", "plain_text"))).alias("p")).select("article_id", text.join_parts(F.transform("p", lambda x: x["plain_text"])).alias("plain_text"))


def _inner_text(at: str, name: str) -> Column:
    """Of an item's nodes: text of those that lie in the element ``at``; null without any."""
    inside = (F.col("tag") == "#text") & (F.col("pos") > F.col(f"{at}.pos")) & (F.col("pos") <= F.col(f"{at}.last"))
    words = F.transform(F.array_sort(F.collect_list(F.when(inside, F.struct("pos", "text")))), lambda x: x["text"])
    return F.when(F.count_if(inside) > 0, text.strip(text.collapse(F.array_join(words, "")))).alias(name)


def comments(tree: DataFrame, items: tuple[str, ...], authors: tuple[str, ...], bodies: tuple[str, ...], n: int) -> DataFrame:
    """``page_id, position, author, body`` of a page's first ``n`` comment elements; those without a body are dropped after.

    Nodes are dealt once, by page, without their attributes: each gets the outermost item around it by a running value, and
    of each item's nodes the first author and the first body."""
    rows = pages.marked(pages.marked(pages.marked(tree, items, "__item"), authors, "__author"), bodies, "__body")
    rows = rows.select("page_id", "pos", "last", "tag", F.when(F.col("tag") == "#text", F.col("text")).alias("text"), "__item", "__author", "__body")
    along = Window.partitionBy("page_id").orderBy("pos")
    rows = rows.withColumn("__head", F.col("__item") & ~pages.within_hit(F.col("__item"), False))
    head = F.last(F.when(F.col("__head"), F.struct("pos", "last")), ignorenulls=True).over(along.rowsBetween(Window.unboundedPreceding, 0))
    place = F.count_if("__head").over(along.rowsBetween(Window.unboundedPreceding, 0))
    rows = rows.withColumns({"head": head, "position": place.cast("int")}).where((F.col("head.last") >= F.col("pos")) & (F.col("position") <= n))
    first = lambda hit: F.min(F.when(F.col(hit) & (F.col("pos") > F.col("head.pos")), F.struct("pos", "last"))).over(Window.partitionBy("page_id", "position"))
    rows = rows.withColumns({"author_at": first("__author"), "body_at": first("__body")})
    made = rows.groupBy("page_id", "position").agg(_inner_text("author_at", "author"), _inner_text("body_at", "body"))
    return made.where("body <> ''").select("page_id", "position", F.coalesce("author", F.lit("Unknown")).alias("author"), "body")


# --- JSON posts

VIDEO = "struct<reddit_video:struct<fallback_url:string,hls_url:string>>"


def video_url(media: Column, secure: Column, preview: Column) -> Column:
    """Of three JSON objects the first with a video; a file before a stream."""
    read = lambda c, field: F.get_json_object(c, f"$.{field}")
    files = [read(media, "reddit_video.fallback_url"), read(secure, "reddit_video.fallback_url"), read(preview, "reddit_video_preview.fallback_url")]
    streams = [read(media, "reddit_video.hls_url"), read(secure, "reddit_video.hls_url"), read(preview, "reddit_video_preview.hls_url")]
    return F.coalesce(*[F.coalesce(f, s) for f, s in zip(files, streams, strict=True)])


def gallery(items: Column, media: Column) -> Column:
    """Addresses of gallery items (``media_id``) by their metadata (a JSON map); items without any are dropped."""
    ids = F.from_json(items, "array<struct<media_id:string,caption:string>>")
    known = F.from_json(media, "map<string,struct<e:string,s:struct<u:string,gif:string,mp4:string>>>")
    urls = F.transform(ids, lambda i: F.struct(F.coalesce(F.try_element_at(known, i["media_id"])["s"]["mp4"], F.try_element_at(known, i["media_id"])["s"]["gif"], text.unescape_basic(F.try_element_at(known, i["media_id"])["s"]["u"])).alias("url"), i["caption"].alias("caption")))
    return F.filter(urls, lambda x: x["url"].isNotNull())


def thumbnail(candidates: Column) -> Column:
    """Of a map by size the largest of the usual ones."""
    return F.coalesce(*[F.try_element_at(candidates, F.lit(k)) for k in ("maxres", "high", "medium")])


# --- video embeds

#: Addresses of a video's player and page by provider.
PLAYERS = {
    "youtube": ("https://www.youtube.com/embed/%s", "https://www.youtube.com/watch?v=%s"),
    "dailymotion": ("https://www.dailymotion.com/embed/video/%s", "https://www.dailymotion.com/video/%s"),
}
#: Bodies of comments that were taken back.
WITHDRAWN = ("[deleted]", "[removed]")


def facade(provider: str, video: Column, label: str, thumbnail: Column | None = None, caption: Column | None = None) -> Column:
    """HTML that stands for a video until it is clicked; null where there is no video."""
    player, page = PLAYERS[provider]
    image = F.when(thumbnail != "", F.format_string('<img src="%s" alt="">', text.escape_attr(thumbnail))) if thumbnail is not None else F.lit(None)
    parts = (
        F.format_string(f'<div class="{provider}-embed-container" data-embed="{player}">', video),
        F.coalesce(image, F.lit("")),
        F.format_string(f'<a href="{page}" target="_blank" rel="noopener">', video), F.lit(f"{label}</a>"),
        F.coalesce(caption, F.lit("")) if caption is not None else F.lit(""),
        F.lit("</div>"),
    )
    return F.when(video.isNotNull(), F.concat(*parts))


def top_comments(threads: DataFrame, n: int) -> DataFrame:
    """Of rows ``video_id, position, body`` each video's first ``n`` comments that have a body and were not taken back."""
    kept = threads.where((F.col("body") != "") & ~F.col("body").isin(*WITHDRAWN))
    ranked = kept.withColumn("__n", F.row_number().over(Window.partitionBy("video_id").orderBy("position", "body")))
    return ranked.where(F.col("__n") <= n).drop("__n")


# --- players described by JSON

#: Fields that may name a player's picture, in order; the site that relative addresses belong to.
PICTURES = ("poster", "image", "thumbnail", "preview", "cover")
PLAYER_SITE = "https://www.tagesschau.de"
_FIELDS = ",".join(f"{f}:string" for f in PICTURES)
PLAYER = f"mc struct<{_FIELDS},streams:array<struct<isAudioOnly:boolean,{_FIELDS},media:array<struct<url:string,mimeType:string>>>>>, pluginData map<string,struct<embedCode:string>>"


def _sited(url: Column) -> Column:
    return F.when(url.startswith("//"), F.concat(F.lit("https:"), url)).when(url.startswith("/"), F.concat(F.lit(PLAYER_SITE), url)).otherwise(url)


def player_headers(tree: DataFrame) -> DataFrame:
    """``page_id, html, image``: a lead header of a page's first player that its JSON attribute describes well enough.

    Players of the page's top go before all others.  Shared embed code goes before sources; of those the first of the wanted
    kind: sound if all streams are sound only, else video.  The picture is the player's, a stream's, or the first one of what
    holds the player.  Attributes that are no JSON describe nothing."""
    classes = F.lower(F.coalesce(pages.attr("class"), F.lit("")))
    back = Window.partitionBy("page_id").orderBy(F.desc("pos")).rowsBetween(Window.unboundedPreceding, 0)
    near = tree.withColumn("img", F.last(F.when((F.col("tag") == "img") & (pages.attr("src") != ""), F.struct("pos", pages.attr("src").alias("src"))), ignorenulls=True).over(back))
    near = near.where(F.col("img.pos") <= F.col("last")).select("page_id", F.col("pos").alias("parent"), F.col("img.src").alias("near"))
    found = tree.where((F.col("tag") == "div") & (pages.attr("data-v-type") == "MediaPlayer") & F.contains(classes, F.lit("mediaplayer")))
    found = found.select("page_id", "pos", "parent", F.contains(classes, F.lit("teaser-top")).alias("top"), F.from_json(text.unescape_basic(pages.attr("data-v")), PLAYER).alias("d")).join(near, ["page_id", "parent"], "left")
    found = found.withColumn("any_top", F.max("top").over(Window.partitionBy("page_id"))).where(F.col("top") == F.col("any_top"))
    streams = F.coalesce(F.col("d.mc.streams"), F.array().cast("array<struct<isAudioOnly:boolean," + _FIELDS + ",media:array<struct<url:string,mimeType:string>>>>"))
    sound = (F.size(streams) > 0) & F.forall(streams, lambda s: F.coalesce(s["isAudioOnly"], F.lit(False)))
    filled = lambda c: F.nullif(c, F.lit(""))
    of_streams = F.get(F.filter(F.transform(streams, lambda s: F.coalesce(*[filled(s[f]) for f in PICTURES])), lambda x: x.isNotNull()), F.lit(0))
    image = _sited(F.coalesce(*[filled(F.col(f"d.mc.{f}")) for f in PICTURES], of_streams, F.col("near")))
    rows = found.withColumns({"sound": sound, "image": F.when(text.is_safe_url(image) | image.startswith("image://"), image)})
    code = text.unescape_basic(F.try_element_at("d.pluginData", F.lit("sharing@web"))["embedCode"])
    frame = _sited(F.replace(filled(F.regexp_extract(code, r"(?i)<iframe\b[^>]*?\ssrc\s*=\s*[\"']?([^\"'\s>]*)", 1)), F.lit("$params$"), F.lit("")))
    kind = F.when(F.col("sound"), "audio").otherwise("video")
    media = F.flatten(F.transform(streams, lambda s: F.coalesce(s["media"], F.array().cast("array<struct<url:string,mimeType:string>>"))))
    source = F.get(F.filter(media, lambda m: F.coalesce(F.contains(F.lower(m["mimeType"]), F.col("kind")) & text.is_safe_url(m["url"]), F.lit(False))), F.lit(0))
    rows = rows.withColumn("kind", kind).withColumns({"frame": F.when(text.is_safe_url(frame), frame), "source": source})
    poster = F.when(F.col("image").isNotNull(), F.concat(F.lit(' poster="'), text.escape_html(F.col("image")), F.lit('"'))).otherwise("")
    framed = F.concat(F.lit('<iframe src="'), text.escape_html(F.col("frame")), F.lit('"'), poster, F.lit(' width="100%" height="'), F.when(F.col("sound"), "200").otherwise("315"), F.lit('" frameborder="0" allowfullscreen scrolling="no"></iframe>'))
    played = F.concat(
        F.lit("<"), F.col("kind"), F.lit(' controls preload="auto"'), poster, F.lit(' style="width: 100%;"><source src="'), text.escape_html(F.col("source.url")), F.lit('" type="'), text.escape_html(F.col("source.mimeType")),
        F.lit('">Your browser does not support the '), F.col("kind"), F.lit(" element.</"), F.col("kind"), F.lit(">"),
    )
    player = F.coalesce(framed, played)
    html = F.concat(F.lit('<header class="media-header"><div class="media-player" style="width: 100%;">'), player, F.lit("</div></header>"))
    best = rows.select("page_id", "pos", html.alias("html"), F.when(~F.coalesce(F.startswith("image", F.lit("image://")), F.lit(False)), F.col("image")).alias("image")).where("html is not null")
    return best.groupBy("page_id").agg(F.min_by(F.struct("html", "image"), "pos").alias("x")).select("page_id", "x.html", "x.image")

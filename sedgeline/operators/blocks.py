"""Nested blocks of pages: lists, items and quotes with what they hold, to any depth, as rows with parents and places.

A page's nodes are sorted twice, forwards and backwards, and every question is a running value along the page: the end of
the outermost element that is read as running text, the innermost link, the next picture.  As elements never cross, "inside
of" is then one comparison; no node carries a list, so work grows with the nodes.  Each node that says something belongs to
one group (its paragraph, its own picture, its stretch of loose text), and one grouping by page and group makes the blocks.
Pages are dealt out once.

What is a block: paragraphs, headings, code, rows of tables (cells joined), loose text between other blocks, pictures,
videos, rules, quotes of posts and players that wait for a click (embeds), lists with their items, and quotes.  Lists keep
only their own items; items, lists and quotes without any block are left out.  Forms, scripts, frames and other things
that are no content (``DROPPED``) go with all they hold, but for players in a lead header.  A figure's caption goes to its
first picture, or is a paragraph after the figure.  Pictures of headers other than the lead go.

Defined results: a page without content has no rows; null attributes and texts count as absent; very long texts are not
cut.  Blank runs at a block's ends go, those within it stay.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sedgeline.functions import text, urls

#: Elements by what they mean for blocks.
INLINE = ("a", "b", "strong", "i", "em", "code", "span", "mark", "u", "s", "strike", "del", "sub", "sup", "small", "abbr", "cite", "q", "time", "label", "font", "ins", "var", "kbd")
DROPPED = ("form", "input", "button", "select", "textarea", "script", "style", "noscript", "iframe", "audio", "svg", "canvas")
UNSEEN = ("head", "title", "template")
HEADINGS = ("h1", "h2", "h3", "h4", "h5", "h6")
BOLD, ITALIC, CODE, STRIKE = ("b", "strong"), ("i", "em", "cite", "var"), ("code", "kbd"), ("s", "strike", "del")
#: Between a table row's cells, hosts of quoted posts, marks of a lead header and of players to be clicked.
CELLS, POST_HOSTS, LEAD = " — ", ("twitter.com", "x.com", "fxtwitter.com"), "media-header"
FACADES = {"youtube-embed": ("youtube", text.video_id, "https://www.youtube.com/watch?v="), "dailymotion-embed": ("dailymotion", text.clip_id, "https://www.dailymotion.com/video/")}
#: Attributes that name a picture that is loaded late, and those that hold a player's markup.
SOURCES, MARKUP = ("src", "data-src", "data-lazy-src"), ("data-sanitized-data-embed-content", "data-embed", "data-sanitized-embed")

RUN = "struct<text:string,bold:boolean,italic:boolean,code:boolean,strikethrough:boolean,link:string>"
BLOCK = f"page_id long, pos long, parent_pos long, position int, kind string, level int, ordered boolean, runs array<{RUN}>, text string, image_ref string, alt string, embed_provider string, embed_url string, thumbnail string, title string, language string"
CONTAINERS = ("list", "list_item", "blockquote")
_RUN_FIELDS = ("text", "bold", "italic", "code", "strikethrough", "link")


def attr(name: str) -> Column:
    return F.col("attrs")[name]


def _inner(*tags: str) -> Column:
    """Place of the innermost element around, of these tags; -1 without any."""
    return F.greatest(F.lit(-1), *[F.coalesce(F.try_element_at("within", F.lit(t)), F.lit(-1)) for t in tags])


def _any(*conditions: Column) -> Column:
    return reduce(Column.__or__, conditions)


def _classes() -> Column:
    return F.split(F.concat_ws(" ", attr("data-sanitized-class"), attr("class")), r"\s+")


def _filled(c: Column) -> Column:
    return F.when(c != "", c)


def _ahead(tree: DataFrame) -> DataFrame:
    """Nodes with what comes next on the page, themselves included: ``n_*`` as place and value."""
    back = Window.partitionBy("page_id").orderBy(F.desc("pos")).rowsBetween(Window.unboundedPreceding, 0)
    tag, href = F.col("tag"), attr("href")
    post = F.when((tag == "a") & text.is_safe_url(href) & _any(*[text.host_is(href, h) for h in POST_HOSTS]), href)
    markup = F.concat_ws(" ", *[attr(a) for a in MARKUP], F.when(tag == "iframe", attr("src")), F.when(tag == "a", href))
    wanted = {
        "post": post,
        "img": F.when(tag == "img", F.coalesce(attr("src"), F.lit(""))),
        "source": F.when(tag == "source", F.coalesce(attr("src"), F.lit(""))),
        "code": F.when(tag == "code", F.coalesce(attr("class"), F.lit(""))),
        **{name: F.when(markup != "", identify(markup)) for name, identify, _ in FACADES.values()},
    }
    next_ = {f"n_{k}": F.last(F.when(v.isNotNull(), F.struct("pos", v.alias("v"))), ignorenulls=True).over(back) for k, v in wanted.items()}
    return tree.withColumns(next_)


def _next(name: str) -> Column:
    """The first value of a kind within the node's own subtree."""
    return F.when(F.col(f"n_{name}.pos") <= F.col("last"), F.col(f"n_{name}.v"))


def _roles(tree: DataFrame, frames: bool) -> DataFrame:
    """Nodes with ``role``, ``embed`` (provider, address, thumbnail) and whether they lie in headers."""
    along = Window.partitionBy("page_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    tag, pos = F.col("tag"), F.col("pos")
    lead = (tag == "header") & F.array_contains(F.split(F.coalesce(attr("class"), F.lit("")), r"\s+"), LEAD)
    upto = lambda c: F.coalesce(F.max(F.when(c, F.col("last"))).over(along) >= pos, F.lit(False))
    rows = _ahead(tree).withColumns({"in_lead": upto(lead), "plain_header": (tag == "header") & ~lead})
    plays = F.lit(True) if frames else F.col("in_lead")
    # a player of the media itself, a quoted post, a facade
    own = F.coalesce(_filled(_next("source")), _filled(attr("src")))
    poster = F.coalesce(_filled(attr("poster")), F.lit(""))
    media = F.when(tag == "video", F.lit("video")).when((tag == "audio") & plays, F.lit("audio" if frames else "generic")).when((tag == "iframe") & plays, F.lit("generic"))
    address = F.when(tag == "iframe", _filled(attr("src"))).otherwise(own)
    provider, url, thumb = F.when(text.is_safe_url(address), media), address, F.when(text.is_safe_url(poster) | poster.startswith("image://"), poster).otherwise(F.lit(""))
    quoted = (tag == "blockquote") & _next("post").isNotNull()
    provider, url, thumb = F.when(quoted, F.lit("tweet")).otherwise(provider), F.when(quoted, _next("post")).otherwise(url), F.when(quoted, F.lit("")).otherwise(thumb)
    wrapper = ~tag.isin(*INLINE, *DROPPED, *UNSEEN, *HEADINGS, "p", "br", "ul", "ol", "blockquote", "pre", "img", "video", "figure", "hr", "tr", "header") & ~tag.startswith("#")
    for mark, (name, _, page) in FACADES.items():
        here = wrapper & F.array_contains(_classes(), mark) & _next(name).isNotNull() & ~F.coalesce(provider.isNotNull(), F.lit(False))
        provider, url, thumb = F.when(here, F.lit(name)).otherwise(provider), F.when(here, F.concat(F.lit(page), _next(name))).otherwise(url), F.when(here, F.coalesce(_next("img"), F.lit(""))).otherwise(thumb)
    rows = rows.withColumn("embed", F.when(provider.isNotNull(), F.struct(provider.alias("provider"), url.alias("url"), thumb.alias("thumbnail"))))
    parent_is = lambda *tags: _any(*[F.coalesce(F.try_element_at("within", F.lit(t)) == F.col("parent"), F.lit(False)) for t in tags])
    role = (
        F.when(tag == "#comment", "none").when((tag == "li") & parent_is("ul", "ol"), "item").when(tag == "#text", "text").when(tag == "br", "text")
        .when(tag.isin("audio", "iframe") & plays, "player").when(tag.isin(*DROPPED, *UNSEEN), "gone").when(tag.isin(*INLINE), "inline").when(tag == "p", "p").when(tag.isin(*HEADINGS), "heading")
        .when(tag.isin("ul", "ol"), "list").when(quoted, "post").when(tag == "blockquote", "quote").when(tag == "pre", "pre").when(tag == "img", "img").when(tag == "video", "player").when(tag == "hr", "hr").when(tag == "tr", "tr")
        .when((tag == "figcaption") & parent_is("figure"), "caption").when(F.col("embed").isNotNull(), "facade").otherwise("wrapper")
    )
    rows = rows.withColumns({"role": role, "stray": parent_is("ul", "ol") & (tag != "li")})
    return rows.drop(*[c for c in rows.columns if c.startswith("n_") and c != "n_code"]).withColumn("n_code", _next("code"))


#: Roles whose elements are read as one thing, whatever they hold.
OPAQUE = ("inline", "p", "heading", "post", "pre", "tr", "caption", "facade", "gone", "player")


def _owned(rows: DataFrame) -> DataFrame:
    """Nodes with the outermost element that is read as one thing (``owner``: null for nodes that are in none), the
    container of their block, the innermost link, and the number of block starts so far (``cut``)."""
    along = Window.partitionBy("page_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy("page_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    pos, role = F.col("pos"), F.col("role")
    opaque = role.isin(*OPAQUE) | F.col("stray")  # a list's other children go, unless they are read with something around
    rows = rows.withColumn("free", pos > F.coalesce(F.max(F.when(opaque, F.col("last"))).over(before), F.lit(-1)))
    lists = _inner("ul", "ol")
    item = F.when((lists >= 0) & (_inner("li") > lists), _inner("li")).otherwise(F.lit(-1))
    held = F.when(role == "item", F.col("parent")).otherwise(F.greatest(item, _inner("blockquote"))).cast("long")
    head = F.when(opaque & F.col("free"), F.struct("pos", "last", F.when(F.col("stray"), "gone").otherwise(role).alias("role"), "parent", held.alias("held")))
    link = F.when((F.col("tag") == "a") & (F.coalesce(attr("href"), F.lit("")) != ""), F.struct("pos", "last", attr("href").alias("href")))
    starts = F.col("free") & ~F.col("stray") & ~role.isin("text", "inline", "gone", "none")
    figure = F.when(F.col("tag") == "figure", F.struct("pos", "last"))
    rows = rows.withColumns({"figure_of": F.last(figure, ignorenulls=True).over(along), "owner": F.last(head, ignorenulls=True).over(along), "link": F.last(link, ignorenulls=True).over(along), "cut": F.sum(starts.cast("int")).over(along)})
    rows = rows.withColumn("owner", F.when(F.col("owner.last") >= pos, F.col("owner"))).withColumn("link", F.when(F.col("link.last") >= pos, F.col("link.href")))
    hidden = F.max(F.when(F.col("plain_header") & F.col("free"), F.col("last"))).over(along)
    rows = rows.withColumn("in_header", F.coalesce(hidden >= pos, F.lit(False)))
    # of a paragraph: whether it lies right in an item (and of which list), and whether in a quote
    within_item = F.when((item >= 0) & (item >= _inner("blockquote")), _inner("ol") > _inner("ul"))
    return rows.withColumns({"held": F.coalesce("owner.held", held), "listed": within_item, "quoted": _inner("blockquote") >= 0})


def _run_of() -> Column:
    tag = F.col("tag")
    raw = F.when(tag == "br", F.lit("\n")).when(F.col("owner.role") == "pre", F.col("text")).otherwise(text.collapse(F.col("text")))
    has = lambda *tags: _inner(*tags) >= 0
    link = F.coalesce(F.when(text.is_safe_url(F.col("link")), F.col("link")), F.lit(""))
    return F.struct(F.col("pos"), raw.alias("text"), (has(*BOLD) | F.coalesce(F.col("cell_tag") == "th", F.lit(False))).alias("bold"), has(*ITALIC).alias("italic"), has(*CODE).alias("code"), has(*STRIKE).alias("strikethrough"), link.alias("link"))


def _trimmed(runs: Column) -> Column:
    """Runs without empty ones and without blank ones at the ends."""
    kept = F.filter(runs, lambda r: r["text"] != "")
    full = F.filter(F.transform(kept, lambda r, i: F.when(text.strip(r["text"]) != "", i)), lambda i: i.isNotNull())
    return F.when(F.size(full) > 0, F.slice(kept, F.array_min(full) + 1, F.array_max(full) - F.array_min(full) + 1)).otherwise(F.slice(kept, 1, 0))


def _said(rows: DataFrame) -> DataFrame:
    """Of nodes that say something: the group that they belong to (``g, h``), its head's ``meta``, their run, their cell."""
    pos, role, owner, tag = F.col("pos"), F.col("role"), F.col("owner"), F.col("tag")
    mine = F.coalesce(owner["pos"] == pos, F.lit(False))
    of = F.coalesce(owner["role"], F.lit(""))
    in_row = of == "tr"
    row = F.when(in_row & (tag == "tr"), pos).when(in_row, F.greatest(_inner("tr"), owner["pos"]))
    cell = F.when(in_row & (tag != "tr") & (_inner("td", "th") > row), _inner("td", "th"))
    rows = rows.withColumns({"row": row.cast("long"), "cell": cell.cast("long"), "cell_tag": F.when(cell.isNotNull(), F.when(_inner("th") == cell, "th").otherwise("td"))})
    gone = F.arrays_overlap(F.map_keys("within"), F.array(*[F.lit(t) for t in (*[d for d in DROPPED if d not in ("iframe", "audio")], *UNSEEN)]))
    kept = ~gone & ~of.isin("gone", "player", "facade") & (~in_row | F.col("cell").isNotNull()) & (_inner("video", "audio", "iframe") < 0)
    says = (role == "text") & F.when(of.isin("pre", "post"), tag == "#text").otherwise(kept)  # code and quoted posts are told as they are
    loose = says & of.isin("", "inline") | (mine & (of == "inline"))
    picture = (role == "img") & ~gone & of.isin("", "p", "inline", "tr") & ~F.col("in_header") & (~in_row | F.col("cell").isNotNull())
    player = (role == "player") & ~gone & of.isin("player", "p", "inline", "tr") & F.col("embed").isNotNull()
    source = F.coalesce(*[_filled(attr(a)) for a in SOURCES])
    box = (F.col("free") & ~F.col("stray") & role.isin("list", "item", "quote", "hr")) | (mine & of.isin("p", "heading", "post", "pre", "facade", "caption")) | (in_row & (tag == "tr"))
    head = box | (picture & (text.is_safe_url(source) | source.startswith("image://"))) | player
    kind = (
        F.when(role == "item", "list_item").when(role == "quote", "blockquote").when(role.isin("list", "heading", "caption"), role).when(role == "pre", "code_block").when(role == "hr", "divider").when(role == "img", "image")
        .when(role.isin("post", "facade", "player"), "embed").otherwise("paragraph")
    )
    language = F.regexp_extract(F.coalesce("n_code", F.lit("")), r"(?:^|\s)(?:language|lang)-([A-Za-z0-9_+-]+)", 1)
    figure, ends = F.try_element_at("within", F.lit("figure")), F.when(role == "caption", F.col("figure_of.last"))
    meta = F.struct(
        kind.alias("kind"), F.when(role == "heading", F.substring("tag", 2, 1).cast("int")).alias("level"), F.when(role == "list", tag == "ol").alias("ordered"), F.when(role == "img", source).alias("image_ref"), F.when(role == "img", F.coalesce(attr("alt"), F.lit(""))).alias("alt"),
        F.when(kind == "embed", F.col("embed")).alias("embed"), F.when(role == "pre", language).alias("language"), F.col("last").cast("long").alias("last"), F.when(role.isin("img", "caption"), figure).cast("long").alias("figure"), ends.cast("long").alias("figure_last"),
    )
    group = F.when(head, pos).when(loose, F.when(of == "inline", owner["parent"]).otherwise(F.col("parent"))).when(in_row, F.col("row")).otherwise(owner["pos"])
    part = F.when(head, F.lit(-1)).when(loose, F.col("cut")).otherwise(F.lit(-1))
    said = rows.where(head | says | loose)
    return said.select("page_id", F.col("pos").cast("long").alias("pos"), "held", F.struct("listed", "quoted").alias("within"), "cell", group.cast("long").alias("g"), part.cast("long").alias("h"), F.when(head, meta).alias("meta"), F.when(says, _run_of()).alias("run"))


def _grouped(said: DataFrame) -> DataFrame:
    """One row per group: ``page_id, pos, held, meta, runs``; the cells of a table row are joined."""
    plain = lambda runs: F.transform(runs, lambda r: F.struct(*[r[f].alias(f) for f in _RUN_FIELDS]))
    cells = said.groupBy("page_id", "g", "h", "cell").agg(F.min("pos").alias("pos"), F.first("held").alias("held"), F.min_by("within", "pos").alias("within"), F.first("meta", ignorenulls=True).alias("meta"), F.array_sort(F.collect_list("run")).alias("runs"))
    cells = cells.withColumn("runs", plain(F.when(F.col("meta.kind") == "code_block", F.col("runs")).otherwise(_trimmed(F.col("runs")))))
    parts = F.filter(F.array_sort(F.collect_list(F.struct("cell", "runs"))), lambda c: F.size(c["runs"]) > 0)
    rows = cells.groupBy("page_id", "g", "h").agg(F.min("pos").alias("pos"), F.first("held").alias("held"), F.min_by("within", "pos").alias("within"), F.first("meta", ignorenulls=True).alias("meta"), parts.alias("parts"))
    between = F.array(F.struct(F.lit(CELLS).alias("text"), *[F.lit(False).alias(f) for f in _RUN_FIELDS[1:5]], F.lit("").alias("link")))
    return rows.withColumn("runs", F.flatten(F.transform("parts", lambda c, i: F.when(i > 0, F.concat(between, c["runs"])).otherwise(c["runs"])))).withColumns({"listed": F.col("within.listed"), "quoted": F.col("within.quoted")}).drop("parts", "g", "h", "within")


def _captioned(rows: DataFrame) -> DataFrame:
    """Captions given to their figure's first picture; others are paragraphs after it."""
    figure = Window.partitionBy("page_id", "figure")
    rows = rows.withColumn("figure", F.col("meta.figure")).withColumn("kind", F.coalesce("meta.kind", F.lit("paragraph")))
    own = (F.col("kind") == "image") & (F.col("held") < F.col("figure"))
    told = (F.col("kind") == "caption") & (F.size("runs") > 0)
    rows = rows.withColumns({"first": F.min(F.when(own, F.col("pos"))).over(figure), "caption": F.min(F.when(told, F.struct("pos", "runs"))).over(figure)})
    taken = F.col("figure").isNotNull() & (F.col("kind") == "caption") & F.col("first").isNotNull() & (F.col("pos") == F.col("caption.pos"))
    claims = F.col("figure").isNotNull() & (F.col("pos") == F.col("first"))
    rows = rows.where(~F.coalesce(taken, F.lit(False))).withColumn("runs", F.when(F.col("kind") == "image", F.when(claims, F.coalesce("caption.runs", F.slice("runs", 1, 0))).otherwise(F.slice("runs", 1, 0))).otherwise(F.col("runs")))
    return rows.withColumn("after", F.col("kind") == "caption").withColumn("kind", F.when(F.col("kind") == "caption", "paragraph").otherwise(F.col("kind")))


def _blocks(tree: DataFrame, frames: bool) -> DataFrame:
    """One row per block with content or with a block in it."""
    rows = _captioned(_grouped(_said(_owned(_roles(tree, frames)))))
    kind = F.col("kind")
    joined = F.array_join(F.transform("runs", lambda r: r["text"]), "")
    holds = kind.isin("image", "divider", "embed") | F.when(kind == "code_block", text.strip(joined) != "").otherwise(F.size("runs") > 0)
    rows = rows.withColumns({"joined": joined, "leaf": ~kind.isin(*CONTAINERS) & holds}).where(F.col("leaf") | kind.isin(*CONTAINERS))
    back = Window.partitionBy("page_id").orderBy(F.desc("pos")).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("next", F.last(F.when(F.col("leaf"), F.col("pos")), ignorenulls=True).over(back)).where(F.col("leaf") | (F.col("next") <= F.col("meta.last")))


def nested_blocks(tree: DataFrame, bases: DataFrame | None = None, frames: bool = False) -> DataFrame:
    """Rows of ``BLOCK``: ``pos`` is a block's place on the page and its name, ``parent_pos`` the block that holds it (null
    at the top), ``position`` its place among those.  ``bases`` (``page_id, base``) resolves addresses; with ``frames``,
    frames and audio are embeds wherever they stand."""
    rows, kind, embed = _blocks(_resolved(tree, bases) if bases is not None else tree, frames), F.col("kind"), F.col("meta.embed")
    at = F.when(F.col("after"), F.coalesce("meta.figure_last", "pos")).otherwise(F.col("pos"))
    place = F.row_number().over(Window.partitionBy("page_id", "held").orderBy(at, "after", "pos")) - 1
    title = F.when(embed["provider"] == "tweet", text.strip(text.collapse("joined")))
    shown = {
        "page_id": F.col("page_id"), "pos": F.col("pos"), "parent_pos": F.when(F.col("held") >= 0, F.col("held")), "position": place, "kind": kind, "level": F.col("meta.level"), "ordered": F.col("meta.ordered"),
        "runs": F.when(kind.isin("paragraph", "heading", "image"), F.col("runs")), "text": F.when(kind == "code_block", F.col("joined")), "image_ref": F.col("meta.image_ref"), "alt": F.col("meta.alt"), "embed_provider": embed["provider"],
        "embed_url": embed["url"], "thumbnail": embed["thumbnail"], "title": F.when(kind == "embed", F.coalesce(title, F.lit(""))), "language": F.col("meta.language"),
    }
    return rows.select(*[c.alias(n) for n, c in shown.items()])


def _resolved(tree: DataFrame, bases: DataFrame) -> DataFrame:
    """Addresses of links, pictures and players made absolute; those of stored pictures stay."""
    moved = F.transform_values("attrs", lambda k, v: F.when(k.isin("href", *SOURCES) & ~v.startswith("image://") & (v != ""), urls.resolve(v, F.col("__base"))).otherwise(v))
    return tree.join(bases.select("page_id", F.col("base").alias("__base")), "page_id", "left").withColumn("attrs", F.when(F.col("tag").isin("a", "img") & F.col("__base").isNotNull(), moved).otherwise(F.col("attrs"))).drop("__base")


FLAT = "page_id long, pos long, kind string, level int, ordered boolean, text string, run_count int, image_ref string, embed_provider string, language string, caption string"


def flat_blocks(tree: DataFrame) -> DataFrame:
    """The blocks that hold content themselves, as ``FLAT``: paragraphs of items and quotes are of kinds of their own; an
    embed's address is its ``image_ref``, its thumbnail its ``caption``."""
    rows, kind, embed = _blocks(tree, True), F.col("kind"), F.col("meta.embed")
    told = text.strip(F.array_join(F.transform("runs", lambda r: r["text"]), ""))
    provider = F.when(embed["provider"] == "generic", text.provider_of(embed["url"])).otherwise(embed["provider"])
    words = F.size(F.filter("runs", lambda r: text.strip(r["text"]) != ""))
    flat = F.when(kind == "code_block", "code").when((kind == "paragraph") & F.col("listed").isNotNull(), "list_item").when((kind == "paragraph") & F.col("quoted"), "quote").otherwise(kind)
    shown = {
        "page_id": F.col("page_id"), "pos": F.col("pos"), "kind": flat, "level": F.col("meta.level"), "ordered": F.when(flat == "list_item", F.col("listed")), "text": F.when(kind == "code_block", F.col("joined")).when(kind == "image", F.col("meta.alt")).when(kind == "embed", "").otherwise(F.col("joined")),
        "run_count": F.when(kind.isin("image", "embed", "divider"), 0).otherwise(words), "image_ref": F.coalesce("meta.image_ref", embed["url"]), "embed_provider": provider, "language": F.nullif("meta.language", F.lit("")),
        "caption": F.when(kind == "embed", F.nullif(embed["thumbnail"], F.lit(""))).when((kind == "image") & (F.size("runs") > 0), told),
    }
    return rows.where("leaf").select(*[c.alias(n) for n, c in shown.items()])


def plain_text(rows: DataFrame) -> DataFrame:
    """A page's text from rows of ``BLOCK``: paragraphs, headings, code, captions and titles with empty lines in between."""
    said = F.coalesce("text", F.when(F.col("kind") == "embed", F.col("title")), F.array_join(F.transform("runs", lambda r: r["text"]), ""))
    parts = rows.where(~F.col("kind").isin(*CONTAINERS, "divider")).groupBy("page_id").agg(F.array_sort(F.collect_list(F.struct("pos", said.alias("text")))).alias("parts"))
    return parts.select("page_id", text.join_parts(F.transform("parts", lambda p: p["text"])).alias("plain_text"))

"""Sources as rows of configuration: what is content, what goes, which titles are skipped.

A source is data, not a class: :func:`site_articles` is one DataFrame pipeline for all of them.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sedgeline import scratch
from sedgeline.functions import text
from sedgeline.operators import headers as header_pictures
from sedgeline.operators import pages, threads


@dataclass(frozen=True)
class Site:
    """``skip_folded`` terms are compared without case, ``skip`` and ``skip_prefix`` as they are."""

    content: tuple[str, ...] = pages.CONTENT
    remove: tuple[str, ...] = ()
    first_only: bool = False
    skip_folded: tuple[str, ...] = ()
    skip: tuple[str, ...] = ()
    skip_prefix: tuple[str, ...] = ()
    skip_address: tuple[str, ...] = ()
    skip_body: tuple[str, ...] = ()


_FRAMES = "iframe:not([src*='youtube.com']):not([src*='youtu.be'])"

#: Selectors and terms by source.
SITES: dict[str, Site] = {
    "full_website": Site(remove=(".advertisement", ".ad", ".ads", "[class*='advert']", "[class*='sponsor']", ".social-share", ".newsletter", ".related-articles")),
    "heise": Site(
        content=("#meldung", ".StoryContent"), first_only=True,
        remove=(
            ".ad-label", ".ad", ".article-sidebar", "section", "a[name='meldung.ho.bottom.zurstartseite']", ".a-article-header__lead", ".a-article-header__title", ".a-article-header__publish-info", ".a-article-header__service",
            "a-lightbox.article-image", "figure.a-article-header__image", "div[data-component='RecommendationBox']", ".opt-in__content-container", ".a-box", _FRAMES, ".a-u-inline", ".redakteurskuerzel", ".branding", "a-gift",
            "aside", "script", "style", "noscript", "footer", ".rte__list", "#wtma_teaser_ho_vertrieb_inline_branding",
        ),
        skip_folded=("die Bilder der Woche", "Produktwerker", "heise-Angebot", "#TGIQF", "heise+", "#heiseshow:", "Mein Scrum ist kaputt", "software-architektur.tv", "Developer Snapshots"), skip_body=("event sourcing",),
    ),
    "merkur": Site(
        content=(".idjs-Story",), first_only=True,
        remove=(
            ".id-DonaldBreadcrumb--default", ".id-StoryElement-headline", ".id-StoryElement-image", ".lp_west_printAction", ".lp_west_webshareAction", ".id-Recommendation", ".enclosure", ".id-Story-timestamp", ".id-Story-authors",
            ".id-Story-interactionBar", "[class*='FollowButton']", ".id-Comments", ".id-ClsPrevention", "egy-discussion", "figcaption", "script", "style", _FRAMES, "noscript", "svg", ".id-StoryElement-intestitialLink", ".id-StoryElement-embed--fanq",
        ),
    ),
    "tagesschau": Site(skip=("Livestream:", "tagesschau", "tagesthemen", "11KM-Podcast", "Podcast 15 Minuten", "15 Minuten:"), skip_prefix=("Bilder:",), skip_address=("bilder/blickpunkte", "video")),
    "caschys_blog": Site(content=(".entry-inner",), first_only=True, remove=(".aawp", ".aawp-disclaimer", "script", "style", "noscript", "svg"), skip=("(Anzeige)", "Immer wieder sonntags KW")),
    "mactechnews": Site(content=(".MtnArticle",), remove=(".NewsPictureMobile", "aside", "script", "style", "iframe", "noscript", "svg", "header", ".TexticonBox.Right"), skip_prefix=("TechTicker:",)),
    "mein_mmo": Site(
        content=("div.entry-content", "div.gp-entry-content"), first_only=True,
        remove=(
            "div.wp-block-mmo-recirculation-box", "div.wp-block-mmo-hub-box", "div.reading-position-indicator-end", "label.toggle", "a.wp-block-mmo-content-box", "div.page-links", "div.sources-wrapper", "div.feedback-box",
            "div.wp-block-wbd-affiliate-widget", "script", "style", _FRAMES, "noscript",
        ),
    ),
    "the_verge": Site(content=(".duet--layout--entry-body .duet--article--article-body-component",), remove=(".iframe-sanitize", "aside", "[class*='duet--recirculation']", "[class*='duet--ad']", "[class*='newsletter']", "script", "style", "noscript", "svg")),
    "ars_technica": Site(content=(".post-content",), remove=(".iframe-sanitize", ".ad", "[class*='ad-wrapper']", ".ad--mid-content", ".ad--rail", ".social-share", "aside", "script", "style", "noscript", "svg")),
}


def skipped(site: Site, title: str = "title", url: str = "url") -> Column:
    """Whether a source skips an entry by title or address."""
    t, u = F.coalesce(F.col(title), F.lit("")), F.lower(F.coalesce(F.col(url), F.lit("")))
    tests = [F.contains(t, F.lit(x)) for x in site.skip] + [t.startswith(x) for x in site.skip_prefix] + [F.contains(u, F.lit(x)) for x in site.skip_address]
    tests.append(text.contains_any(t, list(site.skip_folded)))
    return reduce(Column.__or__, tests)


def wanted(rows: DataFrame, aggregator: str = "aggregator", title: str = "title", url: str = "url") -> DataFrame:
    """Rows that their source does not skip."""
    hit = reduce(Column.__or__, [(F.col(aggregator) == name) & skipped(s, title, url) for name, s in SITES.items()])
    return rows.where(~F.coalesce(hit, F.lit(False)))


def site_articles(fetched: DataFrame, site: Site) -> DataFrame:
    """Fetched pages ``page_id, html, summary`` of one source: ``page_id, plain_text``.

    Pages without a content element, or with too little text in it, fall back to the feed's summary."""
    tree = pages.nodes(fetched, stored=False)
    inside = pages.inside_selected(tree.where("tag <> '#comment'"), site.content, site.first_only)
    body = pages.plain_text(pages.blocks(pages.without_selected(inside, (*pages.NEVER, *site.remove))))
    made = fetched.select("page_id", "summary").join(pages.shuffled(pages.generic_content(body)), "page_id", "left").select("page_id", F.coalesce("plain_text", text.strip(F.col("summary"))).alias("plain_text"))
    for term in site.skip_body:
        made = made.where(~F.contains(F.lower(F.coalesce("plain_text", F.lit(""))), F.lit(term)))
    return made


def content_html(tree: DataFrame, site: Site) -> DataFrame:
    """``page_id, html``: a source's content elements without what it removes, cleaned, as HTML; pages without any have no row."""
    kept = pages.without_selected(tree.where("tag <> '#comment'"), (*pages.NEVER, *site.remove))
    heads = pages.outermost(pages.select(kept, site.content), site.first_only).select("page_id", "pos", "last")
    parts = threads.inner_html(pages.unsanitized(pages.clean_attributes(kept, ("data-embed",))), heads)
    return parts.groupBy("page_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("head", "html"))), lambda x: x["html"]), "").alias("html"))  # one page's


def site_documents(fetched: DataFrame, site: Site, forums: DataFrame | None = None, dialects: tuple[threads.Dialect, ...] = (), most: int = 10, headers: DataFrame | None = None) -> DataFrame:
    """From fetch to HTML: ``page_id, html`` of fetched pages ``page_id, url, title, html, summary`` of one source.

    Content, or the feed's summary where a page has none; its lead picture of ``headers`` (``page_id, image``), of which
    copies leave the content; the first ``most`` comments in the first dialect that finds any, on the page itself or, if
    given, on the forum page (``url, html``) that it leads to, each such page being read once."""
    tree = pages.nodes(fetched)
    bases = fetched.select("page_id", F.col("url").alias("base"))
    shown = header_pictures.without_copies(tree, headers) if headers is not None else tree
    body = content_html(shown, site)
    if forums is not None:
        leads = scratch.table(pages.discussion_link(tree, bases), "discussions")
        linked = leads.join(pages.shuffled(forums.withColumnRenamed("html", "forum")), "url").select("page_id", F.col("url").alias("forum_url"), "forum")
        talk, titles = pages.nodes(linked, html="forum"), linked.select("page_id", "forum_url")
    else:
        talk, titles = tree, bases.select("page_id", F.concat("base", F.lit("#comments")).alias("forum_url"))
    said = None
    for d in dialects:
        found = threads.comments(talk, d, bases, most)
        if said is None:
            said = found
        else:
            said = scratch.table(said, "comments")
            said = said.unionByName(found.join(pages.shuffled(said.select("page_id").distinct()), "page_id", "left_anti"))
    out = fetched.select("page_id", "title", "summary").join(pages.shuffled(body.withColumnRenamed("html", "content")), "page_id", "left")
    told = threads.quoted(said.join(pages.shuffled(titles), "page_id"), F.col("forum_url")).withColumnRenamed("html", "comments") if said is not None else fetched.select("page_id", F.lit(None).cast("string").alias("comments")).limit(0)
    out = out.join(pages.shuffled(told), "page_id", "left")
    out = out.join(pages.shuffled(headers), "page_id", "left") if headers is not None else out.withColumn("image", F.lit(None).cast("string"))
    content = F.when(text.strip(F.coalesce("content", F.lit(""))) != "", F.col("content")).otherwise(F.col("summary"))
    return out.select("page_id", pages.article_html(content, pages.header_html(F.col("image"), F.col("title")), F.col("comments")).alias("html"))

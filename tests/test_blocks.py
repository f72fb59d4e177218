"""Nested blocks and trees against plain recursion over the same nodes."""

import json
import random
import re

import pytest

from sedgeline import scratch
from sedgeline.functions import markup
from sedgeline.operators import blocks as B
from sedgeline.operators import pages, trees


class Tree:
    """Recursion over a page's nodes."""

    def __init__(self, html):
        self.rows = markup.nodes_of(html)
        self.kids = {}
        for r in self.rows:
            self.kids.setdefault(r[1], []).append(r)

    def below(self, r, top):
        for k in self.kids.get(r[0], []):
            yield k
            yield from self.below(k, top)

    def runs(self, r, bold=False):
        out = []
        for k in self.kids.get(r[0], []):
            tag = k[4]
            if tag == "#text":
                out.append((self.norm(k[6]), bold))
            elif tag == "br":
                out.append(("\n", bold))
            elif tag not in B.DROPPED and tag not in ("#comment", "img", "video"):
                out += self.runs(k, bold or tag in B.BOLD)
        return [x for x in out if x[0]]

    @staticmethod
    def norm(t):
        return re.sub(r"\s+", " ", t)

    @staticmethod
    def trim(runs):
        while runs and not runs[0][0].strip():
            runs = runs[1:]
        while runs and not runs[-1][0].strip():
            runs = runs[:-1]
        return runs

    def media(self, r):
        for k in self.kids.get(r[0], []):
            if k[4] == "img" and dict(k[5]).get("src"):
                yield ("image", dict(k[5])["src"])
            elif k[4] not in B.DROPPED and k[4] != "video":
                yield from self.media(k)

    def convert(self, at, quiet=False):
        out, line, waiting = [], [], []

        def flush():
            nonlocal line, waiting
            if runs := self.trim(line):
                out.append(("paragraph", runs))
            out.extend(waiting)
            line, waiting = [], []

        for k in self.kids.get(at, []):
            tag = k[4]
            if tag == "#text":
                line.append((self.norm(k[6]), False))
            elif tag == "br":
                line.append(("\n", False))
            elif tag == "#comment" or tag in B.DROPPED:
                continue
            elif tag in B.INLINE:
                line += [(t, b or tag in B.BOLD) for t, b in self.runs(k)]
                waiting += [] if quiet else list(self.media(k))
            else:
                flush()
                if tag == "p" or tag in B.HEADINGS:
                    if runs := self.trim(self.runs(k)):
                        out.append(("paragraph" if tag == "p" else "heading", runs))
                    out += list(self.media(k)) if tag == "p" and not quiet else []
                elif tag in ("ul", "ol"):
                    items = [("list_item", x) for li in self.kids.get(k[0], []) if li[4] == "li" and (x := self.convert(li[0], quiet))]
                    out += [("list", items)] if items else []
                elif tag == "blockquote":
                    out += [("blockquote", x)] if (x := self.convert(k[0], quiet)) else []
                elif tag == "pre":
                    text = "".join(x[6] for x in self.below(k, k) if x[4] == "#text")
                    out += [("code_block", text)] if text.strip() else []
                elif tag == "img":
                    out += [("image", dict(k[5])["src"])] if dict(k[5]).get("src") and not quiet else []
                elif tag == "hr":
                    out.append(("divider", None))
                elif tag == "tr":
                    cells = [c for c in self.kids.get(k[0], []) if c[4] in ("td", "th")]
                    runs = [x for x in (self.trim([(t, b or c[4] == "th") for t, b in self.runs(c)]) for c in cells) if x]
                    joined = [r for i, x in enumerate(runs) for r in ([(B.CELLS, False)] if i else []) + x]
                    out += [("paragraph", joined)] if joined else []
                    out += [] if quiet else [m for c in cells for m in self.media(c)]
                elif tag == "header":
                    out += self.convert(k[0], True)
                else:
                    out += self.convert(k[0], quiet)
        flush()
        return out


def shown(rows):
    kids = {}
    for r in sorted(rows, key=lambda r: r.position):
        kids.setdefault(r.parent_pos, []).append(r)

    def of(parent):
        out = []
        for r in kids.get(parent, []):
            runs = [(x.text, x.bold) for x in r.runs or []]
            out.append((r.kind, of(r.pos) if r.kind in B.CONTAINERS else r.text if r.kind == "code_block" else r.image_ref if r.kind == "image" else None if r.kind == "divider" else runs))
        return out

    return of(None)


TAGS = ("div", "p", "ul", "ol", "li", "li", "li", "blockquote", "b", "a", "span", "img", "hr", "br", "pre", "TABLE", "h2", "form", "section", "header")


def page(rng, n):
    out, open_ = [], []
    for _ in range(n):
        x = rng.random()
        if x < 0.4:
            out.append(rng.choice((" ", "word ", " two words", "\n", "x", "<!-- c -->")))
        elif x < 0.75:
            tag = rng.choice(TAGS)
            if tag == "TABLE":
                out.append("<table><tr><th>a <b>b</b><td> <img src=c>d<tr><td> <td>e</table>")
                continue
            out.append(f'<{tag} src="/{rng.randrange(99)}.jpg">' if tag == "img" and rng.random() < 0.8 else f"<{tag}>")
            if tag not in markup.VOID:
                open_.append(tag)
        elif open_:
            out.append(f"</{open_.pop(rng.randrange(len(open_)) if rng.random() < 0.2 else -1)}>")
    return "".join(out)


def tree_of(spark, htmls):
    df = spark.createDataFrame(list(enumerate(htmls)), "page_id long, html string")
    return pages.nodes(df)


def test_random_pages_match_recursion(spark):
    rng = random.Random(11)
    htmls = [page(rng, rng.choice((5, 20, 60, 200))) for _ in range(300)]
    by = {}
    for r in B.nested_blocks(tree_of(spark, htmls)).collect():
        by.setdefault(r.page_id, []).append(r)
    wrong = []
    for i, h in enumerate(htmls):
        if shown(by.get(i, [])) != Tree(h).convert(-1):
            wrong.append((h, shown(by.get(i, [])), Tree(h).convert(-1)))
    assert not wrong, min(wrong, key=lambda w: len(w[0]))


def test_figures_players_quotes_and_late_pictures(spark):
    html = """<figure><img src=a><img src=b><figcaption>Cap <b>bold</b></figcaption></figure><figure><figcaption>First</figcaption><p>words</p></figure><img data-lazy-src=c><img data-src=d src=""><img>
    <blockquote><p>said  so</p><a href="https://mobile.twitter.com/u/status/1">x</a></blockquote><div class="youtube-embed"><img src=t><a href="https://youtu.be/abcdefgh">p</a></div><div class="youtube-embed"><p>no player</p></div>
    <video poster=p><source src=v><source src=w>old browser</video><iframe src="https://ads"></iframe><header class="media-header top"><iframe src="https://play" poster=q></iframe><audio src=s></audio><img src=l></header><header><img src=logo>By <b>me</b></header>
    <pre><code class="x language-c++"> a
  b</code></pre><svg><img src=no></svg><p>t <button>no</button>u<a href="javascript:x">v</a></p><table><tr><th>h</th><td>1 <img src=i></td></tr></table>"""
    rows = sorted(B.nested_blocks(tree_of(spark, [html])).collect(), key=lambda r: r.position)
    said = lambda r: "".join(x.text for x in r.runs or [])
    assert [(r.kind, r.image_ref or r.embed_url or r.text or said(r)) for r in rows] == [
        ("image", "a"), ("image", "b"), ("paragraph", "words"), ("paragraph", "First"), ("image", "c"), ("image", "d"), ("embed", "https://mobile.twitter.com/u/status/1"), ("embed", "https://www.youtube.com/watch?v=abcdefgh"), ("paragraph", "no player"),
        ("embed", "v"), ("embed", "https://play"), ("embed", "s"), ("image", "l"), ("paragraph", "By me"), ("code_block", " a\n  b"), ("paragraph", "t uv"), ("paragraph", "h — 1 "), ("image", "i"),
    ]
    by = {r.embed_url: r for r in rows if r.kind == "embed"}
    assert [x.text for x in rows[0].runs] == ["Cap ", "bold"] and rows[0].runs[1].bold and not rows[1].runs
    assert (by["https://mobile.twitter.com/u/status/1"].embed_provider, by["https://mobile.twitter.com/u/status/1"].title) == ("tweet", "said sox") and by["v"].thumbnail == "p" and by["https://play"].thumbnail == "q"
    assert by["https://www.youtube.com/watch?v=abcdefgh"].thumbnail == "t" and next(r for r in rows if r.kind == "code_block").language == "c++"
    assert not any(x.link for r in rows if r.kind == "paragraph" for x in r.runs)


def test_work_grows_with_the_page(spark):
    """Deep, wide and broken pages; nodes at most a constant times the tags."""
    n = 20_000
    htmls = ["<ul><li>" * 2000 + "deep", "<blockquote>" * 3000 + "q", '<p><a href="/l">l</a></p>' * n, "<p><b>x" * n, "<table><tr><td>" * 500 + "c", "".join(f"<p><b id={i}>x" for i in range(500)), None, "", "plain " * n]
    assert len(markup.nodes_of("<p><b>x" * n)) < 7 * n and len(markup.nodes_of(htmls[5])) < 40 * 500
    rows = B.nested_blocks(tree_of(spark, htmls)).groupBy("page_id", "kind").count().collect()
    got = {(r.page_id, r.kind): r["count"] for r in rows}
    assert got[0, "list"] == 2000 and got[1, "blockquote"] == 3000 and got[2, "paragraph"] == n and got[3, "paragraph"] == n and got[8, "paragraph"] == 1
    assert not any(p in (6, 7) for p, _ in got)


def test_trees_of_random_pages_come_back(spark):
    rng = random.Random(12)
    htmls = [page(rng, rng.choice((5, 40, 120))) for _ in range(60)] + ["<ul><li>" * 300 + "deep", ""]
    rows = scratch.table(trees.stored(B.nested_blocks(tree_of(spark, htmls))), "t")
    articles = spark.range(len(htmls)).withColumnRenamed("id", "article_id")
    docs = scratch.table(trees.documents(trees.typed(rows), articles), "d")
    back = scratch.table(trees.read_documents(docs), "b")
    again = {r.article_id: r.document for r in trees.documents(trees.typed(back), articles).collect()}
    first = {r.article_id: r.document for r in docs.collect()}
    assert again == first and len(first) == len(htmls) and json.loads(first[len(htmls) - 1]) == {"version": 1, "blocks": []}
    assert back.count() == rows.count()


@pytest.mark.parametrize(
    ("document", "kinds"),
    [('{"version":1}', []), ('{"version":1,"blocks":[{"type":"mystery"},{"type":"divider"},7,null]}', ["divider"]), ('{"version":1,"blocks":[{"type":"list","items":[[{"type":"divider"}],3]}]}', ["list", "list_item", "list_item", "divider"]), ('{"version":1,"blocks":[{"type":"heading","level":"9","runs":[{"styles":["bold","odd"]}]}]}', ["heading"])],
)
def test_lenient_reading(spark, document, kinds):
    rows = trees.read_documents(spark.createDataFrame([(1, document)], "article_id long, document string")).collect()
    assert sorted(r.kind for r in rows) == sorted(kinds)
    assert all(r.level == 6 and r.runs[0].bold for r in rows if r.kind == "heading")


@pytest.mark.parametrize("document", ['{"version":2,"blocks":[]}', '{"version":true,"blocks":[]}', "[]", "[" * 100_000])
def test_other_versions_are_an_error(spark, document):
    with pytest.raises(Exception, match="version|levels"):
        trees.read_documents(spark.createDataFrame([(1, document)], "article_id long, document string")).collect()


def test_trees_are_replaced_in_one_write(spark):
    make = lambda a, n: trees.stored(B.nested_blocks(tree_of(spark, [f"<p>{i}</p>" * n if i in a else "" for i in range(10)])))
    path, ids = scratch.new_path(spark, "w"), lambda a: spark.createDataFrame([(i,) for i in a], "article_id long")
    old = make(range(10), 3)
    trees.write_trees(path, old, ids(range(10)), 4)
    trees.write_trees(path, make((1, 2), 1), ids((1, 2, 3)), 4)
    got = {r.article_id: r.blocks for r in trees.block_counts(trees.read_trees(path, old)).collect()}
    assert got == {0: 3, 1: 1, 2: 1, **{i: 3 for i in range(4, 10)}}

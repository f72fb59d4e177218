import pytest
from pyspark.sql import Row

from sedgeline.functions import markup
from sedgeline.operators import pages


def tree(spark, *html):
    return pages.nodes(spark.createDataFrame([Row(page_id=i, html=h) for i, h in enumerate(html)], "page_id long, html string"))


def texts(rows):
    return [r.text for r in sorted(rows.collect(), key=lambda r: (r.page_id, r.pos))]


def tags(html):
    rows = markup.nodes_of(html)
    return [(above(rows, n), n[4]) for n in rows if n[4][0] != "#"]


def above(rows, n):
    """Tags around a node, checked against what it says of itself."""
    chain, at = [], n[1]
    while at >= 0:
        chain.append(at)
        at = rows[at][1]
    chain.reverse()
    assert dict(n[3]) == {rows[p][4]: p for p in chain} and all(p < n[0] <= n[2] <= rows[p][2] for p in chain)
    return [rows[p][4] for p in chain]


def test_implied_ends_and_void_elements():
    assert tags("<ul><li>a<li>b<br>c</ul><p>x<p>y") == [([], "ul"), (["ul"], "li"), (["ul"], "li"), (["ul", "li"], "br"), ([], "p"), ([], "p")]
    assert tags("<table><tr><td>1<td>2<tr><td>3</table>") == [([], "table"), (["table"], "tr"), (["table", "tr"], "td"), (["table", "tr"], "td"), (["table"], "tr"), (["table", "tr"], "td")]
    assert tags("<p>a<div>b</div>") == [([], "p"), ([], "div")]
    assert markup.nodes_of(None) == [] and tags("<p>cut <b") == [([], "p")]


def test_formatting_is_opened_again_in_the_next_paragraph():
    rows = markup.nodes_of("<p><b>one<p>two</b> three")
    assert [(n[6], above(rows, n)) for n in rows if n[4] == "#text"] == [("one", ["p", "b"]), ("two", ["p", "b"]), (" three", ["p"])]


def test_script_text_is_no_markup_and_entities_are_decoded():
    rows = markup.nodes_of('<script>var t="</p>";</script><p>a&amp;b &#233; &nbsp;</p><!-- c -->')
    assert [n[4] for n in rows] == ["script", "#text", "p", "#text", "#comment"] and rows[3][6] == "a&b é \xa0"


@pytest.mark.parametrize(
    ("selector", "found"),
    [("p", 3), (".a", 2), ("p.a", 1), ("#x", 1), ("[href]", 1), ("[class*='b']", 1), ("[class='a b']", 1), ("div p", 2), ("div .a", 1), ("p:not(.a)", 2), ("section div p", 0), ("p >> q", 0), ("", 0), ("li, p", 0)],
)
def test_selectors(spark, selector, found):
    t = tree(spark, '<div class="a b" id="x"><p class="a">1</p><p>2</p></div><p>3</p><a href="/">4</a>')
    assert pages.select(t, [selector]).count() == found


def test_content_is_outermost_first_and_without_what_is_ignored(spark):
    t = tree(spark, "<body><article>a<main>b</main><div class=ad>no</div></article><article>c</article></body>", "<body>whole<script>x</script></body>")
    assert texts(pages.main_content(t, ignore=(".ad",)).where("tag = '#text'")) == ["a", "b", "c", "whole"]
    assert texts(pages.main_content(t, first_only=True, ignore=(".ad",)).where("tag = '#text' and page_id = 0")) == ["a", "b"]


def test_cleaning(spark):
    t = tree(spark, '<p onclick="x" class="c" data-k="1"><a href="javascript:x">l</a><iframe src="/f"></iframe></p>')
    rows = {r.tag: dict(r.attrs) for r in pages.clean_attributes(t).collect()}
    assert rows["p"] == {"data-sanitized-class": "c", "data-sanitized-k": "1"} and rows["a"] == {"href": ""} and "iframe" not in rows


def test_empty_elements(spark):
    t = tree(spark, "<p> </p><p><img src=x></p><div><span></span>t</div>")
    assert sorted(r.tag for r in pages.empty_elements(t).collect()) == ["p", "span"]


def test_links_are_resolved(spark):
    t = tree(spark, *[f'<a href="{h}">x</a>' for h in ("b", "/b", "//o/b", "?q", "#f", "http://o/", "javascript:x", "mailto:a@b")])
    bases = t.select("page_id").distinct().selectExpr("page_id", "'http://h/a/c?x#y' AS base")
    got = {r.href: r.url for r in pages.links(t, bases).collect()}
    assert got == {"b": "http://h/a/b", "/b": "http://h/b", "//o/b": "http://o/b", "?q": "http://h/a/c?q", "#f": "http://h/a/c?x#f", "http://o/": "http://o/", "javascript:x": "", "mailto:a@b": "mailto:a@b"}


def test_blocks_runs_and_plain_text(spark):
    html = '<body><h2>T <i>x</i></h2><p>a <b>bold</b> <a href="/l">li</a></p><ul><li>1<li></ul><ol><li>2</ol><pre>  k\n v</pre><blockquote><p>q</p></blockquote><img src="i.png" alt="A"><hr><iframe src="https://youtu.be/abcdefgh"></iframe></body>'
    t = tree(spark, html)
    b = sorted(pages.blocks(t).collect(), key=lambda r: r.pos)
    assert [(r.kind, r.level, r.ordered, r.text, r.embed_provider) for r in b] == [
        ("heading", 2, None, "T x", None), ("paragraph", None, None, "a bold li", None), ("list_item", None, False, "1", None), ("list_item", None, True, "2", None), ("code", None, None, "  k\n v", None),
        ("quote", None, None, "q", None), ("image", None, None, "A", None), ("divider", None, None, "", None), ("embed", None, None, "", "youtube"),
    ]
    runs = {r.text.strip(): r for r in pages.runs(t).collect()}
    assert runs["bold"].bold and runs["li"].link == "/l" and runs["x"].italic and not runs["x"].bold
    stored = pages.stored_blocks(pages.blocks(t))
    back = pages.rebuilt_tree(stored)
    assert back.count() == stored.count() and back.where("kind = 'list'").count() == 2 and back.where("depth = 1").count() == 2
    orphan = stored.where("kind <> 'list'")
    assert pages.rebuilt_tree(orphan).count() == orphan.count() - 2
    wire = pages.wire_document(stored)
    assert [(r.kind, r.items) for r in sorted(pages.read_wire(wire).collect(), key=lambda r: r.position)][2:4] == [("list", 1), ("list", 1)]
    with pytest.raises(Exception, match="version"):
        pages.read_wire(wire.selectExpr("article_id", "replace(document, '\"version\":1', '\"version\":2') AS document")).collect()


def test_head_choices(spark):
    t = tree(spark, '<link rel="alternate" type="application/atom+xml" href="/a"><link rel="alternate" type="application/rss+xml" href="/r"><link rel=icon sizes=32x32 href=s><link rel=icon sizes=any href=v><link rel="apple-touch-icon" href=t><meta property="og:image" content="/o"><img src=small width=10 height=10><img src=big>')
    bases = t.select("page_id").distinct().selectExpr("page_id", "'http://h/' AS base")
    assert pages.feed_link(t, bases).first().url == "http://h/r" and pages.best_icon(t).first().icon == "t" and pages.header_image(t, bases).first().image == "http://h/o"
    assert pages.header_image(t.where("tag <> 'meta'"), bases).first().image == "http://h/big"


def test_pages_as_deep_as_they_are_long(spark):
    deep = "<i>" * 20_000 + "in" + "<div>" + "<section>" * 5_000 + "end"
    rows = markup.nodes_of(deep)
    assert len(rows) == 25_003 and max(len(n[3]) for n in rows) == 3 and rows[0][2] == 25_002
    t = tree(spark, deep)
    assert pages.empty_elements(t).count() == 0 and pages.inside_selected(t, ("div section",)).count() == 5_001


def test_blocks_of_any_depth_are_rebuilt_and_loops_are_an_error(spark):
    chain = [(f"b{i}", 1, f"b{i - 1}" if i else None, 0, "p", "") for i in range(70)] + [("orphan", 1, "gone", 0, "p", "")]
    rows = spark.createDataFrame(chain, pages.TREE.replace(", ", " string, ").replace("article_id string", "article_id long").replace("position string", "position int") + " string")
    got = {r.block_id: (r.depth, len(r.path)) for r in pages.rebuilt_tree(rows).collect()}
    assert got == {f"b{i}": (i, i + 1) for i in range(70)}
    loop = spark.createDataFrame([("a", 1, "b", 0, "p", ""), ("b", 1, "a", 0, "p", ""), ("r", 1, None, 0, "p", "")], rows.schema)
    with pytest.raises(ValueError):
        pages.rebuilt_tree(loop)


def test_titles_decode_three_codes_once_and_in_order(spark):
    html = ["<title>a &amp;lt; &quot;b&quot; &amp</title>", "<title></title><title>late</title>", "<title>cut", "<p>none</p>", None, "<svg><title>x<b>y</title>"]
    rows = spark.createDataFrame(list(enumerate(html)), "page_id long, html string")
    assert {r.page_id: r.title for r in pages.titles(rows).collect()} == {0: "a &lt; &quot;b&quot; &amp", 1: "", 2: "cut", 5: "x"}

import pytest

from sedgeline.operators import markdown as M


@pytest.fixture(scope="module")
def html(spark):
    cases = {
        "# T *x*": "<h1>T <em>x</em></h1>", "a **b** __c__ ~~d~~ `e<`": "<p>a <strong>b</strong> <strong>c</strong> <del>d</del> <code>e&lt;</code></p>", "a\nb\n\nc": "<p>a b</p>\n<p>c</p>",
        "- a\n- b\n1. c\n2) d": "<ul><li>a</li><li>b</li></ul>\n<ol><li>c</li><li>d</li></ol>", "> q\n>> r": "<blockquote><p>q</p><blockquote><p>r</p></blockquote></blockquote>", "```\n<b> *x*\n```\ny": "<pre><code>&lt;b&gt; *x*</code></pre>\n<p>y</p>",
        "[t](http://h/a) http://i/b.": '<p><a href="http://h/a">t</a> <a href="http://i/b">http://i/b</a>.</p>', "[t](javascript:x)": "<p>[t](javascript:x)</p>", ">!s!< x^2 y^(a b)": '<p><span class="spoiler">s</span> x<sup>2</sup> y<sup>a b</sup></p>',
        "\\*no\\* snake_case_name": "<p>*no* snake_case_name</p>", "a|b\n-|-\n1|2": "<table><tr><th>a</th><th>b</th></tr><tr><td>1</td><td>2</td></tr></table>", "": "", "---": "<hr>", "1 < 2 & 3": "<p>1 &lt; 2 &amp; 3</p>",
    }
    df = spark.createDataFrame([(i, k) for i, k in enumerate(cases)], "id int, body string")
    got = {r.id: r.html for r in M.to_html(df, "id", "body").collect()}
    return {k: (got[i], v) for i, (k, v) in enumerate(cases.items())}


def test_posts(html):
    for source, (got, want) in html.items():
        assert got == want, source


def test_entities(spark):
    rows = [("&#65;&#x42; &amp;lt; &lt;", "AB &lt; <"), ("&#233;&#x1F600;", "é\U0001f600"), ("&#99999999; &#xD800; &#0;", "&#99999999; &#xD800; &#0;"), ("plain", "plain"), ("", ""), ("a&#10;", "a\n")]
    df = spark.createDataFrame(rows, "c string, want string")
    got = df.select(M.decode_entities(df.c).alias("got"), "want").collect()
    assert [r.got for r in got] == [r.want for r in got]


def test_lines_of_one_very_long_match(spark):
    """No pattern enters a group once more for each sign of a line."""
    n = 200_000
    lines = [">" * n + " a", "-" * n, "*" + " *" * n, "_ " * n + "x", "> " * n + "b", "#" * n, "|" * n, "1" * n + ". c"]
    df = spark.createDataFrame(list(enumerate(lines)), "id int, body string").repartition(2)
    kinds = {r.id: r.kind for r in M.lines(df, "id", "body").collect()}
    assert [kinds[i] for i in (0, 1, 2, 4, 7)] == ["quote", "hr", "ul", "quote", "ol"]


def test_nested_lists_and_quotes(spark):
    cases = {
        "- a\n  - b\n    1. c\n    2. d\n  - e\n- f": "<ul><li>a<ul><li>b<ol><li>c</li><li>d</li></ol></li><li>e</li></ul></li><li>f</li></ul>", "1. a\n   * b\n2. c": "<ol><li>a<ul><li>b</li></ul></li><li>c</li></ol>",
        "  - a\n - b\n- c": "<ul><li>a</li><li>b</li><li>c</li></ul>", "- a\n\t- b\n\n- c": "<ul><li>a<ul><li>b</li></ul></li></ul>\n<ul><li>c</li></ul>", "- a\n    - b\n  - c\n- d": "<ul><li>a<ul><li>b</li><li>c</li></ul></li><li>d</li></ul>",
        ">>> a\n> b\n>> c": "<blockquote><blockquote><blockquote><p>a</p></blockquote></blockquote><p>b</p><blockquote><p>c</p></blockquote></blockquote>", "> a\n> b": "<blockquote><p>a</p><p>b</p></blockquote>",
        ">" * 40 + "deep": "<blockquote>" * 40 + "<p>deep</p>" + "</blockquote>" * 40,
    }
    df = spark.createDataFrame([(i, k) for i, k in enumerate(cases)], "id int, body string")
    got = {r.id: r.html for r in M.to_html(df, "id", "body").collect()}
    for i, (source, want) in enumerate(cases.items()):
        assert got[i] == want, (source, got[i])


def test_long_lists_are_linear(spark):
    n = 50_000
    df = spark.createDataFrame([(1, "\n".join(" " * (2 * (i % 7)) + "- x" for i in range(n)))], "id int, body string")
    html = M.to_html(df, "id", "body").first().html
    assert html.count("<li>") == n == html.count("</li>") and html.count("<ul>") == html.count("</ul>")

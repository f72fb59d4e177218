import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from sedgeline.functions import text, urls

BASE = "http://a/b/c/d;p?q"
#: The examples of RFC 3986, 5.4, as browsers normalise them.
RFC = {
    "g": "http://a/b/c/g", "./g": "http://a/b/c/g", "g/": "http://a/b/c/g/", "/g": "http://a/g", "//g": "http://g/", "?y": "http://a/b/c/d;p?y", "g?y": "http://a/b/c/g?y", "#s": "http://a/b/c/d;p?q#s", "g#s": "http://a/b/c/g#s",
    "g?y#s": "http://a/b/c/g?y#s", ";x": "http://a/b/c/;x", "g;x": "http://a/b/c/g;x", "g;x?y#s": "http://a/b/c/g;x?y#s", ".": "http://a/b/c/", "./": "http://a/b/c/", "..": "http://a/b/", "../": "http://a/b/", "../g": "http://a/b/g",
    "../..": "http://a/", "../../": "http://a/", "../../g": "http://a/g", "../../../g": "http://a/g", "../../../../g": "http://a/g", "/./g": "http://a/g", "/../g": "http://a/g", "g.": "http://a/b/c/g.", ".g": "http://a/b/c/.g",
    "g..": "http://a/b/c/g..", "..g": "http://a/b/c/..g", "./../g": "http://a/b/g", "./g/.": "http://a/b/c/g/", "g/./h": "http://a/b/c/g/h", "g/../h": "http://a/b/c/h", "g;x=1/./y": "http://a/b/c/g;x=1/y", "g;x=1/../y": "http://a/b/c/y",
    "g?y/./x": "http://a/b/c/g?y/./x", "g?y/../x": "http://a/b/c/g?y/../x", "g#s/../x": "http://a/b/c/g#s/../x",
}
OTHER = {
    "HTTP://U:p@EXAMPLE.com:80/A/../b": "http://U:p@example.com/b", "https://h:443": "https://h/", "https://h:8443/": "https://h:8443/", "a b.html": "http://a/b/c/a%20b.html", "é?ü=\"x\"#ö": "http://a/b/c/%C3%A9?%C3%BC=%22x%22#%C3%B6",
    " \tg\n": "http://a/b/c/g", "x%2e%2e/%2E%2e/y": "http://a/b/c/y", "": "", "javascript:alert(1)": "", "data:image/png;base64,A": "", "mailto:a@b": "mailto:a@b", "100%.html": "http://a/b/c/100%.html",
}


def run(spark, rows):
    df = spark.createDataFrame([Row(u=u, b=b) for u, b in rows], "u string, b string")
    return [r.x for r in df.coalesce(1).select(urls.resolve(F.col("u"), F.col("b")).alias("x")).collect()]


def test_references(spark):
    wanted = RFC | OTHER
    assert dict(zip(wanted, run(spark, [(u, BASE) for u in wanted]), strict=True)) == wanted


def test_bases(spark):
    rows = [("g", None), ("g", "/rel"), (None, BASE), ("g", "http://h"), ("g", "http://h?x"), ("http://o/x", None)]
    assert run(spark, rows) == ["g", "g", None, "http://h/g", "http://h/g", "http://o/x"]


def test_long_addresses(spark):
    up, names = "../" * 100_000 + "end", "/".join(["a"] * 200_000)
    assert run(spark, [(up, BASE), (names, BASE), ("x" * 1_000_000, BASE)]) == ["http://a/end", "http://a/b/c/" + names, "http://a/b/c/" + "x" * 1_000_000]


@pytest.mark.parametrize(
    ("url", "found"),
    [("https://giphy.com/gifs/funny-cat-AbC123", "AbC123"), ("https://giphy.com/embed/XyZ9?x", "XyZ9"), ("https://www.giphy.com/gifs/Q1/", "Q1"), ("https://giphy.com/search/cat", None), (None, None)],
)
def test_gifs(spark, url, found):
    df = spark.createDataFrame([(url,)], "u string").select(urls.direct_gif(F.col("u")).alias("x"))
    assert df.first().x == (found and f"https://media.giphy.com/media/{found}/giphy.gif")


def test_base_filenames(spark):
    long = "a" + "-1" * 500_000
    wanted = {
        "pic-300x200.jpg": "pic", "pic-2-300x200-1.png": "pic", "photo-abc12.jpg": "photo", "a-b-2.gif": "a-b", "plain": "plain", "x-1x": "x-1x", "-1.png": "", "name-1-12x": "name-1", "a--1.jpg": "a-", "a-1-.jpg": "a-1-", "12-3.jpg": "12", "a-x-1.b": "a-x",
        f"{long}.jpg": "a", "": "", "axx-1": "axx", "2020x-5": "2020x",
    }
    df = spark.createDataFrame([(k,) for k in wanted], "u string").coalesce(1)
    got = {r.u: r.x for r in df.select("u", text.base_filename(F.col("u")).alias("x")).collect()}
    assert got == wanted

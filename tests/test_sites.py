from pyspark.sql import Row

from sedgeline.operators import pages
from sedgeline.sources import sites


def test_every_selector_is_understood(spark):
    for name, s in sites.SITES.items():
        for x in (*s.content, *s.remove):
            assert all(pages._simple(part) is not None for part in pages.re.findall(r"(?:\[[^\]]*\]|[^\s\[])+", x)), (name, x)


def test_content_or_summary(spark):
    long = "word " * 30
    rows = [
        Row(page_id=1, html=f"<div class='entry-inner'><p>{long}<iframe src=x></iframe></p><div class=aawp>ad</div></div><div class='entry-inner'>second</div>", summary="s"), Row(page_id=2, html="<p>none</p>", summary=" s "), Row(page_id=3, html=None, summary=None),
    ]
    got = {r.page_id: r.plain_text for r in sites.site_articles(spark.createDataFrame(rows, "page_id long, html string, summary string"), sites.SITES["caschys_blog"]).collect()}
    assert got == {1: long.strip(), 2: "s", 3: None}


def test_titles(spark):
    df = spark.createDataFrame([("heise", "Neues HEISE+ hier", "u"), ("heise", "ok", "u"), ("tagesschau", "Bilder: x", "u"), ("tagesschau", "x Bilder: y", "http://h/Video/1"), ("mactechnews", "techticker: x", "u"), ("other", "heise+", None), (None, None, None)], "aggregator string, title string, url string")
    assert [r.title for r in sites.wanted(df).collect()] == ["ok", "techticker: x", "heise+", None]

from pyspark.sql import functions as F

from sedgeline.operators import media, pages
from tests.test_pages import tree


def test_header_image_is_removed_with_its_empty_box(spark):
    t = tree(spark, "<div><p><img src='http://h/big-1200x800.jpg'></p><img src='/x/big-300x200.jpg?y'><p>t</p></div>", "<img src='/a.png'><img src='/b/a.png'>", "<figure><img src='o.png'></figure>")
    want = spark.createDataFrame([(0, "http://h/x/big-300x200.jpg"), (1, "/b/a.png"), (2, "none.png")], "page_id long, image string")
    assert {r.page_id: dict(r.attrs)["src"] for r in media.same_image(t, want).collect()} == {0: "/x/big-300x200.jpg?y", 1: "/b/a.png"}
    base = spark.createDataFrame([(0, "http://h/big-1200x800.jpg")], "page_id long, image string")
    left = media.without_image(t, base).where("page_id = 0")
    assert sorted(r.tag for r in left.collect()) == ["#text", "div", "img", "p"]


def test_addresses_frames_and_trims(spark):
    t = tree(spark, "<a href='b'>x</a><a href='#f'>y</a><img src='data:x'><iframe src='https://www.youtube.com/embed/a'></iframe><iframe src='https://evil.example/youtube.com'></iframe><p> a <b> b </b> c </p>")
    bases = t.select("page_id").distinct().selectExpr("page_id", "'http://h/' AS base")
    assert sorted(v for r in media.absolute(t, bases).collect() for k, v in dict(r.attrs).items() if r.tag in ("a", "img")) == ["#f", "data:x", "http://h/b"]
    assert [dict(r.attrs)["src"] for r in media.foreign_frames(t, ("youtube.com",)).collect()] == ["https://evil.example/youtube.com"]
    assert [r.text for r in sorted(media.trimmed(t).where("map_contains_key(within, 'p')").collect(), key=lambda r: r.pos) if r.tag == "#text"] == ["a ", " b ", " c"]


def test_pagers_and_comments(spark):
    t = tree(spark, "<div class=pager><a href='?page=3'>3</a><a href='?page=2'>2</a><a href='?page=3'>3</a></div><a href='?page=9'>9</a>", "<p>x</p>")
    assert {r.page_id: r.numbers for r in media.page_numbers(t, (".pager",)).collect()} == {0: [1, 2, 3], 1: [1]}
    c = tree(spark, "<div class=c><i class=who>A</i><p>one <b>bold</b></p><div class=c><p>inner</p></div></div><div class=c><i class=who>B</i></div><div class=c><p>three</p></div><div class=c><p>four</p></div>")
    got = [(r.position, r.author, r.body) for r in sorted(media.comments(c, (".c",), (".who",), ("p",), 3).collect())]
    assert got == [(1, "A", "one bold"), (3, "Unknown", "three")]
    parts = spark.createDataFrame([(1, 10, "c"), (1, 2, "b"), (1, 1, " a ")], "article_id int, number int, plain_text string")
    assert media.merged_pages(parts).first().plain_text == "a\n\nb\n\nc"


def test_json_media(spark):
    row = spark.range(1).select(
        media.video_url(F.lit('{"reddit_video":null}'), F.lit('{"reddit_video":{"hls_url":"h"}}'), F.lit('{"reddit_video_preview":{"fallback_url":"p"}}')).alias("v"),
        media.gallery(F.lit('[{"media_id":"a"},{"media_id":"gone"},{"media_id":"b","caption":"c"}]'), F.lit('{"a":{"s":{"u":"http://u?x&amp;y"}},"b":{"s":{"gif":"g"}}}')).alias("g"),
        media.thumbnail(F.create_map(F.lit("medium"), F.lit("m"), F.lit("high"), F.lit("h"))).alias("t"),
    ).first()
    assert (row.v, [(x.url, x.caption) for x in row.g], row.t) == ("h", [("http://u?x&y", None), ("g", "c")], "h")
    assert pages is not None


def test_facades(spark):
    df = spark.createDataFrame([("a1", 'h/?x="y"', "<p>c</p>"), ("a2", "", None), (None, "t", "c")], "video string, thumbnail string, caption string")
    got = [r.f for r in df.select(media.facade("youtube", F.col("video"), "100% play", F.col("thumbnail"), F.col("caption")).alias("f")).collect()]
    start, link = '<div class="youtube-embed-container" data-embed="https://www.youtube.com/embed/%s">', '<a href="https://www.youtube.com/watch?v=%s" target="_blank" rel="noopener">100%% play</a>'
    assert got == [start % "a1" + '<img src="h/?x=&quot;y&quot;" alt="">' + link % "a1" + "<p>c</p></div>", start % "a2" + link % "a2" + "</div>", None]
    assert df.select(media.facade("dailymotion", F.lit("v"), "L").alias("f")).first().f == '<div class="dailymotion-embed-container" data-embed="https://www.dailymotion.com/embed/video/v"><a href="https://www.dailymotion.com/video/v" target="_blank" rel="noopener">L</a></div>'


def test_top_comments(spark):
    rows = [("v", 3, "c"), ("v", 1, "a"), ("v", 2, "[deleted]"), ("v", 4, "d"), ("w", 1, ""), ("w", 2, None), ("w", 3, "[removed]"), ("x", 1, "e")]
    df = spark.createDataFrame(rows, "video_id string, position int, body string")
    assert sorted((r.video_id, r.body) for r in media.top_comments(df, 2).collect()) == [("v", "a"), ("v", "c"), ("x", "e")]
    assert media.top_comments(df, 0).count() == 0 and media.top_comments(df.limit(0), 2).count() == 0


def test_page_numbers_parse_each_page_once(spark):
    rows = [(1, '<div class="p"><a href="/3/">3</a><a href="?page=2">2</a><a>no</a><a href="?page=0">0</a></div><a href="/9">9</a>'), (2, "<p>none</p>")]
    found = media.page_numbers(pages.nodes(spark.createDataFrame(rows, "page_id long, html string"), stored=False), (".p",))
    assert sorted((r.page_id, r.numbers) for r in found.collect()) == [(1, [1, 2, 3]), (2, [1])]
    assert found._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow") == 1

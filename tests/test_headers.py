"""Header chains, copies and comments on rows with nulls and on empty tables."""

import pytest
from pyspark.sql import functions as F

from sedgeline.operators import headers, media, pages, threads

POSTS = "post_id long, url string, is_self boolean, selftext string, is_gallery boolean, gallery_data string, media_metadata string, preview string, thumbnail string"


def nothing(asked):
    return asked.where("false").withColumn("image", F.lit(None).cast("string"))


def test_chains_ask_once_and_only_for_open_rows(spark):
    seen = []

    def fetch(asked):
        rows = [r.address for r in asked.collect()]
        seen.append(sorted(rows))
        assert len(rows) == len(set(rows))
        return asked.withColumn("image", F.when(F.contains("address", F.lit("maxres")) | F.contains("address", F.lit("bare")), None).otherwise(F.concat(F.lit("i:"), "address")))

    urls = ["https://en-americas-support.nintendo.com/x", "https://vxreddit.com/r/a/comments/b", "https://youtu.be/abcdefgh", "https://youtu.be/abcdefgh", "https://h/page", "https://h/bare", "", None, "https://v.redd.it/x"]
    df = spark.createDataFrame(list(enumerate(urls)), "article_id long, url string")
    got = {r.article_id: (r.stage, r.image) for r in headers.article_headers(df, fetch).collect()}
    assert got == {
        0: ("override", headers.OVERRIDES["https://en-americas-support.nintendo.com/"]), 1: ("embed", "i:" + urls[1]), 2: ("video", "i:https://img.youtube.com/vi/abcdefgh/hqdefault.jpg"), 3: ("video", "i:https://img.youtube.com/vi/abcdefgh/hqdefault.jpg"),
        4: ("page", "i:https://h/page"), 5: (None, None), 8: (None, None),
    }
    assert ["https://h/bare", "https://h/page"] in seen and not any(urls[0] in s for s in seen)


def test_chains_of_nulls_and_empty_tables(spark):
    empty = spark.createDataFrame([], POSTS)
    assert headers.post_headers(empty, nothing).count() == 0 and headers.article_headers(empty.select(F.col("post_id").alias("article_id"), "url"), nothing).count() == 0
    rows = [(1, *[None] * 8), (2, "https://h/x", False, None, True, "no json", "{", "[]", "/t"), (3, "", True, "", True, '{"items":[]}', "{}", '{"images":[]}', "self"), (4, "https://h/x", None, None, None, None, None, None, "http://t/a&amp;b")]
    got = {r.post_id: (r.stage, r.image) for r in headers.post_headers(spark.createDataFrame(rows, POSTS), nothing).collect()}
    assert got == {1: (None, None), 2: ("thumbnail", "https://reddit.com/t"), 3: (None, None), 4: ("thumbnail", "http://t/a&b")}


def tree(spark, *htmls):
    return pages.nodes(spark.createDataFrame(list(enumerate(htmls)), "page_id long, html string"))


def tags(rows):
    return [r.tag for r in sorted(rows.collect(), key=lambda r: (r.page_id, r.pos)) if r.tag[0] != "#"]


@pytest.mark.parametrize(("upwards", "left"), [(False, ["div", "p", "a"]), (True, ["p", "a"])])
def test_copies_and_what_held_them(spark, upwards, left):
    t = tree(spark, '<div><p><img src="/a.jpg?x"></p></div><p><a href=l></a><img src="//cdn/a.jpg"></p>', None)
    image = spark.createDataFrame([(0, "https://o/a.jpg"), (1, None), (7, "/a.jpg")], "page_id long, image string")
    assert tags(headers.without_copies(t, image, upwards)) == left
    assert headers.without_copies(t.where("false"), image).count() == 0 and headers.without_leading_image(t.where("false"), image).count() == 0


def test_leading_image_only_where_nothing_comes_before(spark):
    pages_ = ["<body><img src=a><p>x</p></body>", "<body><hr><img src=a></body>", "<body><p>x</p><img src=a></body>", "<body><div><div><img src=a></div></div></body>", "<body></body>"]
    t = tree(spark, *pages_)
    got = headers.without_leading_image(t, spark.range(len(pages_)).withColumnRenamed("id", "page_id"))
    assert {r.page_id for r in got.where("tag = 'img'").collect()} == {1, 2, 3}


def test_players_that_describe_nothing(spark):
    player = '<div class="MediaPlayer" data-v-type="MediaPlayer"{}></div>'
    t = tree(spark, player.format(""), player.format(' data-v="[1]"'), player.format(' data-v="{&quot;mc&quot;:{&quot;streams&quot;:7}}"'), player.format(' data-v="{}"'), None)
    assert media.player_headers(t).count() == 0


@pytest.mark.parametrize("name", sorted(threads.DIALECTS))
def test_pages_without_comments(spark, name):
    t = tree(spark, "<p>none</p>", None, '<li class="posting_element"></li><div class="MtnCommentScroll"><div class="MtnComment"></div></div><div class="wpd-thread-list"><div class="wpd-comment"></div></div>')
    bases = spark.range(3).select(F.col("id").alias("page_id"), F.lit("https://h/").alias("base"))
    assert threads.quoted(threads.comments(t, threads.DIALECTS[name], bases, 5)).count() == 0

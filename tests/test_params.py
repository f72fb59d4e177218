from hypothesis import given
from hypothesis import strategies as st

from sedgeline import params as P
from sedgeline.operators import search, sync


def test_list_parameters():
    p = P.parse({"page": "0", "pageSize": "500", "q": " x ", "dir": "asc", "sort": "name", "tag": "3", "empty": ""})
    assert (p.page, p.page_size, p.q, p.descending, p.sort, p.filters) == (1, 100, "x", False, "name", {"tag": "3"})
    assert P.parse({"page": "x", "pageSize": ""}) == P.ListParams() and P.parse(dict(x.split("=") for x in P.to_query(p).split("&"))) == p
    far = P.parse({"page": "4"})
    assert P.change(far, q="y").page == 1 and P.change(far, sort="z").page == 4 and far.offset == 75


@given(st.text())
def test_any_text_is_a_cursor_or_zero(raw):
    assert isinstance(P.Cursor.decode(raw), P.Cursor)


@given(st.integers(0, 1 << 40), st.integers(0, 1 << 40))
def test_cursor_round_trip(a, b):
    c = P.Cursor(P.Mark(a, b), P.Mark(b, a), P.Mark(1, 2))
    assert P.Cursor.decode(c.encode()) == c and P.Cursor.decode(None) == P.Cursor() and P.Cursor().is_zero


def test_search_terms():
    assert search.compile_term("  ") is None and search.compile_term("\x00!") is None
    assert search.compile_term("Été foo-bar ba") == [search.Phrase(("ete",)), search.Phrase(("foo", "bar")), search.Phrase(("ba",), True)]
    assert search.compile_term('a" AND') == [search.Phrase(("a",)), search.Phrase(("and",), True)]


def test_phrases_lie_in_one_column(spark):
    df = spark.createDataFrame([(1, "red fox", "runs"), (2, "red", "fox runs"), (3, "Réd Foxes", None)], "doc_id int, name string, plain_text string")
    find = lambda q: sorted(r.doc_id for r in search.search(df, q).collect())
    assert find("red-fox") == [1, 3] and find("red fox") == [1, 2, 3] and find("fox red") == [1, 2] and find("red-fox runs") == [1] and find("") == [1, 2, 3]
    index = search.index(df, "doc_id")
    assert sorted(r.doc_id for r in search.lookup(index, "doc_id", "red-fox").collect()) == [1, 3]


def test_resync():
    c = P.Cursor(removed=P.Mark(1000, 1))
    assert not sync.needs_resync(P.Cursor(), 10**9, None) and sync.needs_resync(c, 1000 + 91 * 86400, None) and not sync.needs_resync(c, 2000, None) and sync.clamp(None) == 200 and sync.clamp(9999) == 500


def test_sync_drains(spark):
    from sedgeline.catalog import Catalog

    c = Catalog(spark, "/root/testdata/sf0.001")
    log = c.articles.limit(0).selectExpr("article_id", "0 AS user_id", "created_at AS deleted_at")
    cursor, seen, want = P.Cursor(), [], c.articles.join(c.feeds.where("user_id = 3"), "feed_id", "left_semi").count()
    for _ in range(50):
        page = sync.changes(c.articles, log, 3, c.feeds, cursor, 40)
        got = [r.article_id for r in page.new.collect()]
        seen += got
        cursor = sync.next_cursor(page, cursor)
        if not got:
            break
    assert len(seen) == len(set(seen)) == want

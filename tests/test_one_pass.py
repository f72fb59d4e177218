"""Queries over pages deal out their nodes as seldom as they can."""

from sedgeline.catalog import Catalog
from sedgeline.functions import markup
from sedgeline.operators import media, pages, threads
from sedgeline.plans import built

SF = "/root/testdata/sf0.001"


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_comment_elements_are_read_in_one_pass(spark):
    """The pages are parsed once and are not stored; their nodes are dealt once by page, and no join brings them together."""
    plan = plan_of(built.page_comment_elements(Catalog(spark, SF)))
    assert plan.count("MapInArrow ") == 1 and plan.count("Exchange hashpartitioning(page_id") == 1 and "Join" not in plan


def test_comment_elements_within_others_before_and_after(spark):
    html = (
        '<p class="b">before</p><div class="c"><i class="u"> </i><div class="c"><p class="u">inner</p></div><p class="b"> one  <b>x</b></p><p class="b">two</p></div><div class="c"><p class="u">none</p></div>'
        '<div class="c"><p class="b"><img></p><p class="b">late</p></div><p class="b">between</p><div class="c b u">own</div><div class="c"><p class="b">fifth</p></div><div class="c"><p class="b">sixth</p></div>'
    )
    tree = pages.nodes(spark.createDataFrame([(1, html), (2, None), (3, "<p>no comment</p>")], "page_id long, html string"), stored=False, within=False)
    got = [tuple(r) for r in media.comments(tree, (".c",), (".u",), (".b",), 5).collect()]
    assert sorted(got) == [(1, 1, "", "one x"), (1, 5, "Unknown", "fifth")]


def test_notes_need_no_way_around_their_nodes(spark, monkeypatch):
    asked, real = [], markup.batches_of
    monkeypatch.setattr(markup, "batches_of", lambda tags, within=True: asked.append(within) or real(tags, within))
    plan = plan_of(built.page_notes(Catalog(spark, SF)))
    assert asked == [False] and plan.count("Exchange hashpartitioning(page_id") == 1


def test_parts_of_comments_are_found_in_one_pass(spark, monkeypatch):
    calls, real = [], threads._first_of
    monkeypatch.setattr(threads, "_first_of", lambda *a: calls.append(1) or real(*a))
    html = '<div class="posting" id="a"><strong>me</strong><p>old</p><div class="text">said</div></div><div class="posting"><p>only</p></div><div class="posting"><i>nothing</i></div><p>after</p>'
    tree = pages.nodes(spark.createDataFrame([(1, html)], "page_id long, html string"), within=False)
    got = threads.comments(tree, threads.DIALECTS["heise"], spark.createDataFrame([(1, "http://h/")], "page_id long, base string"), 5).collect()
    assert sorted((r.position, r.author, r.body) for r in got) == [(1, "me", "<div>said</div>"), (2, "Unknown", "<p>only</p>")] and len(calls) == 1

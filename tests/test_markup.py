"""Plain pages are read by one expression; what it says is held against the standard parser."""

import random

import pytest

from sedgeline.functions import markup
from sedgeline.operators import pages
from sedgeline.plans.built import PAGE, PARTS

PIECES = (
    '<p> </p> <b> </b> <i\tclass="a"> </i> text a&#32;b a&amp;b &lt &copy;x & x<y <script> </script> <script>a&b</script> <script>if(a<b)</script> <script/> <style> </style> <title> </title> <textarea> </textarea> <svg> </svg> '
    '<table> <tr> <td> </td> </tr> </table> <ul> <li> </ul> <br/> <br> <img\nsrc="a&amp;b"\nalt=x> <a\thref=\'/x?a=1&b=2\'> <a\thref="/x?a=1&copy=2"> <A\tHREF="q"\thref="z"> </a> </A\t> <!--c--> <!----> <!---> <!DOCTYPE\thtml> <!doctype\tx> '
    '<input\tdisabled> </> <div\nid=x\tclass="b"\t> </div> <iframe\tsrc="x"></iframe> <p\ta="1"b="2"> <x-y\tz=\'>\'> </x-y> <b <td\tx=1/> <td\tx=/1> <?pi?> <![CDATA[x]]>'
).split(" ")
PIECES += ["", " ", "\n", "< p>", "\xa0", "<p a\xa0b>", "<p a=b\xa0c>"]


def standard(html, monkeypatch):
    with monkeypatch.context() as m:
        m.setattr(markup, "_events", lambda _: None)
        return markup.nodes_of(html)


def test_plain_pages_say_the_same_as_with_the_standard_parser(monkeypatch):
    r, plain = random.Random(7), 0
    for _ in range(8000):
        html = "".join(r.choice(PIECES) for _ in range(r.randrange(1, 9)))
        plain += markup._events(html) is not None
        assert markup.nodes_of(html) == standard(html, monkeypatch), html
    assert plain > 800


@pytest.mark.parametrize("page", [PAGE, PARTS])
def test_built_pages_need_no_standard_parser(page, monkeypatch):
    html = page.replace("{k}", "12").replace("{n}", "Customer#12")
    expected = standard(html, monkeypatch)
    monkeypatch.setattr(markup._Builder, "feed", lambda *_: pytest.fail("the standard parser was asked"))
    assert markup.nodes_of(html) == expected


def test_only_the_tags_that_are_read_are_written(spark):
    made = spark.createDataFrame([(1, '<p>a<a href="x">b</a></p>'), (2, "<p>none</p>"), (3, None)], "page_id long, html string")
    every = pages.nodes(made, stored=False).where("tag IN ('a', '#text')")
    assert sorted(map(str, pages.nodes(made, stored=False, tags=("a", "#text")).collect())) == sorted(map(str, every.collect()))


def test_generated_methods_stay_within_what_the_jvm_compiles(spark):
    spark.conf.set(pages.LIMIT, "65535")
    pages.nodes(spark.createDataFrame([(1, "<p>a</p>")], "page_id long, html string"), stored=False)
    assert int(spark.conf.get(pages.LIMIT)) <= 8000

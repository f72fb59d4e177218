import base64
import gzip
import hashlib

import pytest
from pyspark.sql import functions as F

from sedgeline.llm import archives as A
from sedgeline.llm import scratch


@pytest.mark.parametrize("version", [1, 2])
def test_arc_round_trip_by_declared_lengths(version):
    blocks = [b"", b"one\n\nhttp://x 0.0.0.0 20240101000000 text/html 9\n", "ü\r\n".encode() * 50]
    data = A.arc_file("a.arc", [(f"http://h/{i}", b) for i, b in enumerate(blocks)], version)
    records = list(A.read_arc(data))
    assert [r.block for r in records] == blocks and [r.url for r in records] == ["http://h/0", "http://h/1", "http://h/2"]
    assert {(r.ip, r.date, r.mime) for r in records} == {("0.0.0.0", A.DATE, "text/html")}
    cut = list(A.read_arc(data[:-20]))
    assert [r.damage for r in cut] == [None, None, "cut"] and cut[2].block == blocks[2][:-19]


HTTP = b"HTTP/1.1 200 OK\r\nServer:none\r\nX-Odd: caf\xe9\r\nno colon\r\n\r\n"


@pytest.mark.parametrize("version", [1, 2])
def test_foreign_archive(spark, version):
    """No private header, a header without a space, Latin-1 bytes, a dns and an ftp record, bare line feeds, damage."""
    extra = b"" if version == 1 else b"200 - - 77 f.arc "
    line = lambda url, date, mime, n: b"%s 10.0.0.1 %s %s %s%d\n" % (url, date, mime, extra, n)
    about = b"%d 0 Some Crawler\nURL IP-address ...\n\n<arcmetadata/>" % version
    dns, page, bare = b"20010203040506\nh.example. 60 IN A 10.0.0.1\n", HTTP + b"\xff\x00body", b"HTTP/1.0 404 Gone\nA: b\n\nlost"
    data = b"".join([
        line(b"filedesc://f.arc", b"20010203040506", b"text/plain", len(about)), about, b"\n",
        line(b"dns:h.example", b"20010203040506", b"text/dns", len(dns)), dns, b"\n",
        line(b"http://h/a b", b"20010203040507", b"text/html", len(page)), page, b"\n",
        b"not a header line\nnor this: 1\n",
        line(b"http://h/caf\xe9", b"200102030405", b"text/html", len(bare)), bare, b"\n\n",
        line(b"ftp://h/f", b"20010203040509", b"application/x", len(b"\xff\x00body")), b"\xff\x00body", b"\n",
        line(b"http://h/last", b"20010203040510", b"text/html", 500), HTTP + b"short",
    ])
    folder = scratch.new_path(spark, "foreign")
    scratch.put(f"{folder}/f.arc.gz", gzip.compress(data[:700]) + gzip.compress(data[700:]))  # members may end anywhere
    scratch.put(f"{folder}/g.arc.gz", gzip.compress(b"http://h/x 1.1.1.1 20010203040506 text/html 4\nbody\n"))  # no version block
    scratch.put(f"{folder}/empty.arc.gz", gzip.compress(b""))
    warcs = A.convert_arcs(spark.createDataFrame([("f.arc.gz",), ("g.arc.gz",), ("empty.arc.gz",)], "name string"), folder)
    got = {r.url: r for r in A.read_warcs(warcs, folder).collect()}
    assert {u: (r.record_type, None if r.payload is None else bytes(r.payload)) for u, r in got.items() if not u.startswith("urn:damaged")} == {
        "dns:h.example": ("resource", dns), "http://h/a b": ("response", b"\xff\x00body"), "http://h/café": ("response", b"lost"),
        "ftp://h/f": ("revisit", None), "http://h/last": ("response", b"short"), "http://h/x": ("resource", b"body"),
    }
    assert got["ftp://h/f"].refers_to == got["http://h/a b"].record_id
    (lost,) = [r for u, r in got.items() if u.startswith("urn:damaged")]
    assert lost.record_type == "metadata" and bytes(lost.payload).strip() == b"not a header line\nnor this: 1"
    heads = {f["WARC-Target-URI"]: f for f, _ in A.read_warc(scratch.get(f"{folder}/f.warc.gz")) if "WARC-Target-URI" in f}
    assert heads["http://h/café"]["WARC-Date"] == "2001-02-03T04:05:00Z" and heads["http://h/last"]["WARC-Truncated"] == "unspecified"
    assert heads["dns:h.example"]["Content-Type"] == "text/dns"


def test_warc_record_is_well_formed():
    raw = b"".join(A.warc_of_arc("a.arc.gz", iter([A.ArcRecord("http://h", "1.2.3.4", "20010203040506", "text/html", 77, A.http_block(b"body"))]), {}))
    (info, _), (f, block) = A.read_warc(raw)
    assert info["WARC-Type"] == "warcinfo" and f["WARC-Date"] == "2001-02-03T04:05:06Z" and f["WARC-Record-ID"] == A.record_id("a.arc.gz", 77)
    assert f["WARC-Block-Digest"] == "sha1:" + base64.b32encode(hashlib.sha1(block).digest()).decode() and block.endswith(b"\r\n\r\nbody")


def test_each_pass_has_a_task_for_each_file(spark):
    names = spark.createDataFrame([(f"pages-{i:06d}-000000.arc.gz",) for i in range(50)], "name string").coalesce(1)
    dealt = scratch.spread(names, "name", scratch.file_count(names))
    sizes = [r["n"] for r in dealt.groupBy(F.spark_partition_id()).agg(F.count(F.lit(1)).alias("n")).collect()]
    assert dealt.rdd.getNumPartitions() == 50 and max(sizes) <= 2


def test_pages_and_their_copies(spark):
    rows = [(7, "http://a b\n", "x"), (3, None, "x"), (9, "u", None), (8, "u", ""), (1, "u", "unique"), (None, "u", "x"), (5, "u", "y" * 3_000_000), (6, "u", "a\r\n\r\nb\0")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "'z' AS digest", "1 AS name").repartition(3)
    out = A.archive_pages(df, scratch.new_path(spark, "t"))
    got = {r.page_id: (r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in out.collect()}
    low = {}
    for i, _, h in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0)):
        low.setdefault(h or "", i)
    assert got == {
        i: (len((h or "").encode()), base64.b32encode(hashlib.sha1((h or "").encode()).digest()).decode(), "response" if low[h or ""] == i else "revisit", None if low[h or ""] == i else low[h or ""])
        for i, _, h in rows
    }
    assert {bytes(r.payload) for r in out.where("payload is not null").collect()} == {(h or "").encode() for _, _, h in rows}
    small = A.archive_pages(df, scratch.new_path(spark, "t"), least_bytes=2)
    assert small.where("record_type = 'revisit'").count() == 0


def test_repeated_rows_and_empty_table(spark):
    df = spark.createDataFrame([(1, "u", "x"), (1, "u", "x")], "page_id long, url string, html string")
    assert sorted(r.record_type for r in A.archive_pages(df, scratch.new_path(spark, "t")).collect()) == ["response", "revisit"]
    assert A.archive_pages(df.limit(0), scratch.new_path(spark, "t")).count() == 0


def test_archives_that_are_not_packed(spark):
    folder = scratch.new_path(spark, "plain")
    scratch.put(f"{folder}/p.arc", b"http://h/x 1.1.1.1 20010203040506 text/html 4\nbody\n")
    scratch.put(f"{folder}/none.arc", b"")
    warcs = A.convert_arcs(spark.createDataFrame([("p.arc",), ("none.arc",)], "name string"), folder)
    assert sorted(r.name for r in warcs.collect()) == ["none.warc.gz", "p.warc.gz"]
    assert [(r.url, bytes(r.payload)) for r in A.read_warcs(warcs, folder).collect()] == [("http://h/x", b"body")]

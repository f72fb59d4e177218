import hashlib
import random
import re

from sedgeline.llm import pii

BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(d):
    s = 0
    for i, c in enumerate(reversed(d)):
        x = int(c) * (1 + i % 2)
        s += x - 9 * (x > 9)
    return s % 10 == 0


def brute(text):
    out = []
    for k, p in BASE.items():
        for m in re.finditer(p, text or ""):
            v, d = m[0], re.sub("[^0-9]", "", m[0])
            ok = {"email": True, "ip": k == "ip" and all(int(x) <= 255 for x in v.split(".")), "card": 12 <= len(d) <= 19 and luhn(d), "phone": 9 <= len(d) <= 15}[k]
            if ok:
                out.append((m.start(), list(BASE).index(k), m.end(), k))
    return sorted(out)


def line(spans):
    return ",".join(f"{k}:{a}:{b}" for a, _, b, k in spans)


def report(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS kind", "'x' AS value", "3 AS rid")
    return pii.span_report(df.repartition(3)).collect()


def test_seeds_match_brute_force(spark):
    rng = random.Random(4)
    parts = ["a.b@c-d.ef", "@", ".", "x_y%z", "1.2.3.4", "255.255.255.255.9.9.9.9", "256.1.1.1", "00255.1.1.01", "4111 1111 1111 1111", "4111-1111-1111-1112", "79927398713", "5500005555555559",
             "+1 (743) 555-3824", "+12", "+1234567890123456", " ", "  ", "-", "\n", "é", "\U0001f600", "", "_", "a@b.c.d@e.f", "..", "12", "0", "+", "(", "x" * 30, "of.55@mail9.example.com"]
    rows = [(i, "".join(rng.choice(parts) for _ in range(rng.randint(0, 12)))) for i in range(1500)]
    rows += [(2000, None), (2001, ""), (2002, "1 " * 30_000), (2003, "a" * 20_000), (2004, "9" * 8_000), (2005, "a@b.co " * 5000), (2006, "1." * 8_000), (2007, "+" + "1(" * 20_000)]
    got = {r.doc_id: r for r in report(spark, rows)}
    assert len(got) == len(rows)
    for i, t in rows:
        want = brute(t)
        r = got[i]
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(sum(s[3] == k for s in want) for k in BASE), (i, t[:200] if t else t, r)
        assert r.base_sha256 == hashlib.sha256(line(want).encode()).hexdigest(), (i, t[:200] if t else t, r.spans, line(want))
        assert not r.n_learned or set(line(want).split(",")) <= set(r.spans.split(","))


def test_contexts_discover_unseen_identifiers(spark):
    rows = [(i, f"some words here then reach me at user{i}@mail{i}.example.com for the rest of it") for i in range(60)]
    rows += [(100 + i, f"number {i}{i}{i}{i}{i}{i}7 is only a number") for i in range(1, 9)]
    rows += [(200, "well then reach me at user.99@localhost for the rest"), (201, "nothing at all"), (202, "reach me at 123456789 for the rest")]
    got = {r.doc_id: r for r in report(spark, rows)}
    assert (got[200].spans, got[200].n_learned, got[200].n_email) == ("email:22:39", 1, 0)
    assert all(got[i].spans == "" for i in (201, 202, 101, 105)) and all(got[i].n_learned == 0 for i in range(60))


def test_null_ids_repeated_rows_and_empty_table(spark):
    assert [r.spans for r in report(spark, [(None, "a@b.cd"), (1, "a@b.cd"), (1, "a@b.cd")])] == ["email:0:6"] * 3
    assert report(spark, []) == []


def test_texts_with_very_many_matches_are_linear(spark):
    """Texts too long for the plain patterns, whose spans are known."""
    rows = [(1, "a@b.co " * 40_000), (2, "a" * 2_000_000), (3, "1." * 500_000), (4, "1.2.3.4 " * 40_000)]
    got = {r.doc_id: r for r in report(spark, rows)}
    assert (got[1].n_email, got[2].spans, got[3].n_ip, got[4].n_ip) == (40_000, "", 125_000, 40_000)


def test_one_very_long_match(spark):
    """Java enters a repeated group anew for each turn unless it is possessive; a text as long as these would end the executor."""
    host = "b." * 500_000 + "cd"
    rows = [(1, f"mail a@{host} now"), (2, "at x" + ".b" * 500_000), (3, "name at host" + " dot b" * 200_000), (4, "1 " * 500_000), (5, "4" + "-4" * 500_000), (6, "+1" + " 2" * 500_000), (7, "x@" * 500_000 + "y.z"), (8, "1." * 500_000 + "1")]
    got = {r.doc_id: r for r in report(spark, rows)}
    assert got[1].spans == f"email:5:{7 + len(host)}" and got[7].spans == "email:999998:1000003"
    assert [got[i].n_email for i in (2, 3)] == [0, 0] and [got[i].n_card for i in (4, 5)] == [0, 0] and got[6].n_phone == 0 and got[8].n_ip == 125_000

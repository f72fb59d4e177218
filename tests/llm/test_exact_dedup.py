import hashlib
from collections import defaultdict

from sedgeline.llm.exact_dedup import drop_exact_copies, exact_groups


def low(t):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")


def test_groups_match_brute_force(spark):
    texts = ["Hot text"] * 300 + ["x", "X", "É", "é", "", None, "y" * 100_000] + [f"t{i % 50}" for i in range(90)]
    df = spark.createDataFrame([(i, t, "a", 1) for i, t in enumerate(texts)], "doc_id long, text string, text_sha256 string, n int")
    groups = defaultdict(list)
    for i, t in enumerate(texts):
        groups[low(t)].append(i)
    want = {i: (max(g), len(g), i == max(g), hashlib.sha256(k.encode()).hexdigest()) for k, g in groups.items() for i in g}
    got = {r.doc_id: (r.keep_id, r.group_size, r.kept, r.text_sha256) for r in exact_groups(df).collect()}
    assert got == want
    kept = drop_exact_copies(df)
    assert kept.columns == df.columns and {r.doc_id for r in kept.collect()} == {i for i, w in want.items() if w[2]}


def test_null_ids_twins_and_empty_table(spark):
    df = spark.createDataFrame([(None, "a"), (1, "a"), (1, "a"), (None, "b"), (None, "b")], "doc_id long, text string")
    rows = exact_groups(df).collect()
    assert len(rows) == 5 and sum(r.kept for r in rows) == 2
    assert sorted((r.doc_id or 0, r.text) for r in drop_exact_copies(df).collect()) == [(0, "b"), (1, "a")]
    assert exact_groups(df.limit(0)).count() == 0
    assert drop_exact_copies(df.limit(0)).count() == 0


def test_same_ids_of_different_texts_and_clashing_columns(spark):
    rows = [(1, "a", "x"), (1, "b", "y"), (1, "A", "z"), (None, "b", "w"), (None, "c", "v"), (2, "c", "u")] + [(5, "Hot", str(i)) for i in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, text string, kept string").selectExpr("*", "1 AS n", "2 AS rid", "3 AS w", "4 AS heavy", "5 AS text_sha256")
    for most in (1, 512):  # every split of the digests gives the same rows
        got = drop_exact_copies(df.repartition(4), max_heavy=most)
        assert got.columns == df.columns
        assert sorted((r.doc_id, r.text, r.kept) for r in got.collect()) == [(1, "A", "z"), (1, "b", "y"), (2, "c", "u"), (5, "Hot", "0")]


def test_columns_without_an_order(spark):
    df = spark.createDataFrame([(1, "a", {"k": 2}), (1, "A", {"k": 1}), (2, "b", None), (2, "b", {"x": 0}), (3, "a", {"z": 9})], "doc_id long, text string, m map<string,int>")
    got = drop_exact_copies(df)
    assert got.columns == df.columns and sorted((r.doc_id, r.text, r.m) for r in got.collect()) == [(2, "b", {"x": 0}), (3, "a", {"z": 9})] or got.where("doc_id = 2 and m is null").count() == 1
    assert got.count() == 2

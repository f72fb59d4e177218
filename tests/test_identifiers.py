"""Identifiers found by their rarest pieces are those found by all pieces."""

import random

from sedgeline.operators import search


def pieces(s):
    return {"^" + s[:2]} | {s[i : i + 3] for i in range(len(s) - 2)}


def best(q, names, most):
    p = pieces(q)
    found = [(not n.startswith(q), -len(p & pieces(n)), len(n), v, n) for v, n in names.items() if 2 * len(p & pieces(n)) >= len(p)] if len(q) > 1 else []
    return [(i + 1, v, n) for i, (_, _, _, v, n) in enumerate(sorted(found)[:most])]


def test_same_as_all_pieces_and_equal_queries_answered_alike(spark):
    rng = random.Random(5)
    names = {v: "".join(rng.choice("ab ") for _ in range(rng.randint(1, 9))).strip() + f"x{v % 7}" for v in range(150)}
    names = {min(v for v, m in names.items() if m == n): n for n in set(names.values())}
    asked = ["".join(rng.choice("abx") for _ in range(rng.randint(0, 6))) for _ in range(60)] + ["aba", "aba", "zzz", "a"]
    got = search.identifier_search(spark.createDataFrame(list(enumerate(asked)), "query_id long, q string"), search.identifier_index(spark.createDataFrame(list(names.items()), "value long, label string")), 5).collect()
    want = {(i, *x) for i, q in enumerate(asked) for x in best(q, names, 5)}
    assert {tuple(r) for r in got} == want and len(got) == len(want) > 50


def test_a_piece_in_every_name_is_not_joined(spark):
    rng = random.Random(6)
    words = ["".join(rng.choice("abcdefghijklmnop") for _ in range(12)) + " company" for _ in range(400)]
    names = spark.createDataFrame(list(enumerate(words)), "value long, label string")
    found = search.identifier_search(names.toDF("query_id", "q"), search.identifier_index(names), 1)
    assert found.where("query_id = value").count() == 400
    assert max(_joined(found)) < 50_000  # by all pieces 400 * 400 * 7 rows meet


def _joined(df):
    df.collect()
    plan, out = df._jdf.queryExecution().executedPlan(), []
    waiting = [plan]
    while waiting:
        p = waiting.pop()
        name = p.nodeName()
        if name == "AdaptiveSparkPlan":
            waiting.append(p.executedPlan())
            continue
        if name.endswith("QueryStage"):
            waiting.append(p.plan())
            continue
        if "Join" in name and p.metrics().contains("numOutputRows"):
            out.append(p.metrics().apply("numOutputRows").value())
        kids = p.children()
        waiting += [kids.apply(i) for i in range(kids.size())]
    return out

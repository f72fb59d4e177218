import hashlib
import math
import random
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from sedgeline.llm.vector_codes import Codebooks, ball_tree, coded_vectors, nearest
from sedgeline.llm.vectors import exact, with_totals

SCHEMA = "vec_id long, embedding array<double>, label int, v string, code int, `range` int"


def usable(v):
    return v is not None and v and all(x is not None and math.isfinite(x) for x in v)


def brute(rows, parts=8, entries=16, rounds=6):
    kept = [(i, [max(-(2**63), min(2**63 - 1, math.floor(Fraction(x) * 4096))) for x in v], label) for i, v, label in rows if usable(v)]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    w = len(kept[0][1]) // parts if kept else 0
    cut = lambda v, p: v[p * w : p * w + w]
    books = [[cut(v, p) for _, v, _ in kept[:entries]] for p in range(parts)]

    def assign(v, p):
        d = [sum((a - b) ** 2 for a, b in zip(cut(v, p), e, strict=True)) for e in books[p]]
        return min((x, k) for k, x in enumerate(d))

    for _ in range(rounds):
        at = [[assign(v, p)[1] for p in range(parts)] for _, v, _ in kept]
        for p in range(parts):
            for k in range(len(books[p])):
                own = [cut(v, p) for (_, v, _), a in zip(kept, at, strict=True) if a[p] == k]
                if own:
                    books[p][k] = [sum(c) // len(own) for c in zip(*own, strict=True)]
    found = [[assign(v, p) for p in range(parts)] for _, v, _ in kept]
    sha = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    most = 2**63 - 1
    errors = [min(most, sum(d for d, _ in f)) for f in found]
    by = {}
    for (_, _, label), e in zip(kept, errors, strict=True):
        by[label] = by.get(label, 0) + e
    return sorted((str(i), "".join(f"{k:02x}" for _, k in f), e, min(most, by[label]), sha) for (i, _, label), f, e in zip(kept, found, errors, strict=True))


def run(spark, rows):
    df = spark.createDataFrame([(i, v, label, "x", 3, 4) for i, v, label in rows], SCHEMA)
    return sorted((str(r.vec_id), r.code, r.error, r.label_error, r.codebooks_sha256) for r in coded_vectors(df).collect())


def test_codes_match_brute_force(spark):
    rng = random.Random(1)
    rows = [(i, [rng.gauss(rng.choice((-1, 0, 1)), 0.2) for _ in range(16)], rng.choice((None, 1, 2, 3))) for i in rng.sample(range(1000), 90)]
    rows += [(2000, None, 1), (2001, [math.nan] + [0.0] * 15, 1), (2002, [math.inf] * 16, 1), (2003, [None] + [1.0] * 15, None), (2004, [], 1)]
    rows += [(2005, rows[0][1], 1), (2005, rows[0][1], 1), (None, [0.25] * 16, None), (None, [-0.25] * 16, None)]
    assert run(spark, rows) == brute(rows)


def test_ties_and_copies_and_few_vectors(spark):
    grid = [(i, [float(x) for x in ((i // 3) % 2, i % 3, 1, -1, 0, 0, 2, i % 2)] * 2, 1) for i in range(40)]
    assert run(spark, grid) == brute(grid)
    same = [(i, [0.5] * 8, i % 2) for i in range(30)]
    assert run(spark, same) == brute(same)
    few = grid[:3]
    assert run(spark, few) == brute(few)
    assert run(spark, []) == []


def test_components_of_any_size(spark):
    rng = random.Random(5)
    rows = [(i, [rng.choice((1e300, -1e300, 1e9, -3e12, 0.0, 2.5)) for _ in range(8)], 1) for i in range(25)]
    assert run(spark, rows) == brute(rows)


def test_other_lengths_are_left_out(spark):
    rows = [(i, [float(i)] * 8, 1) for i in range(5)]
    odd = [(100, [1.0] * 7, 1), (101, [1.0] * 16, 1), (102, [1.0], 1)]
    assert run(spark, rows + odd) == brute(rows)


@pytest.mark.parametrize("spread", [3, 1000, 2**40])
def test_search_by_balls_is_exact(spread):
    rng = np.random.default_rng(spread % 97)
    entries = exact(rng.integers(-spread, spread + 1, (40, 5)))
    values = exact(rng.integers(-spread, spread + 1, (300, 5)))
    at, d = nearest(ball_tree(entries), entries, values)
    every = [[sum((int(a) - int(b)) ** 2 for a, b in zip(v, e, strict=True)) for e in entries] for v in values]
    assert [(int(x), int(y)) for x, y in zip(d, at, strict=True)] == [min((x, k) for k, x in enumerate(row)) for row in every]


def test_balls_are_skipped():
    """Far entries are not measured."""
    entries = exact(np.array([[10_000 * k, 0] for k in range(64)]))
    tree, seen = ball_tree(entries), []
    values = exact(np.array([[5, 5]]))

    class Watched(np.ndarray):
        def __getitem__(self, k):
            seen.append(k)
            return np.asarray(super().__getitem__(k))

    assert nearest(tree, entries.view(Watched), values)[0][0] == 0
    assert len(seen) < 10
    assert Codebooks([entries]).sha256() == hashlib.sha256(",".join(f"{10_000 * k},0" for k in range(64)).encode()).hexdigest()


def test_totals_of_hot_and_null_keys(spark):
    rows = spark.createDataFrame([(i, None if i % 3 == 0 else i % 3 if i % 2 else i) for i in range(3000)], "vec_id long, label long")
    totals = rows.groupBy("label").agg(F.sum("vec_id").alias("s"), F.count("*").alias("n"))
    got = {r.vec_id: (r.s, r.n) for r in with_totals(rows, totals, "label", "n").collect()}
    by = {}
    for i in range(3000):
        by.setdefault(None if i % 3 == 0 else i % 3 if i % 2 else i, []).append(i)
    assert got == {i: (sum(v), len(v)) for v in by.values() for i in v}

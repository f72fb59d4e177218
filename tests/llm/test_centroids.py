import hashlib
import math
import random
from fractions import Fraction

import numpy as np
import pytest

from sedgeline.llm.centroids import clustered_vectors, nearest
from sedgeline.llm.vectors import exact

SCHEMA = "vec_id long, embedding array<double>, label int, cluster string, v int"
MOST = 2**63 - 1


def brute(rows, dims, count=16, rounds=3):
    kept = [(i, [max(-(2**63), min(MOST, math.floor(Fraction(x) * 64))) for x in v]) for i, v in rows if v is not None and len(v) == dims and all(x is not None and math.isfinite(x) for x in v)]
    name = lambda i: "z" if i is None else hashlib.sha256(f"1:{i}".encode()).hexdigest()
    cents = [v for _, v in sorted(kept, key=lambda r: (name(r[0]), r[1]))[:count]]

    def assign(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), k) for k, c in enumerate(cents))

    for _ in range(rounds):
        at = [assign(v)[1] for _, v in kept]
        for k in range(len(cents)):
            own = [v for (_, v), a in zip(kept, at, strict=True) if a == k]
            if own:
                cents[k] = [sum(c) // len(own) for c in zip(*own, strict=True)]
    found = [assign(v) for _, v in kept]
    sha = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in cents]
    cap = lambda x: min(MOST, x)
    by = {k: sum(cap(d) for d, a in found if a == k) for _, k in found}
    return sorted((str(i), k, cap(d), cap(by[k]), cap(sum(by.values())), sha[k]) for (i, _), (d, k) in zip(kept, found, strict=True))


def run(spark, rows, dims):
    df = spark.createDataFrame([(i, v, 1, "x", 2) for i, v in rows], SCHEMA)
    return sorted((str(r.vec_id), r.cluster, r.distance, r.cluster_inertia, r.inertia, r.centroid_sha256) for r in clustered_vectors(df, dims=dims).collect())


@pytest.mark.parametrize("dims", [3, 8, 20, 64])
def test_clusters_match_brute_force(spark, dims):
    rng = random.Random(dims)
    rows = [(i, [rng.gauss(rng.choice((-2, 0, 2)), 0.3 + d / dims) for d in range(dims)]) for i in rng.sample(range(5000), 120)]
    bad = [(9000, None), (9001, [math.nan] * dims), (9002, [-math.inf] + [0.0] * (dims - 1)), (9003, [None] + [0.0] * (dims - 1)), (9004, [0.0] * (dims + 1)), (9005, [])]
    rows += [*bad, (None, [0.1] * dims), (None, [0.2] * dims), rows[0], rows[0]]
    assert run(spark, rows, dims) == brute(rows, dims)


def test_ties_few_vectors_and_none(spark):
    grid = [(i, [float((i >> b) & 1) for b in range(5)] + [0.0] * 7) for i in range(32)] * 2
    assert run(spark, grid, 12) == brute(grid, 12)
    assert run(spark, grid[:5], 12) == brute(grid[:5], 12)
    same = [(i, [1.0, 2.0]) for i in range(50)]
    assert run(spark, same, 2) == brute(same, 2)
    assert run(spark, [], 2) == []


def test_components_of_any_size(spark):
    rng = random.Random(8)
    rows = [(i, [rng.choice((1e300, -1e300, 1e15, -7e11, 0.0, 1.5)) for _ in range(10)]) for i in range(40)]
    assert run(spark, rows, 10) == brute(rows, 10)


@pytest.mark.parametrize("spread", [1, 50, 2**45])
def test_partial_distances_lose_nothing(spread):
    rng = np.random.default_rng(spread % 89)
    cents, values = exact(rng.integers(-spread, spread + 1, (16, 64))), exact(rng.integers(-spread, spread + 1, (200, 64)))
    at, d = nearest(values, cents, rng.permutation(64))
    every = [[sum((int(a) - int(b)) ** 2 for a, b in zip(v, c, strict=True)) for c in cents] for v in values]
    assert [(int(x), int(y)) for x, y in zip(d, at, strict=True)] == [min((x, k) for k, x in enumerate(row)) for row in every]

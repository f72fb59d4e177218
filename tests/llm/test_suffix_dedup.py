import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest

from sedgeline.llm import suffix_dedup as S
from sedgeline.llm.suffix_sort import suffix_array


def brute(rows, length=100):
    """Rows of (id, text) in their order."""
    seen, out = set(), {}
    for i, text in rows:
        data = (text or "").encode()
        hit = bytearray(len(data))
        for p in range(len(data) - length + 1):
            g = data[p : p + length]
            if g in seen:
                hit[p : p + length] = b"\1" * length
            seen.add(g)
        kept = bytes(b for b, h in zip(data, hit) if not h)
        spans = sum(1 for p in range(len(hit)) if hit[p] and (p == 0 or not hit[p - 1]))
        out[i] = (len(data), sum(hit), spans, hashlib.sha256(kept).hexdigest())
    return out


def test_suffix_array_matches_sorting():
    rng = np.random.default_rng(1)
    for _ in range(60):
        t = rng.integers(0, rng.integers(1, 6) + 1, rng.integers(1, 300))
        want = sorted(range(len(t)), key=lambda i: t[i:].tolist())
        assert suffix_array(t, 400).tolist() == want


def word(rng):
    return "".join(rng.choice("abcdeé") for _ in range(rng.randint(2, 8)))


def corpus(rng, n=60):
    passages = [" ".join(word(rng) for _ in range(rng.randint(15, 60))) for _ in range(6)]
    texts = []
    for _ in range(n):
        parts = [" ".join(word(rng) for _ in range(rng.randint(0, 40)))]
        for _ in range(rng.randint(0, 3)):
            p = rng.choice(passages)
            a = rng.randint(0, 30)
            parts += [p[a : len(p) - rng.randint(0, 30)], " ".join(word(rng) for _ in range(rng.randint(0, 20)))]
        texts.append(" ".join(parts))
    texts += ["", None, "a" * 350, "a" * 120, "ab" * 200, "x" + "ab" * 130, texts[0], texts[1], texts[0] + texts[1], "\0" * 220, "ü" * 99]
    return texts


def test_removes_what_brute_force_removes(spark, monkeypatch):
    rng = random.Random(7)
    rows = list(enumerate(corpus(rng)))
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("doc_id", "text", "1 AS start", "'x' AS n", "2 AS tag")
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in S.remove_repeats(df.repartition(5)).collect()}
    assert got == brute(rows)


@pytest.mark.parametrize("most", [0, 4, 20])
def test_hot_anchors_are_spread_over_suffix_arrays_without_loss(spark, monkeypatch, most):
    rng = random.Random(8)
    rows = list(enumerate(corpus(rng, 40)))
    monkeypatch.setattr(S, "HOT_SLICES", 3)
    monkeypatch.setattr(S, "HOT_SHARE", 1 << 30)
    monkeypatch.setattr(S, "GROUP_SLICES", 4)
    monkeypatch.setattr(S, "GROUP_MOST", most)
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in S.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()}
    assert got == brute(rows)


def test_long_texts_are_scanned_in_segments(monkeypatch):
    rng = random.Random(9)
    data = " ".join(word(rng) for _ in range(3000)).encode()
    whole = S.anchors(data[: S.SEGMENT])
    assert int(whole[2].sum()) == len(data) - 99
    monkeypatch.setattr(S, "SEGMENT", 1 << 10)
    batch = pa.RecordBatch.from_arrays([pa.array([1]), pa.array([0]), pa.array([data.decode()])], names=["d", "t", "x"])
    rows = [r for b in S._slices(frozenset())([batch]) for r in b.to_pylist()]
    assert sum(r["n"] for r in rows) == len(data) - 99


def test_groups_that_cross_batches():
    rng = random.Random(2)
    rows = sorted((rng.randint(0, 3), 1, a := rng.randint(0, 3), rng.randint(0, 2), d) for d in range(300))
    rows = [(k, a, c, d, 0, 0, 1, kind) for k, kind, a, c, d in rows]
    table = [pa.array([r[i] for r in rows], pa.int32() if i == 7 else pa.int64()) for i in range(8)]
    batch = pa.RecordBatch.from_arrays(table, names=S._NAMES)
    want = sorted(map(str, (r for b in S._compare([batch]) for r in b.to_pylist())))
    for size in (1, 2, 7):
        parts = [batch.slice(i, size) for i in range(0, len(rows), size)]
        assert sorted(map(str, (r for b in S._compare(parts) for r in b.to_pylist()))) == want


def test_null_ids_twins_and_empty_table(spark):
    t = " ".join(str(i) for i in range(80))
    df = spark.createDataFrame([(None, t), (5, t), (5, t), (5, "short")], "doc_id long, text string")
    got = sorted((r.doc_id or -1, r.n_removed > 0) for r in S.remove_repeats(df).collect())
    assert got == [(-1, False), (5, False), (5, True), (5, True)]
    for rows in ([(5, t), (5, t), (5, t)], [(None, t), (None, t)]):  # one document, which repeats nothing
        for parts in (1, 3):
            alone = S.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string").repartition(parts)).collect()
            assert [r.n_removed for r in alone] == [0] * len(rows)
    assert [r.n_removed for r in S.remove_repeats(spark.createDataFrame([(5, t + t), (5, t + t)], "doc_id long, text string")).collect()] == [len(t)] * 2
    assert S.remove_repeats(df.limit(0)).count() == 0

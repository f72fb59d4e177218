import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from sedgeline.llm import mixing as M


@pytest.mark.parametrize("n", [1, 2, 3, 7, 64, 1000])
def test_permutations_are_permutations(n):
    p = M.Permutation(n, 5)
    out = p.forward(np.arange(n))
    assert sorted(out.tolist()) == list(range(n)) and p.inverse(out).tolist() == list(range(n))
    assert n < 64 or out.tolist() != M.Permutation(n, 6).forward(np.arange(n)).tolist()


def test_targets_share_out_excess_by_weight():
    t = M.targets({"a": 100, "b": 100, "c": 1000, None: 10})
    assert t["a"] == 200 and t[None] == 20 and abs(sum(t.values()) - 1.5 * 1210) < 1e-9
    rest = 1.5 * 1210 - 220
    assert t["b"] == min(200, rest / 3) and M.targets({}) == {} and M.targets({"x": 0}) == {"x": 0.0}


def test_quota_takes_exactly_the_words():
    rng = random.Random(3)
    for _ in range(300):
        size, block = rng.randint(1, 400), rng.choice([1, 7, 64])
        words = rng.randint(0, 2 * size)
        q, blocks = M.quota(size, words, 2, block, 9), -(-size // block)
        taken = Counter()
        for j in range(q.slots):
            b = int(M.Permutation(blocks, M._key(2, j // blocks, 9)).forward(np.array([j % blocks]))[0])
            stop = min(block, size - b * block)
            taken.update(range(b * block, b * block + (min(stop, q.last_words) if j == q.slots - 1 else stop)))
        assert taken.total() == words and max(taken.values(), default=0) <= 2


def test_draws_add_up():
    d = M.shard_draws([100, 0, 7, 50], 8, 1)
    assert d.sum(axis=0).tolist() == [100, 0, 7, 50] and d.min() >= 0 and d.sum(axis=1).max() - d.sum(axis=1).min() <= 1


def words(t):
    return [w for w in (t or "").replace("\t", " ").split(" ") if w]


def docs(spark):
    rng = random.Random(1)
    rows = [(i, " ".join(f"w{rng.randint(0, 99)}" for _ in range(rng.choice([0, 1, 5, 300, 2000]))), "en", rng.choice(["a", "b", None, "c"]), 1) for i in range(200)]
    rows += [(900, None, None, "a", 0), (901, " \t ", "en", "z", 3), (902, "\xa0x\x1c y", "en", "a", 5)]
    return rows, spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")


def test_taken_words_reach_the_targets(spark):
    rows, df = docs(spark)
    df = df.selectExpr("*", "7 AS size", "8 AS rid", "9 AS start")
    got = {r.doc_id: r for r in M.taken_words(df.repartition(5)).collect()}
    assert len(got) == len(rows)
    sizes = Counter()
    for i, t, _, s, _ in rows:
        assert got[i]["size"] == len(words(t))
        sizes[s] += len(words(t))
    want = M.targets(dict(sizes))
    for s in sizes:
        mine = [got[r[0]] for r in rows if r[3] == s]
        assert all(r.source_size == sizes[s] and r.target == want[s] and r.taken <= 2 * r["size"] for r in mine)
        assert abs(sum(r.taken for r in mine) - want[s]) <= 1
    assert {i: r.taken for i, r in got.items()} == {r.doc_id: r.taken for r in M.taken_words(df.repartition(2)).collect()}


def test_mixed_documents_are_those_words(spark):
    rows, df = docs(spark)
    taken = {r.doc_id: r.taken for r in M.taken_words(df).collect()}
    out = M.mixed_documents(df)
    assert out.columns == df.columns
    got, texts = Counter(), {r[0]: r[1] for r in rows}
    for r in out.collect():
        got[r.doc_id] += len(words(r.text))
        assert r.text in texts[r.doc_id] and r.n_chars == len(r.text)
    assert {i: n for i, n in taken.items() if n} == dict(got)


def test_nulls_twins_and_empty_table(spark):
    df = spark.createDataFrame([(None, "a b", None), (1, "a b c", None), (1, "a b c", None)], "doc_id long, text string, source string")
    assert sum(r.taken for r in M.taken_words(df).collect()) == 12
    assert M.taken_words(df.limit(0)).count() == 0
    assert M.taken_words(df.select("doc_id", "source", "text").where("doc_id = 1").selectExpr("doc_id", "source", "'' AS text")).count() == 2


def test_mix_of_missing_and_repeated_ids_counts_every_word_once(spark):
    rng = random.Random(4)
    text = lambda n: " ".join(f"x{rng.randint(0, 9**6)}" for _ in range(n))
    rows = [(None, text(40), "a"), (None, text(700), "a"), (1, text(3), "a"), (1, text(900), "b"), (1, "same text", "b"), (1, "same text", "b"), (None, None, "b"), (2, "", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").selectExpr("*", "1 AS slot", "2 AS rid", "'s' AS shard", "3 AS mix_slot", "4 AS n_chars")
    for twice in (df, df.limit(0)):
        out = M.mixed_documents(twice)
        assert out.columns == df.columns
        got, want = Counter(), Counter()
        for r in out.collect():
            got[r.source] += len(words(r.text))
        for _, t, s in rows if twice is df else []:
            want[s] += len(words(t))
        assert got == Counter({s: round(t) for s, t in M.targets(dict(want)).items() if t})
    every = Counter(w for r in M.mixed_documents(df.where("source = 'b'"), share=1.0).collect() for w in words(r.text))
    assert every == Counter(w for _, t, s in rows if s == "b" for w in words(t))


def test_placed_pieces_fill_fixed_blocks(spark):
    _, df = docs(spark)
    out = M.mixed_documents(df, placed=True, block=64, shards=5).toPandas().sort_values(["source", "mix_slot", "mix_offset"])
    assert set(out["mix_shard"]) <= set(range(5))
    for _, g in out.groupby(["mix_shard", "source", "mix_slot"], dropna=False):
        ends = g["mix_offset"].to_numpy() + np.array([len(words(t)) for t in g["text"]])
        assert g["mix_offset"].iloc[0] == 0 and (g["mix_offset"].to_numpy()[1:] == ends[:-1]).all() and ends[-1] <= 64


def test_one_id_on_most_rows_is_spread(spark):
    df = spark.range(3000).selectExpr("if(id % 2 = 0, null, 7) AS doc_id", "concat_ws(' ', repeat('w ', int(id % 50)), id) AS text", "'s' AS source")
    sized = M._sized(df, "doc_id", "text", "source", F.monotonically_increasing_id()).withColumn("source_no", F.lit(0))
    ranges = M._starts(sized, 3000).groupBy("range").count().agg(F.max("count"), F.count(F.lit(1))).first()
    assert ranges[0] < 60 and ranges[1] == M.RANGES
    assert sum(r.taken for r in M.taken_words(df).collect()) == round(1.5 * sum(r.size for r in sized.collect()))

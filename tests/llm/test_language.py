import random
import zlib

import numpy as np

from sedgeline.llm import language as L

SOUNDS = {"aa": ["ka", "mo", "ti", "ra"], "bb": ["sch", "ung", "ber", "ö"], "cc": ["eau", "tion", "é", "que"]}


def corpus(n=300):
    rng = random.Random(5)
    rows = []
    for i in range(n):
        g = rng.choice(list(SOUNDS))
        rows.append((i, " ".join("".join(rng.choice(SOUNDS[g]) for _ in range(rng.randint(1, 4))) for _ in range(rng.randint(5, 60))), g if i % 11 else None))
    return rows


def grams(t):
    t = " ".join(t.lower().split()) if t.strip() == t else t.lower()
    return {t[i : i + n] for n in range(1, L.N_MAX + 1) for i in range(len(t) - n + 1)}


def test_kernel_matches_sets():
    texts = [r[1] for r in corpus(30)]
    m = L.Model([L.distinct_grams(t) for t in texts], [["x", "y"][i % 2] for i in range(30)], landmarks=5)
    marks = texts[0:10:2] + texts[1:10:2]
    want = [[len(grams(a) & grams(b)) / np.sqrt(len(grams(a)) * len(grams(b))) for b in marks] for a in texts]
    assert np.allclose(m.kernel(texts), want, atol=1e-5)


def test_numbers_of_grams_and_of_texts_agree():
    far = "".join(chr(c) for c in range(0x10000, 0x1E000, 3)) + "".join(chr(c) for c in range(0x4E00, 0x9FFF))
    for marks in ([L.distinct_grams("ab ä")], [L.distinct_grams(far)]):
        a = L.Alphabet(marks)
        for t in ("", "Ab  \n\tx", "aä b日" * 9, far[:5000] + " a"):
            assert a.grams(t).tolist() == a.coded(L.distinct_grams(t)).tolist()
    assert len(np.unique(L.Alphabet([L.distinct_grams(far)]).grams(far))) == len(grams(far))


def test_held_out_accuracy_and_edges(spark):
    rows = corpus()
    extra = [(900, None, "aa"), (901, "12 !!", "aa"), (902, "", None), (None, rows[1][1], "bb"), (903, "日本", "aa"), (904, "ka mo " * 50_000, None)]
    df = spark.createDataFrame(rows + extra, "doc_id long, text string, lang string").selectExpr("*", "1 AS score", "'x' AS held_out")
    got = {r.doc_id: r for r in L.languages(df.repartition(3)).collect()}
    assert len(got) == len(rows) + len(extra)
    held = [(i, g) for i, _, g in rows if g and zlib.crc32(str(i).encode()) % 5 == 0]
    assert all(got[i].held_out for i, _ in held) and sum(got[i].lang_pred == g for i, g in held) / len(held) > 0.97
    assert all((got[i].lang_pred, got[i].score) == ("und", 0.0) for i in (900, 901, 902)) and got[904].lang_pred == "aa" and not got[None].held_out
    assert all(0 <= r.score <= 1 and r.lang_pred in (*SOUNDS, "und") for r in got.values())


def test_nothing_to_learn_from_and_empty_table(spark):
    df = spark.createDataFrame([(1, "abc", None), (1, "abc", None)], "doc_id long, text string, lang string")
    assert [r.lang_pred for r in L.languages(df).collect()] == ["und", "und"]
    assert L.languages(df.limit(0)).count() == 0

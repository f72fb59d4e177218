"""The pipeline's stages against brute force, on a small table of its own."""

import random
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from sedgeline.llm import mixing, quality, scratch
from tests.llm.test_exact_dedup import low
from tests.llm.test_mixing import words
from tests.llm.test_near_copies import shingles


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng, rows = random.Random(6), []
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 9)))
    base = [" ".join(word() for _ in range(rng.randint(60, 400))) + "." for _ in range(60)]
    for i in range(120):
        t = base[i % 60] if i % 7 else base[i % 60].upper().lower().capitalize()
        if i % 5 == 0:
            t = " ".join(word() if rng.random() < 0.004 else w for w in t.split(" "))
        rows.append((i, t, "en", f"s{i % 4}", len(t)))
    rows += [(200 + i, "\n".join(" | ".join(word() + "###" for _ in range(20)) for _ in range(5)), "en", "s0", 1) for i in range(10)]
    rows += [(300, None, None, None, None), (301, "short", "en", None, 5)]
    at = str(tmp_path_factory.mktemp("sf"))
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame([(i, int(i < 200), 0) for i, *_ in rows[::2]], "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    return at


def brute_classes(rows, least=0.8):
    """Smallest ids of the components of pairs of five-word similarity ``least`` or more."""
    sets, parent = {i: shingles(t) for i, t in rows}, {i: i for i, _ in rows}

    def top(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in sets:
        for j in sets:
            if i < j and len(sets[i] & sets[j]) >= least * len(sets[i] | sets[j]):
                x, y = sorted((top(i), top(j)))
                parent[y] = x
    return sorted({top(i) for i in sets})


def test_stages_match_brute_force(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    kept = []
    for name, stage in corpus_pipeline.STAGES:
        out = scratch.table(stage(spark, docs, folder), name)
        kept.append((docs.collect(), out.collect()))
        if name != "packing":
            assert out.columns == list(corpus_pipeline.COLUMNS)
        docs = out
    before, after = kept[0]
    weights = quality.learned_weights(spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet"))
    verdict = quality.judge([r.text or "" for r in before], weights)[6]
    assert sorted(r.doc_id for r in after) == sorted(r.doc_id for r, v in zip(before, verdict, strict=True) if v) == list(range(120))
    before, after = kept[1]
    last = {low(r.text): r.doc_id for r in sorted(before)}
    assert {r.doc_id for r in after} == set(last.values()) and len(after) == len(last) < len(before)
    before, after = kept[2]
    assert sorted(r.doc_id for r in after) == brute_classes([(r.doc_id, r.text) for r in before]) and len(after) < len(before)
    before, after = kept[3]
    sizes, taken = Counter(), Counter()
    for r in before:
        sizes[r.source] += len(words(r.text))
    for r in after:
        taken[r.source] += len(words(r.text))
    for s, t in mixing.targets(dict(sizes)).items():
        assert abs(taken[s] - t) <= 1
    before, after = kept[4]
    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = Counter(np.array(tok.encode(r.text, add_special_tokens=False).ids + [1], "<u4").tobytes() for r in before)
    whole = Counter(np.frombuffer(r.ids, "<u2").astype("<u4").tobytes() for r in after if r.length == r.doc_tokens)
    assert all(want[k] == n for k, n in whole.items()) and sum(r.length for r in after) == sum(len(k) // 4 * n for k, n in want.items())


def test_run_gives_the_last_stage(spark, folder):
    rows = corpus_pipeline.run(spark, folder)
    assert {"doc_id", "sequence_id", "offset", "length", "ids"} <= set(rows.columns) and rows.count() > 0


def test_empty_documents(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_missing_and_repeated_ids_lose_and_invent_nothing(spark, folder, tmp_path):
    """Ids tell nothing apart here: half are null, the others are one number; a column clashes with the stages' own."""
    docs = spark.read.parquet(f"{folder}/documents.parquet").selectExpr("if(doc_id % 2 = 0, null, 1L) AS doc_id", "text", "lang", "source", "n_chars", "doc_id AS rid", "text AS __sedgeline_own")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    docs, want = spark.read.parquet(f"{tmp_path}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES[:4]:
        before = docs.collect()
        docs = scratch.table(stage(spark, docs, folder), name)
        after = docs.collect()
        if name == "exact_dedup":
            assert sorted(low(r.text) for r in after) == sorted({low(r.text) for r in before})
        if name == "simhash":
            n = len(brute_classes(list(enumerate(sorted(r.text for r in before)))))
            assert len(after) == n and {r.text for r in after} <= {r.text for r in before}
        if name == "mixing":
            sizes, taken = Counter(), Counter()
            for r in before:
                sizes[r.source] += len(words(r.text))
            for r in after:
                taken[r.source] += len(words(r.text))
            want = {s: round(t) for s, t in mixing.targets(dict(sizes)).items()}
            assert taken == want and sum(sizes.values()) > 0
    assert corpus_pipeline.STAGES[4][1](spark, docs, folder).count() >= docs.count()

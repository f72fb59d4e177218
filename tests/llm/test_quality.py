import itertools
import random
import re

import numpy as np

from sedgeline.llm import quality as Q

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute_counts(text):
    words, lines, seen, dup = WORD.findall(text or ""), (text or "").split("\n"), set(), 0
    for line in lines:
        dup += bool(WORD.search(line)) and line in seen
        seen.add(line)
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    hit = {i + k for i, w in enumerate(windows) if windows.count(w) > 1 for k in range(3)}
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), dup, len(hit)


def path_score(scores, stay, path):
    return sum(s * x for s, x in zip(scores, path, strict=True)) + stay * sum(a == b for a, b in itertools.pairwise(path))


def sample():
    rng = random.Random(2)
    out = ["", " \t\n", "one", "a b c a b c a b c", "é ü\xa0x\x1cy z", "#|<>!!\n\n#|<>!!\nx\nx", "A" * 5000, "w " * 3000, "\n" * 50]
    for _ in range(60):
        out.append("\n".join(" ".join(rng.choice(["the", "cat", "SAT!!", "on", "###", "| x |", "mat.", "é", "9"]) for _ in range(rng.randint(0, 8))) for _ in range(rng.randint(1, 9))))
    return out


def test_counts_match_brute_force():
    texts = sample()
    got = Q.judge(texts, Q.DEFAULT)
    for i, t in enumerate(texts):
        n, chars, sym, dup, rep = brute_counts(t)
        assert tuple(int(got[k][i]) for k in range(5)) == (n, chars, sym, dup, rep), t[:80]
        assert bool(got[5][i]) == (n < 50 or 100 * rep > 50 * n)


def test_viterbi_matches_all_paths():
    rng = np.random.default_rng(4)
    texts = [t for t in sample() if t.count("\n") < 9]
    lines = Q.Lines(texts)
    for _ in range(5):
        w = rng.normal(size=len(Q.DEFAULT))
        labels, scores, at = Q.viterbi(lines, w), lines.features @ w[:-1], 0
        for n in lines.per_doc.tolist():
            best = max(path_score(scores[at : at + n], w[-1], p) for p in itertools.product((0, 1), repeat=n))
            assert abs(path_score(scores[at : at + n], w[-1], labels[at : at + n].astype(int).tolist()) - best) < 1e-9
            at += n


def test_lone_long_chains_match_shared_ones():
    rng = random.Random(8)
    line = lambda: " ".join(rng.choice(["the", "cat", "SAT!!", "###", "| x |", "9"]) for _ in range(rng.randint(0, 6)))
    long, other = ["\n".join(line() for _ in range(n)) for n in (700, 650)]
    for w in (Q.DEFAULT, np.linspace(-1, 1, len(Q.DEFAULT))):
        alone = Q.viterbi(Q.Lines([long]), w)
        assert (Q.viterbi(Q.Lines(["x", long, "y\nz"]), w)[1:701] == alone).all()
        assert (Q.viterbi(Q.Lines([long, long]), w) == np.concatenate([alone, alone])).all()
        assert (Q.viterbi(Q.Lines([other, long]), w)[650:] == alone).all()
    assert Q.judge(["\n" * 300_000 + "word " * 100], Q.DEFAULT)[0][0] == 100


def test_sample_is_the_same_whatever_the_order(spark):
    rows = [(i % 7, f"text {i}") for i in range(40)] + [(3, None), (5, "z" * (Q.SAMPLE_CHARS + 1))]
    labels = spark.createDataFrame([(i % 7, i % 2) for i in range(20)], "doc_id long, quality int")
    df = spark.createDataFrame(rows, "doc_id long, text string")
    first = Q.labelled_sample(df, labels)
    assert len(first[0]) == 7 and all(Q.labelled_sample(df.repartition(n, "text"), labels.repartition(n)) == first for n in (1, 3))


def test_fitted_field_tells_junk_from_prose():
    rng = random.Random(1)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 8)))
    good = ["\n".join(" ".join(word() for _ in range(15)) + "." for _ in range(5)) for _ in range(80)]
    bad = ["\n".join(" | ".join(word() + "###" for _ in range(15)) for _ in range(5)) for _ in range(40)]
    w = Q.fit(good[:60] + bad[:30], [1] * 60 + [0] * 30)
    assert Q.judge(good[60:], w)[6].all() and not Q.judge(bad[30:], w)[6].any()
    assert (Q.fit(good, [1] * 80) == Q.DEFAULT).all() and (Q.fit([], []) == Q.DEFAULT).all()


def test_report_and_filter(spark):
    rows = [(i, t) for i, t in enumerate(sample())] + [(500, None), (None, "x y"), (7, "again")]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS kept", "2 AS quality")
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    got = Q.quality_report(df, none).collect()
    assert len(got) == len(rows)
    by = {r.doc_id: r for r in got if r.doc_id not in (7, None)}
    for i, t in rows:
        if i not in (7, None):
            assert (by[i].n_words, by[i].word_chars, by[i].n_symbols, by[i].n_dup_lines, by[i].n_repeat_words) == brute_counts(t)
            assert by[i].kept <= (not by[i].base_failed)
    labels = spark.createDataFrame([(0, 1, 0), (None, 0, 0), (3, None, 1), (4, 7, 1)], "doc_id long, quality int, toxic int")
    kept = Q.keep_quality(df, labels)
    assert kept.columns == df.columns and kept.count() == sum(r.kept for r in got)
    assert Q.quality_report(df.limit(0), none).count() == 0

import random

import numpy as np

from sedgeline.llm import simhash
from sedgeline.llm.simhash import drop_similar_copies


def shingles(text, n=5):
    w = text.lower().split()
    return {tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))}


def test_planted_copies_from_similarity_08_to_095_go(spark):
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(6))
    base = [[word() for _ in range(200)] for _ in range(300)]
    rows, far, near = [(i, " ".join(w)) for i, w in enumerate(base)], set(), {}
    for i, w in enumerate(base):
        copy = list(w)
        for at in range(3, 3 + 6 * (1 + i % 6), 6):  # 1 to 6 edits of five shingles each
            copy[at] = word()
        x, y = shingles(" ".join(w)), shingles(" ".join(copy))
        j = len(x & y) / len(x | y)
        rows.append((1000 + i, " ".join(copy)))
        if j >= 0.8:
            near[1000 + i] = j
        else:
            far.add(1000 + i)
    assert far and min(near.values()) < 0.83 and max(near.values()) > 0.94
    df = spark.createDataFrame(rows + [(None, rows[0][1]), (None, "only here")], "doc_id long, text string")
    stays = [r.doc_id for r in drop_similar_copies(df).collect()]
    assert set(range(300)) | far <= set(stays) and stays.count(None) == 1
    assert len(near.keys() & set(stays)) <= 0.02 * len(near)
    assert drop_similar_copies(df.limit(0)).count() == 0


def test_manhattan_distance_of_unary_counts_bounds_the_bits():
    rng = random.Random(4)
    for _ in range(300):
        a, b = rng.getrandbits(64), rng.getrandbits(64)
        count = lambda x: [(x >> i & 3).bit_count() for i in range(0, 64, 2)]
        want = sum(abs(x - y) for x, y in zip(count(a), count(b), strict=True))
        codes = simhash._axes_of(np.array([a, b], np.uint64))
        assert int(np.bitwise_count(codes[0] ^ codes[1])) == want <= (a ^ b).bit_count()


def test_repeated_and_missing_ids_and_clashing_columns(spark):
    rng = random.Random(9)
    text = lambda: " ".join("".join(rng.choice("abcdefghij") for _ in range(6)) for _ in range(120))
    a, b = text(), text()
    near = a.rsplit(" ", 1)[0] + " other"
    rows = [(1, a, "x"), (1, b, "y"), (None, near, "z"), (1, near.upper(), "w"), (None, None, "n"), (None, "", "e"), (2, text(), "q")]
    df = spark.createDataFrame(rows, "doc_id long, text string, rid string").selectExpr("*", "1 AS node", "2 AS bits", "3 AS component")
    got = drop_similar_copies(df)
    assert got.columns == df.columns
    left = [(r.doc_id, r.rid) for r in got.collect()]
    assert len(left) == 4 and {(1, "y"), (2, "q")} < set(left) and sum(i is None for i, _ in left) == 1


def test_large_group_of_near_copies_is_one(spark):
    rng = random.Random(10)
    base = ["".join(rng.choice("abcdefghij") for _ in range(6)) for _ in range(200)]
    rows = []
    for i in range(1500):
        copy = list(base)
        for at in rng.sample(range(200), 2):
            copy[at] = "".join(rng.choice("abcdefghij") for _ in range(6))
        rows.append((i, " ".join(copy)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert drop_similar_copies(df).count() <= 3


def test_wide_fingerprints_tell_similarity():
    rng = random.Random(11)
    base = ["".join(rng.choice("abcdefghij") for _ in range(6)) for _ in range(400)]
    for edits in (0, 5, 20):
        copy = list(base)
        for at in range(7, 7 + 15 * edits, 15):
            copy[at] = "edit"
        a, b = (np.unpackbits(np.frombuffer(simhash.wide_fingerprint(" ".join(t), 5), np.uint8)) for t in (base, copy))
        x, y = shingles(" ".join(base)), shingles(" ".join(copy))
        want = simhash.apart(len(x & y) / len(x | y)) * simhash.WIDE
        assert len(a) == simhash.WIDE and abs(int((a != b).sum()) - want) <= 4 * want**0.5
    assert simhash.wide_fingerprint(None, 5) == bytes(simhash.WIDE // 8)


def test_no_pair_is_lost_whatever_the_window_and_the_order(spark):
    rng = random.Random(12)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(6))
    often, rows = [word() for _ in range(30)], []
    for i in range(150):
        base = [*often, *(word() for _ in range(70 + i % 50))] if i % 2 else [word() for _ in range(100)]
        for k in range(3):
            copy = list(base)
            for at in range(34, 34 + 6 * (k * (1 + i % 5) // 2), 6):
                copy[at] = word()
            rows.append((3 * i + k, " ".join(copy)))
    sets, top = {i: shingles(t) for i, t in rows}, {i: i for i, _ in rows}
    for i in sets:
        for j in range(i):
            if top[i] != top[j] and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                x, y = sorted((top[i], top[j]))
                top = {k: x if v == y else v for k, v in top.items()}
    top |= {800: 800, 803: 803}
    short = [(800, "one two three four five six seven eight nine"), (801, "two three four five six seven eight nine"), (802, "a b"), (803, "a b c")]
    top[802] = 802
    df = spark.createDataFrame([*rows, *short, (900, rows[1][1].upper())], "doc_id long, text string").repartition(7)
    for options in ({}, {"window": 0}, {"window": 1, "sampled": 2, "frequent": 2}):
        assert sorted(r.doc_id for r in drop_similar_copies(df, **options).collect()) == sorted(set(top.values())), options
    assert len(rows) // 3 < len(set(top.values())) < len(rows)


def test_pairs_of_a_large_group_are_made_once_not_by_each_shingle(spark):
    """Components that share many tokens meet about once; none that share any is left out."""
    rng, rows = random.Random(13), []
    for c in range(120):
        rows += [(t, c) for t in rng.sample(range(50), 40)] + [(1000 + c, c)]
    rows += [(5000, 200), (5000, 201), (5001, 201), (5001, 202)]
    groups = spark.createDataFrame(rows, "token long, comp long")
    made = [tuple(r) for r in simhash._met(groups).collect()]
    held = {}
    for t, c in rows:
        held.setdefault(c, set()).add(t)
    assert set(made) == {(a, b) for a in held for b in held if a < b and held[a] & held[b]}
    assert len(made) <= 1.1 * len(set(made))  # by each token it is about 32 times as many


def test_meeting_pairs_are_those_that_share_enough_of_their_first_shingles(spark):
    """Texts that are mostly the same, but not similar enough: each of their pairs that may be is given once."""
    rng = random.Random(14)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(6))
    base, rows = [word() for _ in range(150)], []
    for i in range(80):
        copy = list(base)
        for at in rng.sample(range(150), 5 + i % 3):
            copy[at] = word()
        rows.append((i, " ".join(copy)))
    texts = spark.createDataFrame(rows, "rid long, text string")
    made = [tuple(r) for r in simhash._meeting(texts, texts.selectExpr("rid", "rid % 60 AS comp"), 5, 0.8, sampled=2).collect()]
    sets = {i: shingles(t) for i, t in rows}
    similar = {(i, j) for j in sets for i in range(j) if i % 60 != j % 60 and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])}
    assert len(made) == len(set(made)) and similar <= set(made) and all(a < b and a % 60 != b % 60 for a, b in made)


def test_components_of_unlike_sizes_do_not_meet(spark):
    rng, rows, sizes = random.Random(15), [], {}
    for c in range(90):
        least = rng.randrange(10, 200)
        sizes[c] = (least, least + rng.choice((0, 0, 30)))
        rows += [(t, c, *sizes[c]) for t in rng.sample(range(40), 20)]
    held = {}
    for t, c, *_ in rows:
        held.setdefault(c, set()).add(t)
    like = lambda x, y: any(10 * min(i, j) >= 8 * max(i, j) for i in range(x[0], x[1] + 1) for j in range(y[0], y[1] + 1))
    made = {tuple(r) for r in simhash._met(spark.createDataFrame(rows, "token long, comp long, least int, most int"), 0.8).collect()}
    common = {(a, b) for a in held for b in held if a < b and held[a] & held[b]}
    assert made == {(a, b) for a, b in common if like(sizes[a], sizes[b])} != common

import random
from collections import defaultdict

import pytest
import xxhash
from pyspark.sql import Row

from sedgeline.llm.components import components
from sedgeline.llm.simhash import fingerprint, near_components, near_links


def brute_fingerprint(text):
    words, cur = [], ""
    for c in (text or "") + " ":
        c = c.lower() if "A" <= c <= "Z" else c
        if c in " \t\n\x0b\x0c\r":
            words, cur = (words + [cur] if cur else words), ""
        else:
            cur += c
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(rows):
    parent = {i: i for i, _ in rows}

    def top(i):
        while parent[i] != i:
            i = parent[i]
        return i

    prints = [(i, brute_fingerprint(t)) for i, t in rows]
    for i, a in prints:
        for j, b in prints:
            if (a ^ b).bit_count() <= 2:
                x, y = sorted((top(i), top(j)))
                parent[y] = x
    return {i: (f"{f:016x}", top(i)) for i, f in prints}


def test_fingerprint_matches_brute_force():
    for t in (None, "", " \n\t", "One", "one Two", "A b C d e A b C", "Ünï Éa \x1c b \xa0 c d", "x " * 5000):
        assert fingerprint(t) == brute_fingerprint(t)


def test_components_of_texts(spark):
    rng = random.Random(3)
    rows, base = [], [rng.choice("abcdefghijklmnop") * 3 for _ in range(400)]
    for i in range(120):
        words = list(base) if i % 3 else [str(rng.random()) for _ in range(40)]
        for _ in range(i % 4):
            words[rng.randrange(len(words))] = "edit"
        rows.append((i, " ".join(words)))
    rows += [(200, ""), (201, None), (202, "same Text"), (203, "same text")]
    got = near_components(spark.createDataFrame([Row(doc_id=i, text=t, fp=1, cell="x") for i, t in rows]))
    assert {r.doc_id: (r.fingerprint, r.component_id) for r in got.collect()} == brute_components(rows)


@pytest.mark.parametrize("cell", [1, 8, 64])
def test_cells_of_any_size_lose_no_link(spark, cell):
    rng = random.Random(5)
    centre = rng.getrandbits(63)
    prints = {centre ^ sum({1 << rng.randrange(63) for _ in range(rng.randrange(6))}) for _ in range(150)} | {rng.getrandbits(63) for _ in range(40)}
    links = near_links(spark.createDataFrame([(p,) for p in prints], "fp long"), cell)
    got = {r.node: r.component for r in components(links.toDF("u", "v")).collect()}
    parent = {p: p for p in prints}

    def top(p):
        while parent[p] != p:
            p = parent[p]
        return p

    for a in prints:
        for b in prints:
            if (a ^ b).bit_count() <= 2:
                x, y = sorted((top(a), top(b)))
                parent[y] = x
    want = defaultdict(set)
    for p in prints:
        want[top(p)].add(p)
    assert got == {p: k for k, v in want.items() if len(v) > 1 for p in v}


def test_components_of_a_chain_and_nothing(spark):
    chain = spark.createDataFrame([(i, i + 1) for i in range(300)], "u long, v long")
    assert {r.component for r in components(chain).collect()} == {0}
    assert components(chain.limit(0)).count() == 0


def test_null_ids_repeated_rows_and_empty_table(spark):
    df = spark.createDataFrame([(None, "a b c d"), (3, "a b c d"), (3, "a b c d"), (None, "only here")], "doc_id long, text string")
    got = sorted((r.doc_id or -1, r.component_id) for r in near_components(df).collect() if r.fingerprint == f"{brute_fingerprint('a b c d'):016x}")
    assert got == [(-1, 3), (3, 3), (3, 3)]
    assert near_components(df.limit(0)).count() == 0

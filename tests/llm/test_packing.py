import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from sedgeline.llm import packing as P

PATH = public_tokenizers.path("byte_bpe_50k.json")


def brute_first_fit(sizes, length):
    room, out = [], []
    for s in sizes:
        for i, r in enumerate(room):
            if r >= s:
                break
        else:
            room.append(length)
            i = len(room) - 1
        out.append((i, length - room[i]))
        room[i] -= s
    return out


def test_tree_packs_like_a_plain_scan():
    rng = random.Random(2)
    for _ in range(50):
        sizes = np.array(sorted((rng.randint(1, 100) for _ in range(rng.randint(0, 200))), reverse=True), np.int64)
        assert list(zip(*map(list, P.first_fit_decreasing(sizes, 100)), strict=True)) == brute_first_fit(sizes.tolist(), 100)


@pytest.mark.parametrize("keep", [True, False])
def test_pieces_hold_every_id_once(spark, keep):
    rng = random.Random(1)
    rows = [(i, " ".join(rng.choice(["alpha", "beta", "don't", "Ünï", "12"]) for _ in range(rng.choice([0, 3, 100, 900])))) for i in range(120)]
    rows += [(500, None), (501, ""), (502, "long " * 20_000), (None, "no id")]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS start", "2 AS `group`", "3 AS rid")
    out = P.packed_pieces(df.repartition(3), PATH, group_docs=40, keep_ids=keep).toPandas()
    tok = Tokenizer.from_file(PATH)
    filled = out.sort_values(["sequence_id", "offset"]).groupby("sequence_id")["length"]
    assert filled.sum().max() <= 2048
    for _, g in out.sort_values("offset").groupby("sequence_id"):
        assert (g["offset"].to_numpy() == np.concatenate(([0], g["length"].cumsum()[:-1]))).all()
    for i, t in rows:
        ids = np.array(tok.encode(t or "", add_special_tokens=False).ids + [1], "<u4")
        mine = out[out.doc_id.isna() if i is None else out.doc_id == i].sort_values("start")
        assert mine["start"].tolist() == list(range(0, len(ids), 2048)) and mine["length"].sum() == len(ids) and set(mine["doc_tokens"]) == {len(ids)}
        for r in mine.itertuples():
            raw = ids[r.start : r.start + r.length].tobytes()
            assert r.ids_crc32 == zlib.crc32(raw) and (not keep or np.frombuffer(r.ids, "<u2").astype("<u4").tobytes() == raw)


def test_empty_table(spark):
    assert P.packed_pieces(spark.createDataFrame([], "doc_id long, text string"), PATH).count() == 0


def test_one_id_on_half_the_rows_and_long_texts_stay_in_bounded_groups(spark):
    df = spark.range(600).selectExpr("if(id % 2 = 0, 7, if(id % 4 = 1, null, id)) AS doc_id", "repeat('word ', if(id % 50 = 3, 30000, int(id % 300))) AS text")
    out = P.packed_pieces(df.repartition(3), PATH, group_docs=50, keep_ids=False).toPandas()
    want = sum(-(-(n + 1) // 2048) for n in (30000 if i % 50 == 3 else i % 300 for i in range(600)))
    full = out[out.length == 2048]
    assert abs(len(out) - want) <= 12 and full.sequence_id.is_unique and (full.offset == 0).all()
    groups = out[out.length < 2048].sequence_id // (1 << 24)
    assert groups.nunique() == 12 and groups.value_counts().max() < 100
    assert out.groupby("sequence_id").length.sum().max() <= 2048

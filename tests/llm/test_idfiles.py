import json
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from sedgeline.llm import idfiles as I
from sedgeline.llm import scratch
from sedgeline.llm.tokens import Encoder

PATH = public_tokenizers.path("word_bpe_49k.json")
STYLES = {"spaced": public_tokenizers.path("byte_bpe_50k.json"), "bare": PATH}
ENCODERS = {s: Encoder(p, s, memo_size=50) for s, p in STYLES.items()}
PLAIN = {s: Tokenizer.from_file(p) for s, p in STYLES.items()}
for _t in PLAIN.values():
    _t.encode_special_tokens = True


@pytest.mark.parametrize("style", STYLES)
@settings(max_examples=400, deadline=None)
@given(text=st.lists(st.sampled_from(["a", "the", " ", "  ", "\n", "é", ".", "!!", "'s", "'", "12", "\t", "-", "—", "б", "́", "\xa0", "\x1c", "<|endoftext|>", "日"]), max_size=14).map("".join) | st.text(max_size=20))
def test_memo_gives_the_library_ids(style, text):
    assert ENCODERS[style].ids(text).tolist() == PLAIN[style].encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("style", STYLES)
def test_every_latin_letter(style):
    for c in map(chr, range(0x20, 0x260)):
        for text in (c, f"a{c}b {c}", f" {c}{c} x", f"{c}\n{c}1"):
            assert ENCODERS[style].ids(text).tolist() == PLAIN[style].encode(text, add_special_tokens=False).ids, text


@pytest.mark.parametrize("vocab", [1, 2, 3, 256, 257, 49408, 65536, 65537, 1 << 20])
def test_bits_round_trip(vocab):
    ids = np.random.default_rng(1).integers(0, vocab, 1001).astype("<u4")
    bits = I.bits_for(vocab)
    assert I.unpack_bits(I.pack_bits(ids, bits), len(ids), bits).tolist() == ids.tolist() and len(I.pack_bits(ids, bits)) == -(-1001 * bits // 8)


def test_random_access(tmp_path):
    docs = [np.random.default_rng(i).integers(0, 5000, n).astype("<u4") for i, n in enumerate([0, 5, 1000, 1, 333])]
    path = f"file://{tmp_path}/x/f.bits"
    scratch.put(path, I.encode_file([None, 1, 2, 3, 4], docs, I.bits_for(5000), block=64))
    f, whole = I.IdFile(path), np.concatenate(docs)
    assert f.doc_ids.tolist() == [I.NULL_ID, 1, 2, 3, 4]
    for _ in range(50):
        a, b = sorted(random.choices(range(len(whole) + 1), k=2))
        assert f.ids(a, b).tolist() == whole[a:b].tolist()


def test_files_hold_all_documents_in_order(spark):
    rng = random.Random(1)
    rows = [(i * 3 - 50, " ".join(rng.choice(["Alpha", "beta", "don't", "ünï", "12"]) for _ in range(rng.choice([0, 3, 100])))) for i in range(150)]
    rows += [(5000, None), (5001, "x " * 30_000)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS path", "2 AS part")
    files = I.write_id_files(df.repartition(4), scratch.new_path(spark, "t"), PATH, "bare", 2, file_ids=3000)
    assert files.count() > 3
    got = {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in I.read_id_files(files).collect()}
    want, at = {}, 0
    for i, t in sorted(rows):
        ids = np.array(PLAIN["bare"].encode(t or "", add_special_tokens=False).ids + [2], "<u4")
        want[i] = (at, len(ids), zlib.crc32(ids.tobytes()))
        at += len(ids)
    assert got == want


def test_null_ids_twins_and_empty_table(spark):
    df = spark.createDataFrame([(3, "a"), (3, "a"), (None, "b c")], "doc_id long, text string")
    got = sorted((r.start, r.doc_id, r.n_tokens) for r in I.read_id_files(I.write_id_files(df, scratch.new_path(spark, "t"), PATH, "bare", 2)).collect())
    assert got == [(0, None, 3), (3, 3, 2), (5, 3, 2)]
    assert I.read_id_files(I.write_id_files(df.limit(0), scratch.new_path(spark, "t"), PATH, "bare", 2)).count() == 0


def test_other_settings_are_not_cut(tmp_path):
    settings = json.load(open(STYLES["bare"]))
    assert all(ENCODERS[s].cuts for s in STYLES)
    settings["normalizer"]["normalizers"].pop()  # no lower case
    path = tmp_path / "other.json"
    path.write_text(json.dumps(settings))
    e = Encoder(str(path), "bare")
    text = "Some WORDS in Upper case, don't they"
    assert not e.cuts and e.ids(text).tolist() == e.tok.encode(text, add_special_tokens=False).ids != ENCODERS["bare"].ids(text).tolist()

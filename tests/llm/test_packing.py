import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from lexweave.llm import packing

PATH = public_tokenizers.path("word_bpe_49k.json")
ODD = ["", " ", "a", "it's <|endoftext|> x <|startoftext|>", "don't  can'T\x1cx\xa0y", "ﬁ Å ½ ²³ ab12\x85c", "İı ŸÿŊ ΟΔΟΣ ẞ", "é e\u0301", "日本語 🙂", "x" * 3000, "a\tb\nc\rd\x0be"]


def ids(texts):
    full = Tokenizer.from_file(PATH)
    return [e.ids for e in full.encode_batch(texts, add_special_tokens=False)]


def check(lengths, seq, off, capacity=4096):
    by = {}
    for n, s, o in zip(lengths, seq, off):
        by.setdefault(int(s), []).append((int(o), int(n)))
    for parts in by.values():
        at = 0
        for o, n in sorted(parts):
            assert o == at
            at += n
        assert at <= capacity
    return len(by)


@settings(max_examples=60, deadline=None)
@given(st.text(max_size=60))
def test_ids_are_the_tokenizers(text):
    assert packing.tokenizer(PATH)([text, text + " tail"]) == [np.array(x, "<u4").tobytes() for x in ids([text, text + " tail"])]


def test_ids_of_odd_texts():
    assert packing.tokenizer(PATH)(ODD) == [np.array(x, "<u4").tobytes() for x in ids(ODD)]


def test_other_tokenizers_are_used_whole():
    path = public_tokenizers.path("byte_bpe_50k.json")
    full = Tokenizer.from_file(path)
    mine = packing.WordIds(path)
    assert packing.tokenizer(PATH).by_words and not mine.by_words
    assert mine(ODD) == [np.array(full.encode(x, add_special_tokens=False).ids, "<u4").tobytes() for x in ODD]


def test_memory_of_words_is_bounded_by_bytes(monkeypatch):
    monkeypatch.setattr(packing, "REMEMBERED_BYTES", 2000)
    mine = packing.WordIds(PATH)
    texts = [f"w{i} " + f"{i}" * 200 for i in range(40)]
    assert mine(texts) == [np.array(x, "<u4").tobytes() for x in ids(texts)]
    assert mine.size <= 4000 and mine.parts_size <= 4000


def test_patterns_are_fitted_again_to_what_is_left():
    """Patterns go on until a round of them places hardly anything; short documents are left to fill sequences up."""
    lengths = np.clip(np.random.default_rng(0).lognormal(6.4, 1.1, 5000).astype(int), 1, 4096)
    fitted = []
    whole = packing.fit
    packing.fit = lambda ways, wanted: fitted.append(wanted.sum()) or whole(ways, wanted)
    try:
        check(lengths, *packing.pack(lengths))
    finally:
        packing.fit = whole
    assert len(fitted) > 2 and fitted[1] < 0.6 * fitted[0] and fitted[-1] > 0.95 * fitted[-2], fitted


@settings(max_examples=30, deadline=None)
@given(st.lists(st.integers(1, 4096), max_size=200))
def test_packs_gapless(lengths):
    lengths = np.array(lengths, np.int64)
    check(lengths, *packing.pack(lengths))


@pytest.mark.parametrize("lengths", [[1000] * 400, [4096] * 7, [2048] * 9, [3000] * 50 + [1096] * 50, [1] * 9000, [1365] * 30])
def test_even_lengths_pack_as_tightly_as_they_can(lengths):
    lengths = np.array(lengths)
    best = {1000: 100, 4096: 7, 2048: 5, 3000: 50, 1: 3, 1365: 10}[int(lengths[0])]
    assert check(lengths, *packing.pack(lengths)) == best


def test_mixed_lengths_come_within_a_hundredth_of_the_bound():
    lengths = np.clip(np.random.default_rng(0).lognormal(6.4, 1.1, 5000).astype(int), 1, 4096)
    assert check(lengths, *packing.pack(lengths)) <= 1.01 * -(-lengths.sum() // 4096) + 1


def test_fit_is_nonnegative_least_squares():
    rng = np.random.default_rng(1)
    ways = packing.patterns(12, 3)
    assert (ways.sum(1) == 12).all() and len({tuple(w) for w in ways}) == len(ways) == 19
    counts = np.stack([np.bincount(w, minlength=13)[1:] for w in ways]).astype(float)
    for _ in range(5):
        wanted = rng.integers(0, 50, 12).astype(float)
        x = packing.fit(ways, wanted)
        slope = counts @ (counts.T @ x - wanted)
        assert (x >= 0).all() and (slope > -1e-6).all() and np.abs(slope[x > 0]).max() < 1e-6


def test_documents(spark):
    texts = [(1, "a b"), (2, None), (3, ""), (4, "word " * 9000), (4, "word " * 9000), (None, "x"), (5, "end")]
    docs = spark.createDataFrame([(i, t, 9) for i, t in texts], "doc_id long, text string, piece int")
    got = packing.best_fit(docs, PATH).collect()
    assert len(got) == 5 + 2 * 3
    check([r.length for r in got], [r.sequence_id for r in got], [r.offset for r in got])
    for i, t in texts:
        mine = sorted({(r.piece, r.start, r.length, r.ids_crc32) for r in got if r.doc_id == i})
        whole = ids([t or ""])[0] + [1]
        assert mine == [(k, a, len(whole[a : a + 4096]), zlib.crc32(np.array(whole[a : a + 4096], "<u4").tobytes())) for k, a in enumerate(range(0, len(whole), 4096))]
    assert packing.best_fit(docs.limit(0), PATH).count() == 0
    shards = packing.packed(packing.settle(packing.pieces(docs, PATH), "t"), shard=3).collect()
    assert check([r.length for r in shards], [r.sequence_id for r in shards], [r.offset for r in shards]) <= 11


def test_sequences_hold_the_documents(spark):
    texts = {1: "a b c", 2: None, 3: "word " * 5000, 4: "tail end"}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    found = {}
    for r in packing.token_sequences(docs, PATH).collect():
        seq, at = np.frombuffer(bytes(r.ids), "<u4").tolist(), 0
        assert len(seq) == r.n_tokens <= 4096
        for p in r.parts:
            found[p.id, p.piece] = seq[at : at + p.length]
            at += p.length
    for i, t in texts.items():
        assert [x for k in sorted(k for k in found if k[0] == i) for x in found[k]] == ids([t or ""])[0] + [1]

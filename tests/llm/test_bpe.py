"""Speculated encodings against the tokenizers library, and compatibility against merging."""

import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from lexweave.llm import bpe

PATH = public_tokenizers.path("word_bpe_49k.json")
FULL = Tokenizer.from_file(PATH)
ENCODER = bpe.Encoder(PATH)


def library(text):
    ids = FULL.encode(text.encode("utf-8", "replace").decode(), add_special_tokens=False).ids
    return len(ids), " ".join(map(str, ids)), FULL.decode(ids, skip_special_tokens=False)


@settings(deadline=None, max_examples=300)
@given(st.lists(st.one_of(st.text(max_size=80), st.text("abcdeinorst' .,!09éß", max_size=200), st.text("ab", max_size=40)), max_size=6))
def test_any_text(texts):
    assert ENCODER(texts) == [library(x) for x in texts]


def test_hard_texts():
    texts = ["", "   ", "it's they'LL <|endoftext|> a<|startoftext|>b <|endoftext|", "İstanbul ŉ ǅ ß", "日本語 😀👩‍👩‍👧 é", "a" * 70_000, "x\x00y z", " a\u0085b", "\ud800 a", "word " * 20_000]
    assert ENCODER(texts) == [library(x) for x in texts]


def test_few_words_need_merging_when_the_vocabulary_fits():
    fresh = bpe.Encoder(PATH)
    fresh(["the people of this world would think about their children and the government every year while many schools were closed"])
    assert fresh.speculated > 15 and fresh.exact <= 3


@pytest.mark.parametrize("seed", range(4))
def test_compatible_pairs_are_those_that_merging_leaves(seed):
    rng = random.Random(seed)
    vocabulary, merges = {c: i for i, c in enumerate("abc")}, []
    while len(merges) < 25:
        a, b = (rng.choice(list(vocabulary)) for _ in range(2))
        if a + b not in vocabulary:
            vocabulary[a + b] = len(vocabulary)
            merges.append((a, b))
    rules = bpe.Merges(vocabulary, merges, "")
    assert rules.proper
    spelled = {vocabulary[c]: (vocabulary[c],) for c in "abc"} | rules.spelled
    for t in set(vocabulary.values()):
        symbols = [vocabulary[c] for c in next(k for k, v in vocabulary.items() if v == t)]
        assert (t in spelled) == (rules.merged(symbols) == [t])
    a, b = (np.array([x for x in spelled for _ in spelled]), np.array(list(spelled) * len(spelled)))
    want = [rules.merged([*spelled[x], *spelled[y]]) == [x, y] for x, y in zip(a.tolist(), b.tolist())]
    assert rules.compatible(a, b).tolist() == want
    texts = [[rng.randrange(3) for _ in range(rng.randint(1, 30))] for _ in range(200)]
    word, token = rules.merged_together(np.array(sum(texts, [])), np.array([len(t) for t in texts]))
    assert [token[word == i].tolist() for i in range(len(texts))] == [rules.merged(t) for t in texts]


def test_memory_is_bounded(monkeypatch):
    monkeypatch.setattr(bpe, "REMEMBERED", 50)
    fresh = bpe.Encoder(PATH)
    texts = [f"word{i} other{i}" for i in range(300)]
    got = [g for i in range(0, 300, 10) for g in fresh(texts[i : i + 10])]
    assert got == [library(x) for x in texts] and len(fresh.ids) < 120


def test_rows(spark):
    rows = [(1, "Hello there", "a"), (1, "Hello there", "b"), (None, None, None), (2, "", "c"), (3, "x" * 30_000, "d")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    got = bpe.encoded(docs, PATH).collect()
    assert len(got) == 5 and all(r.ids == FULL.encode(r.text or "", add_special_tokens=False).ids for r in got)
    back = bpe.decoded(bpe.encoded(docs, PATH).drop("decoded"), PATH).collect()
    assert [r.decoded for r in back] == [r.decoded for r in got]
    assert bpe.encoding_digests(docs.limit(0), PATH).count() == 0


def test_query(spark, data):
    got = {r.doc_id: r for r in bpe.op12_bpe_encoding(spark, data).collect()}
    for r in spark.read.parquet(f"{data}/documents.parquet").collect():
        n, ids, text = library(r.text or "")
        g = got[r.doc_id]
        assert (g.n_tokens, g.ids_sha256, g.decoded_sha256) == (n, hashlib.sha256(ids.encode()).hexdigest(), hashlib.sha256(text.encode()).hexdigest())


def test_files_it_cannot_speculate_on(spark):
    path = public_tokenizers.path("byte_bpe_50k.json")
    other, full = bpe.Encoder(path), Tokenizer.from_file(path)
    assert not other.speculates
    ids = full.encode("Hello  world", add_special_tokens=False).ids
    assert other(["Hello  world"]) == [(len(ids), " ".join(map(str, ids)), "Hello  world")]

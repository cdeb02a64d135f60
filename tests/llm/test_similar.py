"""Near-duplicate texts by five-word shingles against brute force."""

import random

import numpy as np
import pyarrow as pa
import pytest

from lexweave.llm import similar
from lexweave.llm.common import split_words


def shingles(text):
    words = split_words(text or "")
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else {()}


def survivors(rows):
    """Smallest id of each component of rows (id, text), by comparing all pairs."""
    sets = {i: shingles(t) for i, t in rows}
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(sets)
    for k, i in enumerate(ids):
        for j in ids[:k]:
            shared = len(sets[i] & sets[j])
            if shared and shared / len(sets[i] | sets[j]) >= 0.8:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return {find(i) for i in ids}


def edited(rng, words, edits):
    words = list(words)
    for _ in range(edits):
        at = rng.randrange(len(words))
        if rng.random() < 0.5:
            words[at] = f"new{rng.randrange(10**6)}"
        else:
            words.insert(at, f"put{rng.randrange(10**6)}")
    return words


def graded(seed=3, bases=60, copies=4):
    rng, rows = random.Random(seed), []
    for _ in range(bases):
        base = [f"w{int(rng.paretovariate(0.8)) % 3000}" for _ in range(rng.randrange(60, 400))]
        rows += [(len(rows), " ".join(base))]
        for _ in range(copies):
            rows.append((len(rows), " ".join(edited(rng, base, rng.randrange(1, max(2, len(base) // 30))))))
    rng.shuffle(rows)
    return rows


def kept(spark, rows):
    got = similar.keep_one(spark.createDataFrame(rows, "doc_id long, text string"))
    return {r.doc_id for r in got.collect()}


def test_copies_with_graded_edits_go(spark):
    rows = graded()
    want, got = survivors(rows), kept(spark, rows)
    assert want <= got  # nothing is linked below the similarity
    assert len(got - want) <= 0.03 * (len(rows) - len(want))


def test_hot_values_are_dealt_further(spark, monkeypatch):
    monkeypatch.setattr(similar, "HOT_ENTRIES", 8)
    rng = random.Random(5)
    base = [f"w{rng.randrange(400)}" for _ in range(300)]
    rows = [(i, " ".join(edited(rng, base, rng.randrange(0, 6)))) for i in range(150)] + [(1000 + i, " ".join(f"x{rng.randrange(400)}" for _ in range(80))) for i in range(50)]
    want, got = survivors(rows), kept(spark, rows)
    assert want <= got and len(got - want) <= 5


def test_one_value_in_many_runs(monkeypatch):
    monkeypatch.setattr(similar, "ENTRIES_AT_ONCE", 64)
    monkeypatch.setattr(similar, "RUN", 256)
    base = np.random.default_rng(1).integers(0, 1 << 62, 2)
    words = np.stack([base ^ (np.int64(1) << np.int64(i % 48)) * (np.arange(2) == i // 48 % 2) for i in range(2000)])
    words = words[np.argsort(words[:, 0])]
    cols = [pa.array(np.zeros(2000, np.int64)), pa.array(np.arange(2000)), pa.array(words[:, 0].copy()), pa.array(words[:, 1].copy())]
    whole = pa.RecordBatch.from_arrays(cols, names=["key", "node", "s0", "s1"])
    root = np.arange(2000)
    edges = 0
    for out in similar._forests(whole.slice(at, 50) for at in range(0, 2000, 50)):
        a, b = (out.column(c).to_numpy() for c in "ab")
        edges += len(a)
        for x, y in zip(a, b):
            root[root == root[x]] = root[y]
    assert len(set(root)) == 1 and edges <= 2 * 2000


def test_deals_grow_slowly_with_the_texts():
    sizes = [len(similar.deals(n)) for n in (0, 1, 1000, 10**6, 10**9)]
    assert sizes == sorted(sizes) and sizes[0] > 0 and sizes[-1] < 400
    assert all(len(set(at)) == len(at) for at in similar.deals(10**6))


@pytest.mark.parametrize("text", ["", " \t", "one", "one two three four", "a " * 200_000])
def test_odd_texts_are_similar_to_their_equals_alone(spark, text):
    other = "some other words that are never the same as these ones"
    docs = spark.createDataFrame([(1, text, 1, 1), (2, text, 2, 2), (3, other, 3, 3), (3, other, 3, 3), (None, other, 4, 4)], "doc_id long, text string, node int, s0 int")
    assert sorted(r.doc_id for r in similar.keep_one(docs).collect()) == [1, 3]
    assert similar.keep_one(docs.limit(0)).columns == docs.columns and similar.keep_one(docs.limit(0)).count() == 0


@pytest.mark.parametrize("found, holders", [(0.97, 2048), (0.05, 2048), (0.05, 8)])
def test_no_similar_pair_stays_apart(spark, monkeypatch, found, holders):
    """Pairs that the index doesn't meet are found by the rest, with common lines, groups of near copies and shingles held by many."""
    monkeypatch.setattr(similar, "FOUND", found)
    monkeypatch.setattr(similar, "HOLDERS", holders, raising=False)
    monkeypatch.setattr(similar, "ENTRIES_AT_ONCE", 256)
    rng, rows = random.Random(11), graded(seed=8)
    line = " ".join(f"licence{i}" for i in range(30))
    rows = [(i, f"{line} {t}" if i % 2 else t) for i, t in rows]
    base = [f"w{rng.randrange(400)}" for _ in range(200)]
    rows += [(1000 + i, " ".join(edited(rng, base, rng.randrange(0, 9)))) for i in range(80)]
    rows += [(2000 + i, f"{line} {line[: 80 + 10 * i]}") for i in range(12)]
    # Sets of 9 and 10 shingles with 8 in common, and ones at 0.8 exactly and just below.
    rows += [(3000, "a b c d e f g h i j k l"), (3001, "a b c d e f g h i j k l m"), (3002, "p q r s t u v w"), (3003, "p q r s t u v w x"), (3004, "m n o p"), (3005, "m n o p q")]
    assert kept(spark, rows) == survivors(rows)


def test_any_order_of_shingles_gives_the_same(spark, monkeypatch):
    monkeypatch.setattr(similar, "FOUND", 0.05)
    rows = graded(seed=21, bases=25)
    want = survivors(rows)
    for most in (0, 50):
        monkeypatch.setattr(similar, "COMMON", most, raising=False)
        assert kept(spark, rows) == want


def test_half_similar_texts_are_hardly_compared(spark, monkeypatch):
    """A group of texts similar by some 0.6 to 0.79 to each other: few pairs are compared by their sets, and the rows kept are right."""
    compared = []

    def settled(df, name, settle=similar.settle):
        out = settle(df, name)
        if name == "similar-rest":
            compared.append(out.count())
        return out

    monkeypatch.setattr(similar, "settle", settled)
    rng = random.Random(17)
    base = [f"w{i}" for i in range(300)]
    rows = [(i, " ".join(edited(rng, base, rng.randrange(4, 9)))) for i in range(150)]
    assert kept(spark, rows) == survivors(rows)
    assert sum(compared) < len(rows) * 4  # of 11,175 pairs


def test_parities_never_differ_in_more_bits_than_sets_in_shingles():
    rng = np.random.default_rng(4)
    sets = [np.unique(rng.integers(0, 1 << 63, n).astype(np.uint64)) for n in (0, 1, 20, 32, 33, 500, 520, 3000)]
    for s in list(sets):
        sets += [np.unique(np.r_[s[: len(s) * k // 10], rng.integers(0, 1 << 63, len(s) // 5).astype(np.uint64)]) for k in (5, 8, 10)]
    odd = [np.frombuffer(similar.parity(s), np.uint64) for s in sets]
    assert {len(x) for x in odd} >= {1, 2, 16, 32, similar.PARITY_WORDS}
    start = np.r_[0, np.cumsum([len(x) for x in odd])]
    x, y = (v.ravel() for v in np.meshgrid(np.arange(len(sets)), np.arange(len(sets))))
    bits = similar._differing(np.concatenate(odd), start, x, y)
    assert all(b <= len(np.setxor1d(sets[i], sets[j])) for b, i, j in zip(bits, x, y))
    for b, i, j in zip(bits, x, y):  # folded: the parity of residues by the smaller number of bits
        wide = 64 * min(len(odd[i]), len(odd[j]))
        counts = [np.bincount((sets[k] % np.uint64(wide)).astype(np.int64), minlength=wide) % 2 for k in (i, j)]
        assert b == (counts[0] != counts[1]).sum()

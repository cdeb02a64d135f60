"""Spelling variants against plain loops over all pairs of words."""

import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from lexweave.llm import spelling

ALPHABET = "abcdeé"


def one_apart(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    short = min(len(a), len(b))
    i = next((k for k in range(short) if a[k] != b[k]), short)
    j = next((k for k in range(short - i) if a[-1 - k] != b[-1 - k]), short - i)
    return max(len(a), len(b)) - i - j == 1


def words_of(docs):
    found = Counter()
    for ident, text in docs:
        for run in re.findall(r"[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if c.isascii() else c for c in run)
            h = zlib.crc32(f"{'' if ident is None else ident}:{run}".encode())
            if h % 31 == 0:
                at = h % len(run)
                run = run[:at] + run[at + 1 :]
            if len(run) >= 7:
                found[run] += 1
    return {w: n for w, n in found.items() if n >= 2}


def brute(docs):
    words = words_of(docs)
    holes = {}  # words that are alike but for one place
    for w in words:
        for i in range(len(w) + 1):
            holes.setdefault(w[:i] + w[i + 1 :], []).append(w)
        holes.setdefault(w, []).append(w)
    near = {w: {x for i in range(len(w) + 1) for key in (w, w[:i] + w[i + 1 :]) for x in holes[key] if one_apart(w, x)} for w in words}
    form = {}
    for w, n in words.items():
        best = min(near[w], key=lambda x: (-words[x], x), default=None)
        form[w] = best if best is not None and words[best] >= 10 * n else None
    out = []
    for w, n in words.items():
        root = w
        while form[root]:
            root = form[root]
        out.append((w, form[w], root, n, len(near[w]), words[form[w]] if form[w] else None))
    return sorted(out)


def made(seed, n=150):
    rng = random.Random(seed)
    stems = ["".join(rng.choice(ALPHABET) for _ in range(rng.randint(7, 11))) for _ in range(12)]
    docs = []
    for i in range(n):
        words = []
        for _ in range(rng.randint(0, 60)):
            w = rng.choice(stems[: 3 if rng.random() < 0.8 else 12])
            if rng.random() < 0.15:
                at = rng.randrange(len(w))
                w = w[:at] + rng.choice(["", rng.choice(ALPHABET), w[at] * 2]) + w[at + 1 :]
            words.append(w.upper() if rng.random() < 0.1 else w)
        docs.append((i, rng.choice([" ", "-", ", "]).join(words)))
    docs += [(None, docs[0][1]), (3, docs[3][1]), (n, None), (n + 1, ""), (n + 2, "x" * 1500 + " " + "x" * 1500 + "y " + "x" * 1500 + " " + "x" * 1500 + "y"), (n + 3, "ÀÉÎÕÜßÿ Àéîõüßÿ ÀÉÎÕÜßÿ Àéîõüßÿ ×÷×÷×÷× ×÷×÷×÷×")]
    return docs


def rows_of(spark, docs, **options):
    df = spark.createDataFrame([(*d, "w", 1) for d in docs], "doc_id long, text string, word string, n int").repartition(3)
    return sorted(tuple(r) for r in spelling.variants(df, **options).select("word", "form", "root", "n", "n_near", "form_n").collect())


@pytest.mark.parametrize("seed", range(60))
def test_self_join_of_a_trie(seed):
    rng = random.Random(seed)
    m = rng.randint(1, 5)
    rows = sorted({(rng.randint(0, 1), "".join(rng.choice("abç") for _ in range(rng.choice([m, m + 1])))) for _ in range(rng.randint(0, 80))})
    key, middle = np.array([k for k, _ in rows], np.int64), [x for _, x in rows]
    short = np.array([len(x) == m for x in middle], bool)
    i, j = spelling.near_pairs(key, middle, short)
    got = sorted((min(a, b), max(a, b)) for a, b in zip(i.tolist(), j.tolist()))
    assert got == [(a, b) for a in range(len(rows)) for b in range(a + 1, len(rows)) if key[a] == key[b] and one_apart(middle[a], middle[b]) and (short[a] or short[b])]


def test_equal_to_all_pairs(spark):
    docs = made(0)
    want = brute(docs)
    assert sum(r[4] > 0 for r in want) > 50 and any(r[1] for r in want)
    assert rows_of(spark, docs) == want


def test_large_partitions_are_dealt_again(spark, monkeypatch):
    docs = made(1)
    words = spelling.settle(spark.createDataFrame(list(words_of(docs).items()), "word string, n long"), "test-words")
    got = sorted((r.word, r.near) for r in spelling.neighbours(words, hot=3).collect())
    known = words_of(docs)
    assert got == sorted((a, b) for a in known for b in known if one_apart(a, b)) and len(got) > 100
    assert sorted((r.word, r.near) for r in spelling.neighbours(words, hot_chars=60).collect()) == got


def test_chains_lead_to_the_last_word(spark):
    chain = [("abcdefg", 2), ("abcdefgh", 20), ("abcdefghi", 200), ("abcdefghij", 2000), ("abcdefghijk", 20_000)]
    forms = spark.createDataFrame([(a, b) for (a, _), (b, _) in zip(chain, chain[1:])], "word string, form string")
    assert {r.root for r in spelling.roots(forms).collect()} == {"abcdefghijk"}


def test_empty(spark):
    assert rows_of(spark, []) == [] and rows_of(spark, [(1, None), (None, "")]) == []


def test_query(spark, data):
    docs = [tuple(r) for r in spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text").collect()]
    got = sorted((tuple(r) for r in spelling.op11_spelling_variants(spark, data).select("word", "form", "root", "n", "n_near", "form_n").collect()))
    assert got == brute(docs)

import re

import numpy as np
import pytest
import xxhash

from lexweave.llm import similar, simhash
from lexweave.llm.common import components


def brute(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    h = [xxhash.xxh64_intdigest(" ".join(words[i : i + 3]).encode(), 42) for i in range(max(1, len(words) - 2))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def classes(fps, radius=3):
    root = list(range(len(fps)))
    changed = True
    while changed:
        changed = False
        for i in range(len(fps)):
            for j in range(i):
                if bin(fps[i] ^ fps[j]).count("1") <= radius and root[i] != root[j]:
                    a, b = max(root[i], root[j]), min(root[i], root[j])
                    root = [b if r == a else r for r in root]
                    changed = True
    return root


@pytest.mark.parametrize("text", ["", " \t\n\x0b\x0c\r", "One", "one two", "A b C d e f", "É É\u00a0x\u2003y\x1cz ÀB", "w " * 70000])
def test_fingerprint(text):
    assert simhash.fingerprint(text) == brute(text)


def clustered(seed, n):
    rng = np.random.default_rng(seed)
    out = []
    for _ in range(n):
        base = int(rng.integers(0, 1 << 63))
        for _ in range(int(rng.integers(1, 8))):
            out.append(base)
            for b in rng.choice(64, int(rng.integers(0, 4)), replace=False):
                out[-1] ^= 1 << int(b)
        if rng.random() < 0.3:
            base ^= sum(1 << int(b) for b in rng.choice(64, 4, replace=False))
            out.append(base)
    return sorted(set(out))


@pytest.mark.parametrize("seed", range(4))
def test_index_joins_what_all_pairs_join(seed):
    fps = clustered(seed, 25)
    a, b = simhash.GrayIndex(np.zeros(len(fps), np.int64), np.array(fps, np.uint64)).stars(3)
    want, root = classes(fps), {f: f for f in fps}
    root |= {int(x): int(y) for x, y in zip(a, b)}
    groups = {}
    for f, w in zip(fps, want):
        groups.setdefault(w, set()).add(root[f])
    assert all(len(g) == 1 for g in groups.values()) and len({next(iter(g)) for g in groups.values()}) == len(groups)


def test_gray_rank():
    n = np.arange(1 << 10, dtype=np.uint64)
    assert (simhash.gray_rank(n ^ (n >> np.uint64(1))) == n).all()


@pytest.mark.parametrize("hot", [20_000, 3])
def test_links_with_and_without_hot_keys(spark, monkeypatch, hot):
    monkeypatch.setattr(simhash, "HOT_ENTRIES", hot)
    fps = clustered(9, 30) + [0, 1, 3, 0b1111]
    fps = sorted(set(fps))
    table = spark.createDataFrame([(int(np.uint64(f).astype(np.int64)),) for f in fps], "fp long")
    got = {int(np.int64(r.node).astype(np.uint64)): r.root for r in components(simhash.links(table)).collect()}
    groups = {}
    for f, w in zip(fps, classes(fps)):
        groups.setdefault(w, set()).add(got.get(f, ("alone", f)))
    assert all(len(g) == 1 for g in groups.values()) and len({next(iter(g)) for g in groups.values()}) == len(groups)


def test_documents(spark):
    text = " ".join(f"word{i}" for i in range(400))
    rows = [(5, text), (3, text.upper()), (9, text + " more"), (7, "something else entirely different here"), (1, None), (2, ""), (8, " \n"), (None, text), (7, "something else entirely different here")]
    docs = spark.createDataFrame([(i, t, 0) for i, t in rows], "doc_id long, text string, fp int")
    got = sorted(((r.doc_id if r.doc_id is not None else -1), r.component_id) for r in simhash.near_duplicates(docs).collect())
    assert got == [(-1, 3), (1, 1), (2, 1), (3, 3), (5, 3), (7, 7), (7, 7), (8, 1), (9, 3)]
    kept = similar.keep_one(docs)
    assert kept.columns == docs.columns and sorted(str(r.doc_id) for r in kept.collect()) == ["1", "3", "7"]
    assert simhash.near_duplicates(docs.limit(0)).count() == 0


def test_components(spark):
    chain = [(i, i + 1) for i in range(60)] + [(100, 101), (101, 100), (7, 7), (200, 201), (200, 202), (None, 5)]
    got = {r.node: r.root for r in components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(61)} | {100: 100, 101: 100, 200: 200, 201: 200, 202: 200}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0

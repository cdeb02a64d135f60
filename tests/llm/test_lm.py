import math
import zlib
from collections import Counter

import numpy as np

from lexweave.llm import lm


def words(text):
    return (text or "").encode().lower().split()


def test_squeeze_round_trip():
    for x in ([], [5], [1, 2**64 - 1], sorted(set(np.random.default_rng(0).integers(0, 2**63, 500).tolist()))):
        x = np.array(x, np.uint64)
        assert (lm.expand(lm.squeeze(x)) == x).all() and len(lm.expand(lm.squeeze(x))) == len(x)


def test_filter_never_reads_too_low():
    rng = np.random.default_rng(1)
    h = rng.integers(0, 2**63, 4000).astype(np.uint64) * np.uint64(2)
    level = rng.integers(1, 20, 4000)
    f = lm.Filter.piece(np.zeros(8 * 4096, "<u8"), 1)
    f.add(h, level)
    got = f.level(h)
    assert (got >= level).all() and (got == level).mean() > 0.97
    assert (f.level(rng.integers(0, 2**63, 4000).astype(np.uint64)) > 0).mean() < 0.03
    assert (f.level(h, np.zeros(4000, int)) == 0).all()


def test_pieces_side_by_side_are_the_whole_filter():
    rng = np.random.default_rng(2)
    h, level, ranges = np.sort(rng.integers(0, 2**64, 5000, np.uint64)), rng.integers(1, 9, 5000), 8
    cut, bits, starts = lm._cut(h, ranges), [], [0]
    for r in range(ranges):
        piece = lm.Filter.piece(np.zeros(8 * (40 + r), "<u8"), ranges)
        piece.add(h[cut[r] : cut[r + 1]], level[cut[r] : cut[r + 1]])
        bits.append(piece.bits)
        starts.append(starts[-1] + 40 + r)
    whole = lm.Filter(np.concatenate(bits), np.array(starts), ranges)
    asked = np.r_[h, rng.integers(0, 2**64, 5000, np.uint64)]
    of = (asked >> np.uint64(61)).astype(int)
    one_by_one = np.concatenate([lm.Filter.piece(bits[r], ranges).level(asked[of == r]) for r in range(ranges)])
    assert (whole.level(asked)[np.argsort(of, kind="stable")] == one_by_one).all() and (whole.level(h) >= level).all()


def test_thin_round_trip():
    for top in (0, 255, 256, 65536, 2**40):
        x = np.array([0, 1, top])
        assert (lm.fat(lm.thin(x)) == x).all()
    assert len(lm.fat(lm.thin(np.zeros(0, int)))) == 0


def test_scores_are_those_of_exact_quantised_counts(spark, data, monkeypatch):
    """A model of every word and pair, its counts in a dictionary, against the operator with a filter too large to err."""
    docs = spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text")
    monkeypatch.setattr(lm, "BITS_PER_ENTRY", 400)
    learnt = ~lm.held_out(docs.doc_id)
    got = {r.doc_id: r.score for r in lm.scored(docs, lm.learn(docs.where(learnt)), learnt=learnt).collect()}
    texts = {r.doc_id: [*words(r.text), None] for r in docs.collect()}
    train = [x for i, x in texts.items() if zlib.crc32(str(i).encode()) % 5 != 1]
    pairs_in = lambda x: list(zip(["<start>", *x[:-1]], x))
    one, two = Counter(w for x in train for w in x), Counter(p for x in train for p in pairs_in(x))

    def quantised(counts):
        level = {k: int(np.searchsorted(lm.EDGES, c, side="right")) for k, c in counts.items()}
        sums, types = Counter(), Counter()
        for k, c in counts.items():
            sums[level[k]] += c
            types[level[k]] += 1
        return level, {j: sums[j] / types[j] for j in sums}

    (l1, m1), (l2, m2) = quantised(one), quantised(two)
    total, types = sum(one.values()), len(one)
    alone = lambda w: (m1.get(l1.get(w, 0), 0) + 0.5) / (total + 0.5 * (types + 1))
    # A text begins as often as it ends.
    before = lambda p: l1.get(None if p[0] == "<start>" else p[0], 0)
    share = dict.fromkeys(range(lm.LEVELS), 0.5)
    seen = [p for x in train for p in pairs_in(x)]
    for _ in range(lm.ROUNDS):
        due, n = Counter(), Counter()
        for p in seen:
            v = before(p)
            by_pair = min(max(m2[l2[p]] - 1, 0) / max(m1[v] - 1, 1), 1)
            due[v] += share[v] * by_pair / max(share[v] * by_pair + (1 - share[v]) * alone(p[1]), 1e-300)
            n[v] += 1
        share = {v: due[v] / n[v] if n[v] else 0.0 for v in share}
    share = {v: min(x, 0.999) if v else 0.0 for v, x in share.items()}
    for i, x in texts.items():
        want = sum(math.log10(share[before(p)] * min(m2.get(l2.get(p, 0), 0) / max(m1.get(before(p), 0), 1), 1) + (1 - share[before(p)]) * alone(p[1])) for p in pairs_in(x))
        assert math.isclose(got[i], want, rel_tol=1e-6), i


def test_levels_stand_for_small_counts_exactly():
    assert lm.level(np.array([0, 1, 2, 3])).tolist() == [0, 1, 2, 3]


def test_scores(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text")
    got = {r.doc_id: r for r in lm.op3_lm_scoring(spark, data).collect()}
    rows = [(r.doc_id, words(r.text)) for r in docs.collect()]
    out = {i: zlib.crc32(str(i).encode()) % 5 == 1 for i, _ in rows}
    c = Counter(w for i, x in rows if not out[i] for w in [*x, None])
    n, v = sum(c.values()), len(c)
    for i, x in rows:
        x = [*x, None]
        assert (got[i].held_out, got[i].n_tokens, got[i].n_known, got[i].train_tokens) == (out[i], len(x), sum(c[w] > 0 for w in x), n)
        assert math.isclose(got[i].base_score, sum(math.log10((c[w] + 0.5) / (n + 0.5 * (v + 1))) for w in x), rel_tol=1e-9)
        assert got[i].score <= 0
    held = [i for i in got if out[i]]
    assert sum(got[i].score for i in held) > sum(got[i].base_score for i in held)


def test_the_tail_is_exact_without_a_head(spark, data, monkeypatch):
    docs = spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text").limit(60)
    key = lambda model: {r.doc_id: (r.n_known, round(r.base_score, 6)) for r in lm.scored(docs, model).collect()}
    with_head = key(lm.learn(docs))
    monkeypatch.setattr(lm, "HEAD", 3)
    assert key(lm.learn(docs)) == with_head


def test_probabilities_sum_to_one(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text")
    facts = lm.learn(docs).facts
    # Single words: types of a level times their probability, and an unseen word's share.
    counts = Counter(w for r in docs.collect() for w in [*words(r.text), None])
    types = np.bincount(lm.level(np.array(list(counts.values()))), minlength=lm.LEVELS)
    assert math.isclose((types * facts.unigram()).sum() + facts.unigram()[0], 1, rel_tol=1e-9)
    table = lm.log10_of_cells(facts, np.full(lm.LEVELS, 0.5))
    assert table.shape == (lm.LEVELS**3,) and (table <= 1e-12).all()


def test_edges(spark):
    rows = spark.createDataFrame([(1, "a b A"), (1, "a b A"), (2, None), (None, ""), (3, "zzz")], "doc_id long, text string").withColumnRenamed("doc_id", "score")
    model = lm.learn(rows.where("score < 3"))
    got = lm.scored(rows, model, "score").toDF("id", "n", "known", "train", "base", "s").collect()
    assert sorted((str(r.id), r.n, r.known, r.train) for r in got) == [("1", 4, 4, 9), ("1", 4, 4, 9), ("2", 1, 1, 9), ("3", 2, 1, 9), ("None", 1, 1, 9)]
    nothing = lm.learn(rows.limit(0))
    assert all(r.base_score == 0 for r in lm.scored(rows, nothing, "score").collect()) and lm.scored(rows.limit(0), model, "score").count() == 0


def test_a_filter_too_large_to_broadcast_keeps_its_bits_and_scores(spark, data, monkeypatch):
    docs = spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text")
    learnt = ~lm.held_out(docs.doc_id)

    def run():
        model = lm.learn(docs.where(learnt))
        return model, {r.doc_id: tuple(r) for r in lm.scored(docs, model, learnt=learnt).collect()}

    small, want = run()
    monkeypatch.setattr(lm, "MAX_FILTER_BYTES", 1 << 12)
    monkeypatch.setattr(lm, "FLUSH", 3000)
    monkeypatch.setattr(lm, "MERGE_AT_ONCE", 50)
    large, got = run()
    assert small.filter is not None and large.filter is None and large.facts.bits == small.facts.bits >= lm.BITS_PER_ENTRY
    assert len(got) == len(want) == docs.count()
    for i, row in got.items():
        assert row[:4] == want[i][:4] and math.isclose(row[4], want[i][4], rel_tol=1e-9) and math.isclose(row[5], want[i][5], rel_tol=1e-9)
    assert lm.scored(docs.limit(0), large).count() == 0

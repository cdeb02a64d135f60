import numpy as np
from pyspark.sql import functions as F

from lexweave.llm import mixing


def targets(sizes, weights, share=1.5, limit=2):
    """By brute force: whatever is above its limit is cut to it, until nothing is."""
    got, open_ = [0.0] * len(sizes), set(range(len(sizes)))
    while open_:
        left = share * sum(sizes) - sum(got[i] for i in range(len(sizes)) if i not in open_)
        part = {i: left * weights[i] / sum(weights[j] for j in open_) for i in open_}
        over = {i for i in open_ if part[i] > limit * sizes[i]}
        for i in over or open_:
            got[i] = float(limit * sizes[i]) if over else part[i]
        open_ -= over or open_
    return got


def test_targets(spark):
    rng = np.random.default_rng(1)
    for sizes in ([100, 100, 100], [10, 1000, 0], [], [0, 0], [5], rng.lognormal(4, 2, 40).astype(int).tolist()):
        weights = [(3.0, 1.0, 2.0)[i % 3] for i in range(len(sizes))]
        table = spark.createDataFrame([(str(i), n, w) for i, (n, w) in enumerate(zip(sizes, weights))], "key string, size long, weight double")
        got = {r.key: r.target for r in mixing.targets(table).collect()}
        assert np.allclose([got[str(i)] for i in range(len(sizes))], targets(sizes, weights), rtol=1e-12)


def test_many_sources(spark):
    """More sources than weights, each with its target met by its own tilt."""
    rng = np.random.default_rng(2)
    rows = [(i, "w " * int(n), f"s{i % 300:03d}") for i, n in enumerate(rng.integers(1, 9, 12_000))]
    got = mixing.mixed(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    sizes, took, want = {}, {}, {}
    for r in got:
        sizes[r.source] = sizes.get(r.source, 0) + r["size"]
        took[r.source] = took.get(r.source, 0) + r.copies * r["size"]
        want[r.source] = r.target
    names = sorted(sizes)
    assert np.allclose([want[n] for n in names], targets([sizes[n] for n in names], [(3, 1, 2)[i % 3] for i in range(len(names))]), rtol=1e-12)
    assert max(abs(took[n] - want[n]) for n in names) <= 4  # half the longest document


def test_mix(spark):
    rng = np.random.default_rng(0)
    rows = [(i, "w " * int(n), s, "x") for i, (n, s) in enumerate(zip(rng.lognormal(3, 1, 1500).astype(int), rng.choice(["b", "a", "é", None, "Z"], 1500, p=[0.4, 0.3, 0.1, 0.1, 0.1])))]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, target string")
    got = mixing.mixed(docs).collect()
    assert got == mixing.mixed(docs.repartition(7)).orderBy("doc_id").collect() or sorted(got) == sorted(mixing.mixed(docs.repartition(7)).collect())
    order = ["Z", "a", "b", "é", None]
    sizes = [sum(len(t.split()) for _, t, s, _ in rows if s == o) for o in order]
    want = dict(zip(order, targets(sizes, [3, 1, 2, 3, 1])))
    for o, size in zip(order, sizes):
        mine = [r for r in got if r.source == o]
        assert all(r.source_size == size and abs(r.target - want[o]) < 1e-6 and 0 <= r.copies <= 2 for r in mine)
        assert abs(sum(r.copies * r["size"] for r in mine) - want[o]) <= 0.01 * want[o] + 1
        # Rates are one tilt of the base odds by size: their log odds lie on a line.
        free = [r for r in mine if 1e-6 < r.rate < 2 - 1e-6]
        if len(free) > 2:
            x, y = np.array([r["size"] for r in free]), np.log([r.rate / (2 - r.rate) for r in free])
            assert np.abs(np.polyval(np.polyfit(x, y, 1), x) - y).max() < 1e-6
    mix = mixing.mixture(docs)
    assert mix.columns == docs.columns and mix.count() == sum(r.copies for r in got)


def test_edges(spark, monkeypatch):
    docs = spark.createDataFrame([(1, None, "a"), (2, "", "a"), (None, "one two", None), (3, "x", "b"), (3, "x", "b")], "doc_id long, text string, source string")
    got = mixing.mixed(docs).collect()
    assert [r["size"] for r in sorted(got, key=lambda r: str(r.doc_id))] == [0, 0, 1, 1, 2]
    assert {r.target for r in got if r.source == "a"} == {0.0}
    assert mixing.mixed(docs.limit(0)).count() == 0
    monkeypatch.setattr(mixing, "BROADCAST_SOURCES", 0)
    assert sorted(map(str, mixing.mixed(docs).collect())) == sorted(map(str, got))
    clash = docs.withColumns({c: F.lit(7) for c in ("key", "at", "words", "room", "tilt", "_id", "_size", "size", "rate")})
    assert sorted(map(str, (r.copies for r in mixing.mixed(clash).collect()))) == sorted(map(str, (r.copies for r in got)))
    long = spark.createDataFrame([(1, "x " * 2_000_000, "a"), (2, "y", "a")], "doc_id long, text string, source string")
    assert {r["size"] for r in mixing.mixed(long).collect()} == {1, 2_000_000}


def test_few_documents_meet_their_target(spark):
    """Where a source's small documents are used up, a large one more and small ones fewer come nearer."""
    sizes = [5, 136, 224, 233, 233, 377, 395, 933, 2933]
    rows = [(None if s == 3 and i == 0 else 100 * s + i, "w " * n, f"s{s:02}") for s in range(12) for i, n in enumerate(sizes)]
    docs = spark.createDataFrame([*rows, rows[0], (9999, None, "s00")], "doc_id long, text string, source string")
    got = mixing.mixed(docs, weights=(1.0,)).select("doc_id", "source", "size", "target", "copies").collect()
    assert len(got) == len(rows) + 2
    for s in {r.source for r in got}:
        mine = [r for r in got if r.source == s]
        assert abs(sum(r.size * r.copies for r in mine) - mine[0].target) <= 0.02 * mine[0].target
    assert len({r.copies for r in got if r.doc_id == 0}) == 1 and all(0 <= r.copies <= 2 for r in got)
    assert sorted(map(str, got)) == sorted(map(str, mixing.mixed(docs.repartition(3), weights=(1.0,)).select("doc_id", "source", "size", "target", "copies").collect()))


def test_nearer_changes_copies_until_nothing_helps():
    assert mixing.nearer(np.array([10]), np.array([2]), 9.0, 2).tolist() == [1]
    assert mixing.nearer(np.array([933, 2933, 136]), np.array([2, 1, 2]), 5866.0, 2).tolist() == [0, 2, 0]
    rng = np.random.default_rng(2)
    for _ in range(50):
        words, copies = rng.integers(1, 900, 20), rng.integers(0, 3, 20)
        target = rng.uniform(0.2, 1.8) * words.sum()
        got = mixing.nearer(words, copies, target, 2)
        assert abs(got @ words - target) <= min(abs(copies @ words - target), 0.01 * target + 1) and got.min() >= 0 and got.max() <= 2


def test_any_number_of_documents_comes_as_near(spark):
    """Very unequal sizes: what one small document more or less can't reach, an exchange near the turning points can, in sources of 64, 65 and 1,000 documents alike."""
    rng = np.random.default_rng(4)
    rows = []
    for s, n in enumerate((64, 65, 1000, 9)):
        sizes = (rng.pareto(0.8, n) * 40 + 30).astype(int).clip(max=6000)
        rows += [(1000 * s + i, "w " * int(k), f"s{s}") for i, k in enumerate(sizes)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mixing.mixed(docs, weights=(1.0,)).select("doc_id", "source", "size", "target", "copies").collect()
    for s in {r.source for r in got}:
        mine = [r for r in got if r.source == s]
        limit = 0.002 if len(mine) > 9 else 0.02
        assert abs(sum(r.size * r.copies for r in mine) - mine[0].target) <= limit * mine[0].target, s
        assert all(0 <= r.copies <= 2 for r in mine)
    assert sorted(map(str, got)) == sorted(map(str, mixing.mixed(docs.repartition(5), weights=(1.0,)).select("doc_id", "source", "size", "target", "copies").collect()))

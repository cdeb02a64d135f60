import numpy as np
import pytest

from lexweave.llm import embeddings as E


def brute(rows, threshold=0.98):
    unit = []
    for _, v, label in rows:
        ok = v is not None and label is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)
        unit.append(np.array(v) / np.linalg.norm(v) if ok else None)
    n = len(rows)
    near = [[i != j and unit[i] is not None and unit[j] is not None and rows[i][2] == rows[j][2] and len(unit[i]) == len(unit[j]) and unit[i] @ unit[j] >= threshold for j in range(n)] for i in range(n)]
    comp = [r[0] for r in rows]
    for _ in range(n):
        comp = [min([comp[i], *(comp[j] for j in range(n) if near[i][j])]) for i in range(n)]
    return {r[0]: (sum(near[i]), comp[i], comp[i] == r[0]) for i, r in enumerate(rows)}


@pytest.mark.parametrize("block", [1024, 5])
def test_links(spark, monkeypatch, block):
    monkeypatch.setattr(E, "BLOCK", block)
    monkeypatch.setattr(E, "LEAST_BLOCK", block)
    monkeypatch.setattr(E, "SEEN_BLOCK", block)
    rng = np.random.default_rng(4)
    rows = []
    for c in range(40):
        base = rng.standard_normal(16)
        for _ in range(int(rng.integers(1, 9)) if c else 60):
            rows.append((len(rows), (base + rng.standard_normal(16) * (0.05 if c % 2 else 0.02)).tolist(), int(c % 3)))
    rows += [(len(rows) + i, rows[5][1], rows[5][2]) for i in range(30)]
    n = len(rows)
    rows += [(n, None, 1), (n + 1, [0.0] * 16, 1), (n + 2, rows[0][1], None), (n + 3, [float("nan")] * 16, 0), (n + 4, [float("inf")] + [1.0] * 15, 0), (n + 5, [], 0), (n + 6, [1.0, 2.0], 0), (n + 7, [2.0, 4.0], 0), (n + 8, [None] + [1.0] * 15, 0), (n + 9, [1e-30] * 16, 2), (n + 10, [1e30] * 16, 2)]
    table = spark.createDataFrame([(i, v, l, 0) for i, v, l in rows], "vec_id long, embedding array<double>, label int, component_id int")
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in E.near_duplicates(table).collect()}
    assert got == brute(rows)


def test_repeats_and_nothing(spark):
    table = spark.createDataFrame([(1, [1.0, 0.0], 0), (1, [1.0, 0.0], 0), (None, [1.0, 0.01], 0), (None, [0.0, 1.0], 0)], "vec_id long, embedding array<float>, label int")
    got = sorted((str(r.vec_id), r.n_links, r.component_id, r.kept) for r in E.near_duplicates(table).collect())
    assert got[:2] == [("1", 2, 1, True)] * 2 and ("None", 2, 1, False) in got and ("None", 0, None, False) in got
    assert E.near_duplicates(table.limit(0)).count() == 0


def test_recall_with_narrow_windows(spark):
    """Passes find nearly all links even when the window holds a small part of a label."""
    rng = np.random.default_rng(5)
    x = rng.standard_normal((3000, 32))
    x[1::2] = x[::2] + rng.standard_normal((1500, 32)) * 0.12
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    true = (unit[::2] * unit[1::2]).sum(1) >= 0.98
    table = spark.createDataFrame([(i, v.tolist(), 0) for i, v in enumerate(x)], "vec_id long, embedding array<double>, label int")
    got = E.near_duplicates(table).where("n_links > 0").count() / 2
    assert true.sum() > 500 and got >= 0.9 * true.sum()


def test_centred_planes_tell_close_vectors_apart(spark):
    """One round of passes over vectors at cosines near 0.8 of each other, in few and in many partitions, finds planted pairs."""
    rng = np.random.default_rng(9)
    x = rng.standard_normal((8000, 32)) / np.sqrt(32) * 0.5
    x[:, 0] += 1
    x[1:1600:2] = x[:1600:2] + rng.standard_normal((800, 32)) / np.sqrt(32) * 0.15
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    true = {(i, i + 1) for i in range(0, 1600, 2) if unit[i] @ unit[i + 1] >= 0.98}
    table = spark.createDataFrame([(i, v.tolist(), 0) for i, v in enumerate(x)], "vec_id long, embedding array<double>, label int")
    reps = E.representatives(table, "vec_id", "embedding", "label")
    name = {r.rep: r.least for r in reps.collect()}
    for partitions in ("4", "211"):
        spark.conf.set("spark.sql.shuffle.partitions", partitions)
        try:
            found = E._passes(E.hashed(reps, E.centres(reps), E.PASSES), None, 0.98, E.PASSES, E.WINDOW)
            got = {tuple(sorted((name[r.a], name[r.b]))) for r in found.collect()}
        finally:
            spark.conf.set("spark.sql.shuffle.partitions", "4")
        assert len(true) > 500 and len(true & got) >= 0.9 * len(true), (partitions, len(true & got), len(true))


def test_query_on_planted_copies(spark, data, tmp_path):
    """The query over a table with links planted at its end: ties, several labels, all of 211 partitions."""
    rows = [(r.vec_id, list(r.embedding), r.label) for r in spark.read.parquet(f"{data}/embeddings.parquet").collect()]
    rng = np.random.default_rng(3)
    for k, (i, v, label) in enumerate(rows[:60]):
        near = np.array(v) + rng.standard_normal(len(v)) * (0.1 / np.sqrt(len(v))) * np.linalg.norm(v) * (k % 3)
        rows.append((10_000 + k, near.tolist(), label if k % 5 else (label or 0) + 1))
    rows = [(i, np.array(v, np.float32).tolist(), l) for i, v, l in rows]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").repartition(8).write.parquet(f"{tmp_path}/embeddings.parquet")
    want = brute(rows)
    assert sum(n > 0 for n, *_ in want.values()) > 60
    for partitions in ("4", "211"):
        spark.conf.set("spark.sql.shuffle.partitions", partitions)
        try:
            got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in E.op7_embedding_near_dedup(spark, str(tmp_path)).collect()}
        finally:
            spark.conf.set("spark.sql.shuffle.partitions", "4")
        assert got == want


@pytest.mark.parametrize("rounds", [8, 1])
def test_recall_in_a_tight_label(spark, monkeypatch, rounds):
    """Vectors of one label at a cosine near 0.9 of each other: one round of passes misses many links, more rounds or a full comparison find them."""
    monkeypatch.setattr(E, "QUERIES", 1500)
    monkeypatch.setattr(E, "ROUNDS", rounds)
    rng = np.random.default_rng(6)
    x = rng.standard_normal((12_000, 32)) / np.sqrt(32) * 0.33
    x[:, 0] += 1
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    x[1:2000:2] = x[:2000:2] + rng.standard_normal((1000, 32)) / np.sqrt(32) * 0.17
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    near = unit @ unit.T >= 0.98
    np.fill_diagonal(near, False)
    links = int(near.sum())
    table = spark.createDataFrame([(i, v.tolist(), 0) for i, v in enumerate(x)], "vec_id long, embedding array<double>, label int")
    got = sum(r.n_links for r in E.near_duplicates(table, window=4).select("n_links").collect())
    assert links > 1000 and (0.9 * links <= got <= links if rounds > 1 else got == links)


@pytest.mark.parametrize("partitions", ["4", "211"])
def test_links_that_no_query_sample_meets(spark, monkeypatch, partitions):
    """A label whose rare links the passes miss, besides a large class: every link counts, however many rows were looked at."""
    monkeypatch.setattr(E, "QUERIES", 100)
    monkeypatch.setattr(E, "SEEN_BLOCK", 700)
    monkeypatch.setattr(E, "LEAST_BLOCK", 64)
    rng = np.random.default_rng(12)
    x = rng.standard_normal((6000, 32)) / np.sqrt(32) * 0.4
    x[:, 0] += 1
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    x[1:120:2] = x[:120:2] + rng.standard_normal((60, 32)) / np.sqrt(32) * 0.19
    x[5000:5400] = x[5000] + rng.standard_normal((400, 32)) / np.sqrt(32) * 0.13
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    near = unit @ unit.T >= 0.98
    np.fill_diagonal(near, False)
    table = spark.createDataFrame([(i, v.tolist(), 0) for i, v in enumerate(x)], "vec_id long, embedding array<double>, label int")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        got = {r.vec_id: r for r in E.near_duplicates(table, passes=1, window=4).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert near.sum() > 5000 and [got[i].n_links for i in range(6000)] == near.sum(axis=1).tolist()
    least = np.arange(6000)
    while True:
        now = np.minimum(least, np.where(near, least, 6000).min(axis=1))
        if np.array_equal(now, least):
            break
        least = now
    assert [got[i].component_id for i in range(6000)] == least.tolist()


def test_balls_hide_no_link():
    """Classes as balls, split over blocks or not, give the components of all pairs."""
    rng = np.random.default_rng(2)
    base = rng.standard_normal((40, 8))
    x = np.repeat(base, 6, axis=0) + rng.standard_normal((240, 8)) * rng.uniform(0.02, 0.3, (240, 1))
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    cls = np.where(rng.random(240) < 0.5, np.arange(240) // 6 * 6, np.arange(240))
    near = unit @ unit.T >= 0.98
    rows = [(0, min(m, o), max(m, o), m, int(c), v.tolist()) for m, c, v in zip(np.arange(240) % 3, cls, x) for o in range(3)]
    rows.sort(key=lambda r: r[:3])
    batch = E.pa.RecordBatch.from_pylist([dict(zip(("code", "low", "high", "mine", "class", "vec"), r)) for r in rows])
    i, j = np.nonzero(near)
    want = E._unite(240, np.r_[i, np.arange(240)], np.r_[j, cls])
    got = E.pa.Table.from_batches(E._see(iter([batch.slice(at, 37) for at in range(0, len(rows), 37)]), 0.98))
    a, b = (got.column(c).to_numpy() for c in "ab")
    assert len(np.unique(want)) < 200 and np.array_equal(E._unite(240, np.r_[a, np.arange(240)], np.r_[b, cls]), want)

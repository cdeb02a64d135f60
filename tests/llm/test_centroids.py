"""k-means with bounds against plain k-means, and against SQL."""

import hashlib

import numpy as np
import pytest

from lexweave.llm import centroids, queries

from ..oracle import compare

SCHEMA = "vec_id long, embedding array<float>, label int, cluster string, id string"


def brute(rows, k, rounds):
    kept = []
    for r in rows:
        e = r[1]
        if e is not None and len(e) == 64 and all(x is not None and np.isfinite(x) for x in e):
            kept.append((r[0], [int(np.floor(64 * float(np.float32(x)))) for x in e]))
    kept.sort(key=lambda r: (hashlib.sha256(f"1:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1]))
    c = [list(x) for _, x in kept[:k]]

    def nearest(x):
        return min((sum((p - q) ** 2 for p, q in zip(x, m)), j) for j, m in enumerate(c))

    for _ in range(rounds):
        own = [nearest(x)[1] for _, x in kept]
        for j in range(len(c)):
            mine = [x for (_, x), o in zip(kept, own) if o == j]
            if mine:
                c[j] = [sum(col) // len(mine) for col in zip(*mine)]
    got = [(i, *nearest(x)[::-1]) for i, x in kept]
    inertia = [sum(d for _, o, d in got if o == j) for j in range(len(c))]
    return sorted((str(i), o, d, inertia[o], sum(inertia), hashlib.sha256(",".join(map(str, c[o])).encode()).hexdigest()) for i, o, d in got)


def rows_of(seed, n, spread=0.3):
    rng = np.random.default_rng(seed)
    middle = rng.normal(0, 1, (7, 64))
    x = (middle[rng.integers(0, 7, n)] + rng.normal(0, spread, (n, 64))).astype(np.float32)
    rows = [(i, x[i].tolist(), 0, "a", "b") for i in range(n)]
    rows += [rows[0], rows[0], (None, x[1].tolist(), None, None, None), (9001, None, 0, "", ""), (9002, [], 0, "", ""), (9003, [0.0] * 63, 0, "", "")]
    rows += [(9004, [float("nan")] + [0.0] * 63, 0, "", ""), (9005, [None] + [0.0] * 63, 0, "", ""), (9006, [float("inf")] + [0.0] * 63, 0, "", ""), (9007, [0.0] * 64, None, "", "")]
    return rows


def run(spark, rows, **options):
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    return centroids.clusters(centroids.integer_vectors(df), **options)


@pytest.mark.parametrize("seed,n", [(0, 300), (1, 20), (2, 5)])
def test_equal_to_plain_k_means(spark, seed, n):
    rows = rows_of(seed, n)
    got = run(spark, rows).drop("compared").collect()
    assert sorted((str(r.id), r.cluster, r.distance, r.cluster_inertia, r.inertia, r.centroid_sha256) for r in got) == brute(rows, 16, 3)


def test_bounds_spare_comparisons(spark):
    rows = rows_of(3, 2000, 0.05)
    got = run(spark, rows, rounds=6).agg({"compared": "sum", "id": "count"}).first()
    assert got["sum(compared)"] < 0.6 * 16 * 7 * got["count(id)"]


def test_ties_and_repeats_go_to_the_smaller_number(spark):
    rows = [(i, [float(i % 2)] * 64, 0, "", "") for i in range(40)]
    got = run(spark, rows).collect()
    assert len({r.cluster for r in got}) == 2 and {r.distance for r in got} == {0}
    assert sorted((str(r.id), r.cluster, r.distance, r.cluster_inertia, r.inertia, r.centroid_sha256) for r in got) == brute(rows, 16, 3)


def test_empty_and_too_large(spark):
    assert run(spark, []).count() == 0
    assert run(spark, [(1, None, 0, "", "")]).count() == 0
    with pytest.raises(Exception, match="reaches"):
        run(spark, [(1, [1e30] * 64, 0, "", "")]).collect()


def test_query(spark, data):
    compare(spark, data, queries.QUERIES["op13_centroid_clustering"], queries.ORACLE["op13_centroid_clustering"])

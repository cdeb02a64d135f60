"""The stored index against comparing with every vector."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexweave.operators import pivots


def brute(rows, queries, k, exclude=True):
    unit = lambda v: np.array(v) / (np.linalg.norm(v) or 1)
    out = {}
    for q, x in queries:
        scored = sorted((-round(float(unit(x) @ unit(v)), 12), i) for i, v in rows if v is not None and not (exclude and i == q))
        out[q] = [i for _, i in scored[:k]]
    return out


@pytest.fixture(scope="module")
def made(spark, tmp_path_factory):
    rng = np.random.default_rng(0)
    middle = rng.normal(0, 1, (12, 8))
    rows = [(i, (middle[i % 12] + rng.normal(0, 0.15, 8)).tolist()) for i in range(1500)]
    rows += [(2000 + i, rows[5][1]) for i in range(40)] + [(3000, [0.0] * 8), (3001, None), (3002, rows[7][1])]
    path = tmp_path_factory.mktemp("index").as_uri() + "/one"
    df = spark.createDataFrame(rows, "vec_id long, v array<double>")
    pivots.build(df.repartition(3), "vec_id", "v", path, block=50)
    return rows, path


def test_answers_are_those_of_all_vectors(spark, made):
    rows, path = made
    index = pivots.Index(spark, path)
    asked = [r for r in rows if r[0] % 50 == 0 and r[1]]
    queries = spark.createDataFrame(asked, "id long, vec array<double>")
    got, met = index.nearest(queries, 7)
    found = {}
    for r in got.orderBy("query_id", "rank").collect():
        found.setdefault(r.query_id, []).append(r.id)
    assert found == brute(rows, asked, 7)
    share = {r.query_id: r.blocks / len(index) for r in met.collect()}
    assert len(share) == len(set(asked_id for asked_id, _ in asked)) and share[3000] == 1
    assert np.mean([x for q, x in share.items() if q != 3000]) < 0.5


def test_only_folders_that_are_needed_are_read(spark, made):
    rows, path = made
    index = pivots.Index(spark, path)
    wanted = index._wanted(spark.createDataFrame([rows[3]], "query_id long, vec array<double>"), None, 5, 0, 1)
    plan = index._compared(wanted, 5, True)._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(pivot" in plan or "PartitionFilters: [pivot" in plan or "pivot#" in plan


def test_more_neighbours_than_rows_and_hot_blocks(spark, made, monkeypatch):
    monkeypatch.setattr(pivots, "ASKING", 10)
    rows, path = made
    index = pivots.Index(spark, path)
    asked = [(i, rows[5][1]) for i in range(5000, 5060)]
    got, _ = index.nearest(spark.createDataFrame(asked, "id long, vec array<double>"), 3)
    assert {(r.query_id, r.id) for r in got.collect()} == {(q, i) for q, _ in asked for i in (5, 2000, 2001)}
    got, _ = index.nearest(spark.createDataFrame([rows[0]], "id long, vec array<double>"), 5000, exclude_self=False)
    assert got.count() == sum(v is not None for _, v in rows)


def test_empty_index(spark, tmp_path):
    path = tmp_path.as_uri() + "/none"
    pivots.build(spark.createDataFrame([], "id long, v array<double>"), "id", "v", path)
    index = pivots.Index(spark, path)
    got, met = index.nearest(spark.createDataFrame([(1, [1.0])], "id long, vec array<double>"), 3)
    assert got.count() == 0 and met.agg(F.sum("blocks")).first()[0] == 0

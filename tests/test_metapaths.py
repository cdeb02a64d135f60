"""A maintained metapath against a rebuild after every batch."""

import random
from collections import Counter

import pytest

from lexweave.streaming import metapaths

STEPS = [("cites", False), ("amends", False), ("amends", True), ("cites", True)]


def rebuilt(edges):
    paths = Counter({(n, n): 1 for n in {a for label, a, b in edges if label == "cites"}})
    for label, back in STEPS:
        longer = Counter()
        step = Counter((b, a) if back else (a, b) for x, a, b in edges if x == label)
        for (s, e), n in paths.items():
            for (a, b), m in step.items():
                if a == e:
                    longer[s, b] += n * m
        paths = longer
    return dict(paths)


def batch(rng, k):
    rows = []
    for seq in range(25 if k else 40):
        label = rng.choice(["cites", "amends", "other"])
        a = f"c{rng.randrange(6)}" if label == "cites" else f"l{rng.randrange(5)}"
        rows.append((label, a, f"l{rng.randrange(5)}", rng.random() < (0.9 if k == 0 else 0.45), seq))
    return rows + [(None, "c1", "l1", True, 1), ("cites", None, "l1", True, 1)]


@pytest.mark.parametrize("streamed", [True, False])
def test_three_batches_equal_a_rebuild(spark, tmp_path, monkeypatch, streamed):
    monkeypatch.setattr(metapaths, "COMPACT", 2)
    rng, edges, table = random.Random(5), set(), str(tmp_path / "table")
    for k in range(3):
        rows = batch(rng, k)
        df = spark.createDataFrame(rows, metapaths.CHANGES)
        if streamed:
            df.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
            metapaths.maintain(metapaths.landed(spark, str(tmp_path / "in")), table, str(tmp_path / "check"), STEPS).awaitTermination()
        else:
            metapaths.merge(df, k, table, STEPS)
            metapaths.merge(df, k, table, STEPS)  # run again after a failure
        for label, a, b, added, _ in sorted((r for r in rows if None not in r), key=lambda r: (r[4], r[3])):
            (edges.add if added else edges.discard)((label, a, b))
        assert {(r.start, r.end): r.n for r in metapaths.pairs(spark, table).collect()} == rebuilt(edges)
        assert {(r.label, r.source, r.target) for r in metapaths.state(spark, table, "edges").collect()} == edges


def test_nothing_landed(spark, tmp_path):
    assert metapaths.pairs(spark, str(tmp_path / "none")).count() == 0
    metapaths.merge(spark.createDataFrame([], metapaths.CHANGES), 0, str(tmp_path / "t"), STEPS)
    assert metapaths.pairs(spark, str(tmp_path / "t")).count() == 0


def test_withdrawn_edges_make_no_hubs(spark):
    from lexweave.plans.catalogue import never

    edges = spark.range(400).selectExpr("concat('6', id) AS source", "concat('3', id div 4) AS target")
    most = never(edges).groupBy("target").count().agg({"count": "max"}).first()[0]
    assert most == 4 and never(edges).join(edges, ["source", "target"]).count() == 0

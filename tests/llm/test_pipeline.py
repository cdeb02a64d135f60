"""Each stage of the pipeline against brute force on its own input."""

import re
from collections import Counter

import pytest

import corpus_pipeline
from lexweave.llm import mixing, similar, toxicity
from lexweave.llm.common import settle

from .test_mixing import targets
from .test_similar import survivors


@pytest.fixture(scope="module")
def stages(spark, data):
    docs, got = spark.read.parquet(f"{data}/documents.parquet"), []
    for _, stage in corpus_pipeline.STAGES:
        out = settle(stage(spark, docs, data), "test-stage")
        got.append((docs, out))
        docs = out
    return got


def test_stage_names():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "simhash near-dedup", "mixing", "packing"]


def test_toxic_documents_go_and_clean_ones_stay(spark, data, stages):
    docs, out = stages[0]
    assert out.columns == docs.columns
    model = toxicity.trained(toxicity.training_sample(docs, spark.read.parquet(f"{data}/labels.parquet")))
    want = Counter(tuple(r) for r in docs.collect() if model.score(r.text or "") < toxicity.THRESHOLD)
    assert Counter(tuple(r) for r in out.collect()) == want
    clean = {r.doc_id for r in spark.read.parquet(f"{data}/labels.parquet").where("toxic = 0").collect()}
    ids = {r.doc_id for r in docs.collect()}
    assert len(clean & {r.doc_id for r in out.collect()}) >= 0.98 * len(clean & ids)


def test_one_document_of_each_group_stays(stages):
    docs, out = stages[1]
    rows = docs.collect()

    want = survivors([(r.doc_id, r.text) for r in rows])
    assert {r.doc_id for r in out.collect()} == want and out.count() == len(want)
    assert {tuple(r) for r in out.collect()} <= {tuple(r) for r in rows}


def test_rows_that_share_an_id_or_have_none(spark):
    a, b, c = (" ".join(f"{w}{i}" for i in range(60)) for w in ("alpha", "beta", "gamma"))
    rows = [(1, a, 0), (1, b, 0), (1, a, 0), (2, b, 0), (None, c, 0), (None, c, 0), (3, None, 0), (None, "", 0), (None, a, 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, fp int")
    got = sorted(tuple(map(str, r)) for r in similar.keep_one(docs).collect())
    assert got == sorted([("1", a, "0"), ("1", b, "0"), ("None", c, "0"), ("3", "None", "0")])


def test_the_mix_meets_its_targets(stages):
    docs, out = stages[2]
    size = lambda r: len(re.findall(r"[^\x20\x09-\x0D]+", r.text or ""))
    have, took = Counter(), Counter()
    for r in docs.collect():
        have[r.source] += size(r)
    for r in out.collect():
        took[r.source] += size(r)
    names = sorted(have)
    for n, t in zip(names, targets([have[n] for n in names], [mixing.WEIGHTS[i % 3] for i in range(len(names))])):
        assert abs(took[n] - t) <= 0.1 * t + 1
    assert max(Counter(tuple(r) for r in out.collect()).values()) <= 2


def test_everything_is_packed(stages):
    docs, out = stages[3]
    rows = out.collect()
    assert Counter(r.doc_id for r in rows if r.piece == 0) == Counter(r.doc_id for r in docs.collect())
    fill = Counter()
    for r in rows:
        fill[r.sequence_id] += r.length
    assert max(fill.values()) <= 4096 and len(fill) <= 1.05 * sum(fill.values()) / 4096 + 1


def test_odd_documents_go_through(spark, data):
    docs = spark.createDataFrame([(1, None, "en", "s", 0, "z"), (2, "", None, None, None, "z"), (None, "a b c", "en", "s", 5, "z"), (3, "x " * 30_000, "en", "t", 1, "z"), (3, "x " * 30_000, "en", "t", 1, "z")], "doc_id long, text string, lang string, source string, n_chars long, score string")
    for _, stage in corpus_pipeline.STAGES:
        for rows in (docs, docs.limit(0)):
            out = stage(spark, rows, data)
            assert out.count() >= 0
            assert stage is corpus_pipeline.STAGES[-1][1] or out.columns == docs.columns

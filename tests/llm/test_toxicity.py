import math
import random

from lexweave.llm import toxicity


def corpus(n, seed):
    rng = random.Random(seed)
    words = ["".join(rng.choice("abdeilmnor") for _ in range(rng.randint(2, 7))) for _ in range(400)]
    bad, rows = ["scumxx", "vilestem"], []
    for i in range(n):
        sents = [[rng.choice(words) for _ in range(rng.randint(3, 9))] for _ in range(rng.randint(1, 40))]
        toxic = rng.random() < 0.2
        if toxic:
            for _ in range(rng.randint(1, 3)):
                s = rng.choice(sents)
                s.insert(rng.randrange(len(s) + 1), rng.choice(bad) + (rng.choice(["", "er", "ing", "zz"])))
        rows.append((i, ". ".join(" ".join(s) for s in sents) + ".", int(toxic)))
    return rows


def test_learns_sentences_from_documents():
    train, held = corpus(900, 1), corpus(300, 2)
    model = toxicity.fit([t for _, t, _ in train], [y for *_, y in train])
    right = sum((model.score(t) >= toxicity.THRESHOLD) == bool(y) for _, t, y in held)
    assert right >= 0.97 * len(held)
    text = "Plain words here. You scumxxer there! All fine again."
    assert [text[s["begin"] : s["end"]].strip() for s in model.offending(text)] == ["You scumxxer there"]
    assert model.score("fine. " * 3000) < toxicity.THRESHOLD and 0 <= model.score("") < 0.01


def test_noisy_or():
    model = toxicity.fit([t for _, t, _ in corpus(300, 3)], [y for *_, y in corpus(300, 3)])
    for _, text, _ in corpus(20, 4):
        ps = [1 / (1 + math.exp(-model.logit(s))) for s in toxicity.sentences(text)]
        assert math.isclose(model.score(text), 1 - math.prod(1 - p for p in ps), abs_tol=1e-9)


def test_no_model_from_one_class():
    assert toxicity.fit([], []).score("x") < 0.3 and toxicity.fit(["a"], [0]).score("a") < 0.3 and toxicity.fit(["a"], [1]).score("a") > 0.9
    assert toxicity.fit(["", "."], [0, 1]).score("a") < 0.3


def test_frames(spark):
    rows = corpus(300, 5)
    docs = spark.createDataFrame([(i, t, "s") for i, t, _ in rows] + [(1000, None, "s"), (1001, "", "s"), (None, "scumxx", "s"), (1002, "w " * 200_000, "s")], "doc_id long, text string, score string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows] + [(i, 0) for i, *_ in rows] + [(None, 1), (1001, None)], "doc_id long, toxic int")
    sample = toxicity.training_sample(docs, labels)
    assert sample.count() == 300 and sample.where("label = 1").count() == sum(y for *_, y in rows)
    got = toxicity.scored(docs, toxicity.trained(sample), spans=True).collect()
    assert len(got) == docs.count() and all(0 <= r.score <= 1 for r in got)
    assert {r.score for r in got if r.doc_id in (1000, 1001)} == {next(r.score for r in got if r.doc_id == 1001)}
    assert toxicity.scored(docs.limit(0), toxicity.fit([], [])).count() == 0
    assert toxicity.trained(toxicity.training_sample(docs, labels.limit(0))).score("x") < 0.3


def test_query_on_held_out_rows(spark):
    import os

    sf = "/root/testdata/sf0.1"
    if not os.path.isdir(sf):
        import pytest

        pytest.skip("no test data here")
    got = toxicity.op9_toxicity(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").where("held_out")
    table = {(r.toxic, r.predicted): r["count"] for r in got.groupBy("toxic", "predicted").count().collect()}
    assert table[1, 1] >= 0.85 * (table[1, 1] + table.get((1, 0), 0)) and table.get((0, 1), 0) <= 0.02 * table[0, 0]

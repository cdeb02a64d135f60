"""Document vectors against a loop over documents, whatever the partitions and batches."""

import numpy as np
import pytest

from lexweave.operators import encoders, hierarchy

TOKENIZER = encoders.LongTokenizer(encoders.word_tokenizer(), max_chunk_tokens=12)


def rows():
    rng = np.random.default_rng(0)
    made = [(i, " ".join(f"w{k}" for k in rng.integers(0, 50, n))) for i, n in enumerate([1, 5, 11, 12, 13, 40, 3000, 7])]
    return [*made, (3, made[3][1]), (None, "a b"), (20, None), (21, "")]


def alone(text):
    """Chunks of one text by plain slicing, then the encoder."""
    ids = [encoders.CLS, *encoders.word_tokenizer()()([text or ""])[0]]
    if len(ids) <= 12:
        parts = [ids]
    else:
        body = ids[1:] + [encoders.PAD] * (encoders.padded_length(len(ids), 12) - len(ids) + 1)
        parts = [([encoders.CLS] if body[at] else [encoders.PAD]) + body[at : at + 11] for at in range(0, len(body) - 10, 10)]
    vec = hierarchy.hashing_chunks(8)()(parts, [[int(x != encoders.PAD) for x in p] for p in parts])
    real = np.array([p[0] != encoders.PAD for p in parts])
    return len(parts), encoders.ChunkEncoder(8, 2, 2, len(parts))(vec, real)


@pytest.mark.parametrize("batch", [3, 10_000])
def test_document_vectors(spark, batch):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    try:
        docs = spark.createDataFrame(rows(), "doc_id long, text string").repartition(2 if batch == 3 else 5)
        got = sorted(((str(r.id), r.chunks, tuple(np.round(r.vec, 9))) for r in hierarchy.document_vectors(docs, "doc_id", "text", TOKENIZER, hierarchy.hashing_chunks(8), 8, heads=2).collect()))
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    want = sorted((str(i), n, tuple(np.round(v, 9))) for (i, _), (n, v) in ((r, alone(r[1])) for r in rows()))
    assert [g[:2] for g in got] == [w[:2] for w in want]
    assert all(np.allclose(g[2], w[2], atol=1e-8) for g, w in zip(got, want))


def test_attention_in_blocks_is_the_same(monkeypatch):
    x = np.random.default_rng(1).normal(0, 1, (30, 8))
    real = np.arange(30) < 27
    whole = encoders.ChunkEncoder(8, 2, 2)(x, real)
    monkeypatch.setattr(encoders, "ROWS", 7)
    assert np.allclose(encoders.ChunkEncoder(8, 2, 2)(x, real), whole)


def test_tokens_of_few_texts_are_held_at_once(spark, monkeypatch):
    import pyarrow as pa

    texts = ["a" * 40, None, "b" * 500, "", "c" * 90, "d" * 90, "é" * 60]
    monkeypatch.setattr(encoders, "PIECE", 200)
    parts = list(encoders.by_size(pa.RecordBatch.from_pydict({"n": list(range(7)), "t": texts}), "t"))
    assert [x for p in parts for x in p.column("t").to_pylist()] == texts and [p.num_rows for p in parts] == [2, 1, 2, 1, 1]
    assert list(encoders.by_size(pa.RecordBatch.from_pydict({"t": pa.array([], pa.string())}), "t")) == []
    monkeypatch.undo()
    docs = spark.createDataFrame([(i, "x" * 100_000) for i in range(60)], "n int, t string").coalesce(1)
    whole = encoders.LongTokenizer(lambda: lambda some: [[sum(map(len, some))] for _ in some]).ids(docs, "t").collect()
    assert len(whole) == 60 and max(r.ids[1] for r in whole) <= 1 << 20


def test_empty(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert hierarchy.document_vectors(docs, "doc_id", "text", TOKENIZER, hierarchy.hashing_chunks(8), 8).count() == 0

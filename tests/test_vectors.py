import numpy as np
import pytest
from pyspark.sql import functions as F

from lexweave.functions import vectors as V
from lexweave.operators import encoders, explain, network, search, tfidf


def test_top_k_against_numpy(spark):
    rng = np.random.default_rng(3)
    x = rng.standard_normal((60, 8))
    x[7], x[9] = x[3], 0
    table = search.index(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "i long, v array<double>"), "i", "v")
    unit = x / np.where(np.linalg.norm(x, axis=1) > 0, np.linalg.norm(x, axis=1), 1)[:, None]
    got = {}
    for r in search.top_k(table, table, 5).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append(r.id)
    for q in range(60):
        s = np.round(unit @ unit[q], 12)
        assert got[q] == [i for i in sorted(range(60), key=lambda i: (-s[i], i)) if i != q][:5]
    first = search.top_k_drop_first(table.where("id = 7"), table, 1).first()
    assert first.id == 7  # the duplicate with the smaller id was dropped in its place
    assert search.top_k(table, table, 100).where("query_id = 0").count() == 59


def test_fusion(spark):
    lists = spark.createDataFrame([(1, 0, 1, "a"), (1, 0, 2, "b"), (1, 1, 1, "b"), (1, 1, 2, "c"), (1, 1, 3, "b")], "query_id int, list_id int, rank int, doc string")
    got = {r.doc: (r.score, r["rank"]) for r in search.fuse(lists, [1.0, 2.0]).collect()}
    assert got["b"][1] == 1 and abs(got["b"][0] - (1 / 62 + 2 / 61 + 2 / 63)) < 1e-12 and got["a"][1] == 3
    with pytest.raises(ValueError):
        search.fuse(lists, [1.0])
    ties = spark.createDataFrame([(1, 0, 1, "z"), (1, 1, 1, "a")], "query_id int, list_id int, rank int, doc string")
    assert [r.doc for r in search.fuse(ties, [1.0, 1.0]).orderBy("rank").collect()] == ["z", "a"]


def test_tfidf_transform_ignores_unknown_terms(spark):
    docs = spark.createDataFrame([(1, ["a", "b"]), (2, ["a", "c"]), (3, ["c", "d", "c"])], "doc_id int, terms array<string>")
    counts = tfidf.term_counts(docs, "doc_id", "terms")
    voc = tfidf.fit(counts, 3)
    assert {r.term for r in voc.collect()} == {"a", "c"}
    fresh = tfidf.term_counts(spark.createDataFrame([(9, ["zzz", "a"]), (8, ["zzz"])], "doc_id int, terms array<string>"), "doc_id", "terms")
    assert [(r.doc, r.term, round(r.weight, 9)) for r in tfidf.transform(fresh, voc).collect()] == [(9, "a", 1.0)]


def chunked(ids, size):
    overlap, width = size // 10, size - 1
    if len(ids) <= size:
        return [ids]
    body = ids[1:] + [0] * (encoders.padded_length(len(ids), size) - len(ids) + 1)
    return [[(0 if body[i] == 0 else 101), *body[i : i + width]] for i in range(0, len(body) - width + 1, width - overlap)]


@pytest.mark.parametrize("n", [63, 64, 65, 121, 122, 192, 500])
def test_chunks(spark, n):
    ids = [101, *range(1, n)]
    got = spark.createDataFrame([(ids,)], "ids array<int>").select(encoders.chunks(F.col("ids"), 64).alias("c")).first().c
    assert [c.ids for c in got] == chunked(ids, 64)
    assert set(range(1, n)) <= {t for c in got for t in c.ids}


def test_pools_and_encoders(spark):
    t = spark.createDataFrame([("a", 0, 1.0, 1), ("a", 0, 3.0, 1), ("a", 0, 9.0, 0), ("b", 0, 5.0, 0)], "doc string, dim int, x double, mask int")
    assert {r.doc: r.pooled for r in encoders.mean_pool(t, ["doc"]).collect()} == {"a": 2.0, "b": 0.0}
    assert {r.doc: r.pooled for r in encoders.max_pool(t, ["doc"]).collect()} == {"a": 3.0, "b": -1e9}
    d = spark.createDataFrame([(1, "x y"), (2, None)], "id int, text string")
    got = {r.id: r.embedding for r in encoders.encode(d, "text", encoders.hashing_encoder(8)).collect()}
    assert len(got[1]) == 8 and got[2] == [0.0] * 8
    model = encoders.ChunkEncoder(12, pooling="mean")
    x = np.random.default_rng(0).standard_normal((3, 12))
    alone = model(x, np.array([True] * 3))
    padded = model(np.vstack([x, np.zeros((2, 12))]), np.array([True] * 3 + [False] * 2))
    assert np.allclose(alone, padded)
    with pytest.raises(ValueError):
        encoders.ChunkEncoder(12, pooling="other")


def test_network_forward(spark):
    rng = np.random.default_rng(1)
    n, x = 5, rng.standard_normal((5, 3))
    pairs = [(0, 1), (2, 1), (1, 1), (3, 0)]
    a = np.zeros((n, n))
    for s, e in pairs:
        a[e, s] = 1
    want = (a / np.sqrt(np.maximum(1, a.sum(0)))[None] / np.sqrt(np.maximum(1, a.sum(1)))[:, None]) @ x
    f = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "node int, vec array<double>")
    got = network.convolve(spark.createDataFrame(pairs, "start int, end int"), f, 3)
    assert np.allclose(np.array([r.vec for r in got.orderBy("node").collect()]), want)
    w, b = rng.standard_normal((3, 2)), rng.standard_normal(2)
    one = network.metapath_view({"p": spark.createDataFrame(pairs, "start int, end int")}, f, {"p": (np.eye(3), np.zeros(3))}, (w, b, np.ones(2)))
    assert np.allclose(np.array([r.vec for r in one.orderBy("node").collect()]), np.where(want >= 0, want, 0.25 * want))
    sampled = spark.createDataFrame([(0, 1), (0, 1), (2, 1)], "source int, target int")
    ws, wt, al, ar, bias = rng.standard_normal((3, 2)), rng.standard_normal((3, 2)), rng.standard_normal(2), rng.standard_normal(2), np.array([0.5, -0.5])
    h, t = x @ ws, x @ wt
    e = np.array([h[s] @ al + t[1] @ ar for s in (0, 0, 2)])
    e = np.where(e >= 0, e, 0.2 * e)
    alpha = np.exp(e - e.max()) / np.exp(e - e.max()).sum()
    got = {r.node: r.vec for r in network.attend(sampled, f, f, ws, wt, al, ar, bias).collect()}
    assert np.allclose(got[1], alpha @ h[[0, 0, 2]] + bias) and np.allclose(got[4], bias)
    s = np.exp(rng.standard_normal((4, 4)))
    m = spark.createDataFrame([(i, j, float(s[i, j])) for i in range(4) for j in range(4)], "i int, j int, s double")
    want = -0.5 * np.log(np.diag(s) / (s.sum(1) + 1e-8)).mean() - 0.5 * np.log(np.diag(s) / (s.sum(0) + 1e-8)).mean()
    assert abs(network.contrast_loss(m).first().loss - want) < 1e-9


@pytest.mark.parametrize("kind", ["few", "nothing", "starts of many ends", "ends of many starts"])
def test_halves_convolve_as_their_pairs(spark, monkeypatch, kind):
    from lexweave.operators.graph import Halves

    rng = np.random.default_rng(3)
    starts, ends = {"few": (12, 8), "nothing": (1, 1), "starts of many ends": (2, 30), "ends of many starts": (40, 3)}[kind]
    edges = spark.createDataFrame(sorted({(int(a), 100 + int(b)) for a, b in zip(rng.integers(0, starts, 40), rng.integers(0, ends, 40))})[: 0 if kind == "nothing" else 40], "start int, end int")
    f = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(rng.standard_normal((starts + 2, 3))) if i != 1], "node int, vec array<double>")  # a start has no features
    rows = lambda x: [(r.node, np.round(r.vec, 9).tolist()) for r in network.convolve(x, f, 3).orderBy("node").collect()]
    want = rows(Halves(edges).pairs())
    assert rows(Halves(edges)) == want
    assert (network.repeated(Halves(edges)) is None) == (kind == "starts of many ends")
    if kind != "starts of many ends":
        monkeypatch.setattr(Halves, "pairs", None)  # not needed
        assert rows(Halves(edges)) == want


def test_attention_over_parts_is_the_same(spark, monkeypatch):
    rng = np.random.default_rng(7)
    x = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(rng.standard_normal((40, 3)))], "node int, vec array<double>")
    edges = spark.createDataFrame([(int(a), int(b)) for a, b in rng.integers(0, 40, (150, 2))], "source int, target int")
    w, a = [rng.standard_normal((3, 2)) for _ in range(2)], [rng.standard_normal(2) for _ in range(3)]

    def rows():
        got = network.attend(edges, x, x, *w, *a)
        views = got.select(F.lit("a").alias("view"), "node", "vec").unionByName(x.select(F.lit("b").alias("view"), "node", F.slice("vec", 1, 2).alias("vec")))
        final = network.semantic_attention(views, w[0][:2], a[0], a[1])
        return final.rdd.getNumPartitions(), [np.round(r.vec, 9).tolist() for r in final.orderBy("node").collect()]

    want = rows()
    monkeypatch.setattr(network, "VECTORS", 10)
    assert rows() == (8, want[1])


@pytest.mark.parametrize("dim, tau", [(1, 0.8), (2, 0.8), (2, 0.2), (3, 0.5)])
def test_few_components_contrast_without_pairs(spark, monkeypatch, dim, tau):
    from lexweave.operators import search

    rng = np.random.default_rng(5)
    ids = [*range(40), 7, None, None]  # an id and null come twice
    make = lambda n: search.index(spark.createDataFrame([(i, v) for i, v in zip(ids[:n], [*rng.standard_normal((n - 1, dim)).tolist(), [0.0] * dim])], "id int, v array<double>").repartition(3), "id", "v")
    a, b = make(43), make(42)
    rows = lambda d: [tuple(x) for x in d.orderBy("side", F.col("id").asc_nulls_first()).select("total", "mine").collect()]
    assert np.allclose(rows(network.series_sums(a, b, tau, *network.series(dim, tau))), rows(network.contrast_sums(a, b, tau)), rtol=1e-9, atol=0)
    want = network.contrast_loss_blocks(a, b, tau, 0.3).first().loss
    monkeypatch.setattr(network, "contrast_sums", None)  # pairs aren't made
    assert abs(network.contrast_loss_blocks(a, b, tau, 0.3, dim).first().loss - want) < 1e-9
    assert network.series(32, 0.5) is None and network.series(2, 0.05) is None


def test_explanations(spark):
    model = explain.DetachedAttention(6)
    x = np.random.default_rng(2).standard_normal((4, 6))
    pooled, r = model(x)
    assert r.shape == (6, 4) and np.allclose(r.sum(1), pooled)  # without biases relevance is conserved
    pairs = spark.createDataFrame([(1, "a b", "c d e"), (2, "", "x"), (3, None, "x")], "id int, l string, r string")
    embed = lambda w: np.random.default_rng(len(w) + ord(w[0])).standard_normal(6)
    got = explain.explain_pairs(pairs, "id", "l", "r", embed, lambda: explain.DetachedAttention(6)).collect()
    assert len(got) == 6 and max(abs(g.relevance) for g in got) == 1.0 and all(g.colour[:7] in ("#ff0000", "#0000ff") for g in got)
    assert explain.attention_mask(np.array([[1, 0]])).tolist() == [[[[-0.0, -10000.0]]]]
    with pytest.raises(ValueError):
        explain.attention_mask(np.zeros(3))
    words = spark.createDataFrame([(1, 0, 4.0), (1, 1, 2.0)], "line int, position int, width double")
    assert [w.centre for w in explain.word_centres(words, ["line"]).orderBy("position").collect()] == [2.0, 6.0]


def test_scalars(spark):
    row = spark.createDataFrame([([3.0, 4.0], [0.0, 0.0])], "a array<double>, z array<double>")
    got = row.select(V.normalised(F.col("a")), V.normalised(F.col("z")), V.cosine(F.col("a"), F.col("z")), V.cosine(F.col("a"), F.col("a"))).first()
    assert [round(x, 12) for x in got[0]] == [0.6, 0.8] and got[1] == [0.0, 0.0] and got[2] is None and abs(got[3] - 1) < 1e-12
    assert V.position_table(4, 5, 0)[0].tolist() == [0] * 5 and V.position_table(4, 5)[1][-1] == 0
    assert np.allclose(V.layer_norm(np.array([[1.0, 3.0]])), [[-1, 1]])


def test_whole_forward_pass(spark):
    from lexweave.operators import graph as G

    edges = spark.createDataFrame([("61", "31"), ("62", "31"), ("62", "32"), ("63", "32")], "source string, target string")
    subjects = spark.createDataFrame([("61", "S"), ("63", "S")], "source string, target string")
    cases, acts = (spark.createDataFrame([(i,) for i in ids], "id string") for ids in (["61", "62", "63"], ["31", "32"]))
    g = G.typed_graph(edges, subjects, cases, acts)
    index = G.dense_index(G.nodes_of(g))
    titles = spark.createDataFrame([("61", "on goods"), ("62", "on services"), ("31", "act"), ("S", "tax")], "id string, title string")
    f = {t: network.node_features(titles, index, t, encoders.hashing_encoder(4)).select("node", "vec") for t in ("case", "legislation", "subject_matter")}
    assert f["case"].count() == 3
    rng = np.random.default_rng(0)
    w, att = (rng.standard_normal((4, 4)), rng.standard_normal(4)), (rng.standard_normal((4, 4)), rng.standard_normal(4), rng.standard_normal(4))
    clc = [("case", "cites", "legislation"), ("legislation", "cited_by", "case")]
    mp = network.case_embeddings({"clc": G.metapath_pairs(g, clc)}, f["case"], {"clc": w}, att)
    schema = [("legislation", "cited_by", "case"), ("subject_matter", "related_to", "case")]
    one = (rng.standard_normal((4, 4)), rng.standard_normal((4, 4)), rng.standard_normal(4), rng.standard_normal(4), np.zeros(4))
    sc = network.schema_view(g, schema, f, {"legislation": 2, "subject_matter": 2}, dict.fromkeys(schema, one), att)
    assert mp.count() == sc.count() == 3
    loss = network.contrast(mp, sc, w, w).first().loss
    assert loss > 0 and loss == pytest.approx(network.contrast(mp, sc, w, w).first().loss)
    value, gate = explain.detached_gelu(np.array([-1.0, 0.0, 2.0]))
    assert np.allclose(value, V.gelu_new(np.array([-1.0, 0.0, 2.0])))
    assert explain.EncoderConfig(6, layers=2).encoder()(np.ones((2, 6)) * [[1], [2]])[1].shape == (6, 2)


def test_sparse_top_k_against_brute_force(spark, monkeypatch):
    from lexweave.operators import tfidf

    rng = np.random.default_rng(5)
    vectors = {i: {f"t{int(t)}": float(w) for t, w in zip(rng.integers(0, 30, 8), rng.random(8))} | {"common": 1.0} for i in range(90)}
    vectors[90] = {"alone": 1.0}
    weights = spark.createDataFrame([(i, t, w) for i, v in vectors.items() for t, w in v.items()], "doc long, term string, weight double")
    queries = spark.createDataFrame([(i,) for i in (0, 7, 7, 90, 999)], "id long")
    want = []
    for q in (0, 7, 90):
        scores = [(round(sum(w * v.get(t, 0) for t, w in vectors[q].items()), 9), i) for i, v in vectors.items() if i != q]
        want += [(q, k, i) for k, (s, i) in enumerate(sorted((-s, i) for s, i in scores if s > 0)[:6], 1)]
    for size in (2048, 11):
        monkeypatch.setattr(tfidf, "DOCS", size)
        monkeypatch.setattr(tfidf, "QUERIES", size // 10 or 1)
        got = sorted((r.query_id, r.rank, r.id) for r in tfidf.sparse_top_k(weights, queries, 6).collect())
        assert got == want
    assert tfidf.sparse_top_k(weights.limit(0), queries, 6).count() == 0


def test_initial_dropout(spark):
    rows = spark.createDataFrame([(str(i), [1.0] * 50) for i in range(40)], "node string, vec array<double>")
    got = network.initial_dropout(rows, 0.2).collect()
    kept = [x for r in got for x in r.vec]
    assert set(kept) == {0.0, 1.25} and abs(kept.count(0.0) / len(kept) - 0.2) < 0.03
    assert got == network.initial_dropout(rows.repartition(3), 0.2).orderBy(F.col("node").cast("int")).collect()


def test_lemmas(spark):
    from lexweave.operators import tfidf

    terms = spark.createDataFrame([(1, "cats", 2), (1, "cat", 1), (2, "dog", 1), (2, None, 1)], "doc int, term string, tf int")
    lemmas = spark.createDataFrame([("cats", "cat"), ("cats", "feline"), ("x", "y")], "term string, lemma string")
    assert sorted((r.doc, str(r.term), r.tf) for r in tfidf.lemmatised(terms, lemmas).collect()) == [(1, "cat", 1), (1, "cat", 2), (2, "None", 1), (2, "dog", 1)]


def test_attention_kinds():
    rng = np.random.default_rng(4)
    x = rng.standard_normal((7, 8))
    assert explain.attention_reach(4, "causal").sum() == 10 and explain.attention_reach(4, "local", 2).sum() == 7
    with pytest.raises(ValueError):
        explain.attention_reach(3, "other")
    for options in ({"heads": 2}, {"attention": "causal"}, {"attention": ("causal", "local"), "window": 2, "layers": 3}, {"feed_forward": 16, "heads": 4}, {"pooling": "first", "upto": 1, "layers": 2}):
        model = explain.DetachedAttention(8, seed=1, **options)
        pooled, relevance = model(x)
        # No biases, and all that isn't linear is held constant: relevance sums to the features.
        assert np.allclose(relevance.sum(1), pooled, atol=1e-6), options
    # The first token of a causal encoder sees nothing but itself; with a window, a token sees no further back than layers reach.
    first = explain.DetachedAttention(8, 2, attention="causal", pooling="first")
    assert np.allclose(first(x)[0], first(np.vstack([x[:1], x[1:] * 3]))[0]) and np.abs(first(x)[1][:, 1:]).max() == 0
    one, full = explain.DetachedAttention(8, 1, heads=1), explain.DetachedAttention(8, 1, heads=2)
    assert not np.allclose(one(x)[0], full(x)[0])


def test_checkpoints_with_other_names(tmp_path):
    rng = np.random.default_rng(4)
    path = str(tmp_path / "w.npz")
    np.savez(path, **{"module.encoder.0.q": rng.standard_normal((4, 4)), "0.bias": np.ones(4), "module.encoder.0.up": rng.standard_normal((4, 6)), "module.encoder.0.down": rng.standard_normal((6, 4))})
    state = explain.load_state(path, (("module.encoder.", ""), ("module.", "x.")))
    assert sorted(state) == ["0.bias", "0.down", "0.q", "0.up"]
    model, x = explain.DetachedAttention(4), rng.standard_normal((3, 4))
    before = model(x)[0]
    model.load(state)
    assert (model.weights[0][0] == state["0.q"]).all() and not np.allclose(before, model(x)[0])
    with pytest.raises(KeyError):
        model.load({"0.other": x})
    with pytest.raises(ValueError):
        explain.load_state(path, (("module.encoder.0.q", "0.bias"),))


def test_long_tokenizer(spark):
    docs = spark.createDataFrame([(1, "a b c"), (2, None), (3, "w " * 300)], "doc_id int, text string")
    long = encoders.LongTokenizer(encoders.word_tokenizer(), max_document_tokens=100, max_chunk_tokens=32)
    ids = {r.doc_id: r.ids for r in long.ids(docs, "text").collect()}
    assert [len(ids[i]) for i in (1, 2, 3)] == [4, 1, 101] and all(x[0] == encoders.CLS and min(x[1:], default=999) > encoders.CLS for x in ids.values())
    rows = long.chunks(docs, "text", ["doc_id"]).collect()
    assert max(len(r.ids) for r in rows) == 32 and {r.doc_id for r in rows} == {1, 2, 3} and sum(r.doc_id == 3 for r in rows) > 3
    import public_tokenizers

    path = public_tokenizers.path("word_bpe_49k.json")
    assert len(encoders.LongTokenizer(encoders.file_tokenizer(path)).ids(docs, "text").where("doc_id = 1").first().ids) == 4


def test_encoding_keeps_order_and_takes_one_text(spark):
    lengths = []

    def factory():
        return lambda texts: np.array([[len(x), texts.index(x)] for x in texts], float)

    docs = spark.createDataFrame([(i, "x" * n) for i, n in enumerate([3, 9, 1, 7, 0])], "i int, text string").coalesce(1)
    got = encoders.encode(docs, "text", factory, batch=2).orderBy("i").collect()
    assert [r.embedding for r in got] == [[3, 0], [9, 0], [1, 1], [7, 1], [0, 0]] and not lengths
    assert encoders.encode_texts(spark, "one", encoders.hashing_encoder(4)).count() == 1 and encoders.encode_texts(spark, ["a", "b"], encoders.hashing_encoder(4)).count() == 2


def test_groups_that_meet_are_few_and_miss_nothing(spark, monkeypatch):
    """A row is copied once a group, and groups stay SPREAD until they are full, however many blocks of rows there are."""
    rng = np.random.default_rng(11)
    x = rng.standard_normal((90, 4)).round(1)
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "i long, v array<double>")
    table = search.index(rows, "i", "v")
    monkeypatch.setattr(search, "BLOCK", 3)
    assert [search.groups_of(table, held, 3) for held in (90, 20, 5)] == [8, 8, 18] and search.groups_of(table) == 1
    monkeypatch.setattr(search, "groups_of", lambda rows, *_: 4)
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    got = {(r.query_id, r["rank"]): r.id for r in search.top_k(table.where("id < 20"), table, 5).collect()}
    for q in range(20):
        s = np.round(unit @ unit[q], 12)
        assert [got[q, k] for k in range(1, 6)] == [i for i in sorted(range(90), key=lambda i: (-s[i], i)) if i != q][:5]
    e = np.exp(unit @ unit.T / 0.5)
    want = np.mean(-np.log(np.diag(e) / e.sum(1)))
    assert network.contrast_loss_blocks(table, table).first().loss == pytest.approx(want, abs=1e-7)


def test_best_keeps_ties_of_the_first_columns():
    best = search.Best(2, 2, 6)
    for first, scores in ((0, [[1.0, 2.0, 2.0], [np.nan, -np.inf, 0.0]]), (3, [[2.0, 2.00000001, 3.0], [5.0, 0.0, 0.0]]), (6, [[3.0], [1.0]])):
        best.add(np.array(scores), first)
    assert best.rows.tolist() == [0, 0, 1, 1] and best.cols.tolist() == [5, 6, 3, 6]


def test_relevance_by_blocks_equals_joins(spark, monkeypatch):
    """Blocks of tokens, pairs that share no feature, repeated and null entries; and no row of pairs in a shuffle."""
    rng = np.random.default_rng(2)
    rows = [(int(p), int(f), int(t), None if t == 5 else float(x)) for p, f, t, x in zip(rng.integers(0, 2, 150), rng.integers(0, 40, 150), rng.integers(0, 9, 150), rng.standard_normal(150))]
    a, b = (spark.createDataFrame(r + [(None, 1, 1, 1.0)], "p int, feature int, token int, r double") for r in (rows[:75], rows[75:]))
    monkeypatch.setattr(explain, "TOKENS", 4)
    as_dict = lambda d: {(r.p, r.i, r.j): r.relevance for r in d.collect()}
    got, want = as_dict(explain.contracted(a, b, ["p"])), as_dict(explain.normalised(explain.contract(a, b, ["p"]), ["p"]))
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(x, abs=1e-12) if x is not None else got[k] is None for k, x in want.items())
    assert "Aggregate" not in explain.contracted(a, b, ["p"])._jdf.queryExecution().executedPlan().toString()
    side = [(1, t, rng.standard_normal(3).tolist()) for t in range(11)]
    x, y = spark.createDataFrame(side, "p int, token int, vec array<double>"), spark.createDataFrame([(1, 99, None)] + side[:3], "p int, token int, vec array<double>")
    m = np.array([s[2] for s in side]) @ np.array([s[2] for s in side[:3]]).T
    got = as_dict(explain.embedding_relevance(x, y, ["p"]))
    assert len(got) == 44 and got[1, 4, 99] is None and got[1, 7, 2] == pytest.approx((m * m / (m * m).max())[7, 2])


def test_every_row_is_a_query_of_the_fusion(spark, data):
    from lexweave.plans import catalogue

    got = {r.query_id for r in catalogue.QUERIES["rrf_fusion"](spark, data).select("query_id").distinct().collect()}
    vectors = {r.vec_id for r in spark.read.parquet(f"{data}/embeddings.parquet").where("embedding is not null").select("vec_id").collect()}
    assert vectors <= got and any(q % catalogue.EVERY for q in got)


def test_few_queries_do_not_copy_the_corpus():
    assert search.lean_groups(12_000, 600_000, 1 << 15, (256, 2048), 24) == (1, 24)
    for n, m in ((0, 0), (200, 10_000), (10_000, 10_000), (72_000, 3_600_000)):
        a, b = search.lean_groups(n, m, 1 << 15, (256, 2048), 24)
        assert a * (1 << 15) >= n and b * (1 << 15) >= m and a >= 1 and b >= 1


def test_relevance_deals_tokens_not_their_features(spark, monkeypatch):
    dealt = []
    monkeypatch.setattr(explain, "_met", lambda left, right, by, compute: dealt.extend((left, right)))
    rows = spark.createDataFrame([("p", t, f, float(f)) for t in range(3) for f in range(8)], "pair string, token long, feature int, r double")
    explain.contracted(rows, rows, ["pair"])
    assert [x.count() for x in dealt] == [3, 3]

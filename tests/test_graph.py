from lexweave.operators import graph as G


def edges(spark, *pairs):
    return spark.createDataFrame(list(pairs) or [("", "")], "source string, target string").where("source <> ''")


def ids(spark, *names):
    return spark.createDataFrame([(n,) for n in names], "id string")


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_neighbourhood_reports_the_source_on_a_cycle(spark):
    e = edges(spark, ("a", "b"), ("b", "c"), ("c", "a"), ("c", "d"))
    assert rows(G.neighbourhood(e, ids(spark, "a"), 3, 0)) == [("a", x) for x in "abcd"]
    assert rows(G.neighbourhood(e, ids(spark, "d"), 1, 2)) == [("d", "b"), ("d", "c")]
    assert rows(G.neighbourhood(e, ids(spark, "d"), 0, 0)) == []


def test_hierarchy(spark):
    codes = spark.createDataFrame([(c,) for c in ("01", "01.10", "01.10.20", "02.10", "abc", "01.10")], "code string")
    nodes, got = G.code_hierarchy(codes)
    assert rows(got) == [("01", "01.10"), ("01.10", "01.10.20")] and nodes.count() == 4


def test_index_and_encode(spark):
    g = G.typed_graph(edges(spark, ("61", "31"), ("61", "62"), ("61", "31"), ("31", "11"), ("69", "31")), edges(spark, ("61", "S"), ("31", "S")), ids(spark, "61", "62"), ids(spark, "31", "11"))
    assert g.count() == 8
    index = G.dense_index(G.nodes_of(g))
    assert rows(index) == [("case", "61", 0), ("case", "62", 1), ("legislation", "11", 0), ("legislation", "31", 1), ("subject_matter", "S", 0)]
    assert G.encode(g, index).count() == g.count()


def test_metapaths_are_symmetric_and_distinct(spark):
    g = G.typed_graph(edges(spark, ("61", "31"), ("62", "31"), ("61", "32"), ("62", "32"), ("31", "32")), edges(spark), ids(spark, "61", "62"), ids(spark, "31", "32"))
    clc = [("case", "cites", "legislation"), ("legislation", "cited_by", "case")]
    assert rows(G.metapath_pairs(g, clc)) == [(a, b) for a in ("61", "62") for b in ("61", "62")]
    longer = [clc[0], ("legislation", "cites", "legislation"), clc[1]]
    assert rows(G.metapath_pairs(g, longer)) == [(a, b) for a in ("61", "62") for b in ("61", "62")]


def test_walks_follow_edges_and_repeat(spark):
    nodes, simple = G.judgment_graph(edges(spark, ("61", "31"), ("62", "31"), ("61", "32"), ("63", "64")), edges(spark, ("61", "S")), ids(spark, "61", "62", "63", "64"))
    got = rows(G.walks(nodes, simple, ["case", "legislation", "case"], 3))
    assert got == rows(G.walks(nodes, simple, ["case", "legislation", "case"], 3))
    near = {tuple(sorted(r)) for r in rows(simple)}
    for start, _, path in got:
        assert path[0] == start and all(tuple(sorted(x)) in near for x in zip(path, path[1:]))
    assert {len(p) for s, _, p in got if s in ("63", "64")} == {1}


def test_paragraph_graph_types_every_node(spark):
    pa = spark.createDataFrame([("1_61", "Article 1"), ("2_61", "Article 1"), ("1_62", "Article 2")], "paragraph string, article string")
    al = spark.createDataFrame([("Article 1", "39")], "article string, legislation string")
    nodes, simple = G.paragraph_graph(edges(spark, ("61", "62"), ("61", "31"), ("61", "11")), pa, al, ids(spark, "61", "62"))
    assert dict(rows(nodes)) == {"1_61": "paragraph", "2_61": "paragraph", "1_62": "paragraph", "Article 1": "article", "Article 2": "article", "31": "legislation", "39": "legislation"}
    assert simple.count() == 2 + 2 + 3 + 1
    assert G.uses_paragraphs([["paragraph", "article"]]) and not G.uses_paragraphs([["case"]])


def test_sampling(spark):
    e = edges(spark, ("a", "t"), ("b", "t"), ("c", "u"))
    got = rows(G.sampled_in_edges(e, 2))
    assert len(got) == 4 and {r[:2] for r in got} <= {("a", "t"), ("b", "t"), ("c", "u")} and got == rows(G.sampled_in_edges(e, 2))


def test_numbering_spreads_a_hub(spark):
    e = edges(spark, *[(f"s{i:03d}", "hub") for i in range(300)], ("a", "t"), ("b", "t"))
    spark.conf.set("spark.sql.shuffle.partitions", "7")
    try:
        got = G.numbered(e.select("target", "source"), ["target"], "source").collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert sorted((r.pos, r.source) for r in got if r.target == "hub") == [(i, f"s{i:03d}") for i in range(300)]
    assert {r.degree for r in got if r.target == "hub"} == {300} and sorted((r.pos, r.source, r.degree) for r in got if r.target == "t") == [(0, "a", 2), (1, "b", 2)]


def test_whole_graph_has_the_rows_of_typed_graph_and_reads_each_table_once(spark):
    cited = edges(spark, ("61", "31"), ("61", "62"), ("61", "31"), ("31", "11"), ("69", "31"), ("61", "39"), ("62", "69"), ("31", "61"), ("S", "61"), ("62", None), (None, "61"))
    topics = edges(spark, ("61", "S"), ("31", "S"), ("39", "S"), ("69", "S"), ("61", "S"), ("61", "62"), ("62", None))
    cases, acts = ids(spark, "61", "62", "62", "31"), ids(spark, "31", "11", "61")
    key = lambda g: sorted(map(str, g.collect()))
    for lists in ((cases, acts), (cases, None), (None, acts), (None, None)):
        for reverse in (True, False):
            assert key(G.whole_graph(cited, topics, *lists, reverse)) == key(G.typed_graph(cited, topics, *lists, reverse))
    table = spark.range(9).selectExpr("concat('6', id) source", "concat('3', id) target")
    plan = G.whole_graph(table, table, cases, None)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Range (") == 2


def test_walks_number_only_the_neighbours_they_may_take(spark, monkeypatch):
    kept, settle = [], G.settle
    monkeypatch.setattr(G, "settle", lambda df, name: kept.append((name, settle(df, name))) or kept[-1][1])
    nodes, simple = G.judgment_graph(edges(spark, ("61", "31"), ("62", "31"), ("61", "62"), ("31", "32")), edges(spark, ("61", "S")), ids(spark, "61", "62"))
    assert len(rows(G.walks(nodes, simple, ["case", "legislation", "case"], 1))) == 2
    assert rows(dict(kept)["neighbours"].select("node", "nbr")) == [("31", "61"), ("31", "62"), ("61", "31"), ("62", "31")]


def test_hubs_are_numbered_as_other_groups_are(spark, monkeypatch):
    e = edges(spark, *[(f"s{i:03d}", "hub") for i in range(50)], *[(f"s{i:03d}", "other") for i in range(40)], ("a", "t"), ("b", "t")).select("target", "source")
    whole = rows(G.numbered(e, ["target"], "source"))
    monkeypatch.setattr(G, "HUB", 39)
    assert rows(G.numbered(e, ["target"], "source")) == whole and len(whole) == 92


def test_reversed_edges_are_made_from_forward_ones_that_were_written(spark):
    cited, topics = edges(spark, ("61", "31"), ("61", "62"), ("31", "11")), edges(spark, ("61", "S"), ("31", "S"))
    lists = ids(spark, "61", "62"), ids(spark, "31", "11")
    forward = G.settle(G.whole_graph(cited, topics, *lists, reverse=False), "forward")
    assert forward.count() == 5 and rows(G.with_reversed(forward)) == rows(G.typed_graph(cited, topics, *lists))


def test_walk_checks_write_no_walks(spark, data, monkeypatch):
    from lexweave.plans import catalogue, scans

    def no(df, name):
        raise AssertionError(name)

    monkeypatch.setattr(scans, "settle", no)
    assert catalogue.QUERIES["walk_checks"](spark, data).where("walks <> 2 or strays > 0").count() == 0


def test_joins_deal_large_tables_into_parts(spark, monkeypatch):
    """With few rows a part the same rows come, from as many parts as the rows ask for and without a list that is sent to every task."""
    table = lambda rows: spark.createDataFrame(rows, "source string, target string")
    cited = table([("61", "31"), ("61", "31"), ("62", "31"), ("62", "62"), ("69", "31"), ("62", "39"), ("31", "32"), (None, "31"), ("61", None)])
    topics = table([("61", "S"), ("61", "S"), ("31", "T"), ("39", "T")])
    cases, acts = (spark.createDataFrame([(i,) for i in ids], "id string") for ids in (["61", "62", "62", None], ["31", "32", "31"]))
    paras = spark.createDataFrame([("61", "61_1"), ("61", "61_2"), ("61", "61_2"), ("62", "62_1"), (None, "x")], "doc string, para string")
    rows = lambda d: sorted(map(tuple, d.collect()))
    for cut in ((cases, acts), (cases, None), (None, None)):
        assert rows(G.typed_graph(cited, topics, *cut, parts=5)) == rows(G.typed_graph(cited, topics, *cut)) == rows(G.whole_graph(cited, topics, *cut, parts=5))
        nodes = rows(G.nodes_of(G.whole_graph(cited, topics, *cut)))
        assert rows(G.nodes_of(G.whole_graph(cited, topics, *cut, reverse=False, parts=5, repeats=True))) == nodes
    edges = G.citation_edges(cited, G.FORWARD[1], cases, acts, 5)
    got = G.paragraph_legislation(edges, G.within(paras, cases, "doc", 5), 5)
    assert rows(got) == [("61_1", "31"), ("61_2", "31"), ("62_1", "31")]
    got.collect()
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Broadcast" not in plan and got.rdd.getNumPartitions() == 5
    monkeypatch.setattr(G, "DEALT", 1)
    assert G.parts_of(cited) == 9 and G.parts_of(cited, 4) == 0
    monkeypatch.setattr(G, "FEW", 2)
    hinted = lambda d: "Hint merge" in G.listed(d)._jdf.queryExecution().logical().toString()
    assert hinted(acts) and not hinted(acts.limit(2))

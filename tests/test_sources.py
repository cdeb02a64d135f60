import json

from pyspark.sql import functions as F

from lexweave.sources import endpoint, landed
from lexweave.streaming import edges as streaming


def fake(url, query):
    """Transport that answers without a network."""
    lo = int(query.split()[-1])
    return json.dumps({"results": {"bindings": [{"source": {"value": f"6{lo}"}, "target": {"value": "http://x/S1"}}, {"source": {"value": f"3{lo}"}}]}})


def test_endpoint(spark):
    spark.dataSource.register(endpoint.EndpointSource)
    got = spark.read.format("sparql_endpoint").options(endpoint="http://none", query="range {lo}", columns="source,target", partitions="3", lo="0", hi="30", transport="tests.test_sources:fake").load()
    assert sorted(tuple(r) for r in got.where("target is not null").collect()) == [("60", "http://x/S1"), ("610", "http://x/S1"), ("620", "http://x/S1")]
    assert landed.edges_of_sector(got, "6").select("target").distinct().first()[0] == "S1"


def echo(url, query):
    """Answers with the query itself."""
    return json.dumps({"results": {"bindings": [{"source": {"value": 'a"b'}, "target": {"value": query}}]}})


def test_filters_go_into_the_query(spark):
    spark.dataSource.register(endpoint.EndpointSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    try:
        options = {"endpoint": "http://none", "columns": "source,target", "transport": "tests.test_sources:echo"}
        got = spark.read.format("sparql_endpoint").options(**options, query="all {filters}").load().where(F.col("source") == 'a"b')
        assert [r.target for r in got.collect()] == ['all FILTER(STR(?source) = "a\\"b")']
        kept = spark.read.format("sparql_endpoint").options(**options, query="all").load().where(F.col("source") == "zzz")
        assert kept.count() == 0
    finally:
        spark.conf.unset("spark.sql.python.filterPushdown.enabled")


def test_fetcher(spark):
    got = endpoint.fetched(spark.createDataFrame([("http://a/b/62000CJ0001",), ("X 1",)], "celex string"), "base/", get=lambda u: u.encode())
    lost = endpoint.fetched(spark.createDataFrame([(None,), ("a",)], "celex string"), "base/", get=lambda u: None)
    assert {(r.celex, r.body) for r in lost.collect()} == {(None, None), ("a", None)}
    assert {r.celex: bytes(r.body) for r in got.collect()} == {"62000CJ0001": b"base/62000CJ0001", "X 1": b"base/X%201"}


def test_an_answer_is_tried_for(monkeypatch):
    import io
    import urllib.request

    tries = []

    def open_(request, timeout):
        tries.append(timeout)
        if len(tries) < 3:
            raise TimeoutError
        return io.BytesIO(b"page")

    monkeypatch.setattr(urllib.request, "urlopen", open_)
    monkeypatch.setattr(endpoint.time, "sleep", lambda s: None)
    assert endpoint.fetch("http://none/x") == b"page" and len(tries) == 3
    tries[:] = [0] * -9
    monkeypatch.setattr(urllib.request, "urlopen", lambda request, timeout: (_ for _ in ()).throw(ConnectionRefusedError()))
    assert endpoint.fetch("http://none/x") is None


def test_superseded_tables_go(spark, tmp_path):
    from lexweave.storage import discard, settle

    kept, gone = settle(spark.range(3).toDF("x"), "kept"), settle(spark.range(4).toDF("x"), "gone")
    outside = str(tmp_path / "mine")
    spark.range(2).write.parquet(outside)
    files = gone.inputFiles()
    discard(gone, spark.read.parquet(outside))
    import os

    assert kept.count() == 3 and not any(os.path.exists(f.removeprefix("file://")) for f in files) and spark.read.parquet(outside).count() == 2


def test_landed(spark, tmp_path):
    docs = spark.createDataFrame([("61", "6", "2001", "JUDG", "CJ", "REFER_PREL"), ("61", "6", "2001", "JUDG", "CJ", "REFER_PREL"), ("62", "6", "2002", "JUDG", "TJ", "OTHER"), ("63", "6", "2002", "JUDG", "CJ", None), ("31", "3", "2002", None, None, None), ("32", "3", None, None, None, None)], "id string, sector string, year string, form string, type string, procedure string")
    ids = lambda d: sorted(r.id for r in d.collect())
    assert ids(landed.judgments(docs)) == ["61"] and ids(landed.judgments(docs, preliminary_ruling=False)) == ["61", "62"]
    assert ids(landed.judgments(docs, preliminary_ruling=False, limit=1)) == ["61"] and ids(landed.judgments(docs, limit=0)) == ["61"]
    assert ids(landed.legislation(docs)) == ["31"] and ids(landed.legislation(docs, year="1999")) == [] and ids(landed.ids_of_sector(docs, "3")) == ["31", "32"]
    edges = landed.inline_edges(spark, [("61", "u/S1"), ("61", "u/S1"), ("61", "S2"), ("62", "31"), ("62", "99")])
    assert sorted(r.code for r in landed.codes_of(edges, "61").collect()) == ["S1", "S2"]
    assert landed.edges_of_sector(edges, "6", docs).collect() == [("62", "31")]
    (tmp_path / "t.json").write_text(json.dumps({"61": "Case C-1/22 title title", "62": "b"}))
    titles = landed.read_titles(spark, str(tmp_path / "t.json"))
    assert landed.title_of(titles, "61") == "title" and landed.title_of(titles, "zz") is None
    (tmp_path / "e.json").write_text(json.dumps({"results": {"bindings": []}}))
    assert landed.read_bindings(spark, str(tmp_path / "e.json"), "s", "t").columns == ["source", "target"]
    (tmp_path / "c.csv").write_text("id,citations,Articles/Decision\n1_61,\"['62']\",\"[('Article 1', '31'), ('Article 2', '32')]\"\n")
    pa, al = landed.read_paragraph_citations(spark, str(tmp_path / "c.csv"))
    assert sorted(tuple(r) for r in al.collect()) == [("Article 1", "31"), ("Article 2", "32")] and pa.count() == 2
    (tmp_path / "x.xml").write_text('<r xmlns:rdf="u"><rdf:Description rdf:about="http://x/01.10"/><rdf:Description rdf:about="http://x/01"/></r>')
    assert sorted(r.code for r in landed.read_codes(spark, str(tmp_path / "x.xml")).collect()) == ["01", "01.10"]
    label = '<a><p xml:lang="fr">non</p><prefLabel xml:lang="en">Waste</prefLabel></a>'
    assert spark.createDataFrame([(label,)], "x string").select(landed.subject_label("x")).first()[0] == "Waste"
    (tmp_path / "pages").mkdir()
    (tmp_path / "pages" / "61.html").write_bytes(b"<p>")
    assert landed.read_pages(spark, str(tmp_path / "pages")).select("celex", F.length("body")).first() == ("61", 3)
    landed.write_checkpoint(edges, str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out")).count() == 5


def test_streamed_edges(spark, tmp_path):
    landing, table = str(tmp_path / "in"), str(tmp_path / "edges")
    for rows in ([("a", "b"), ("a", "b")], [("a", "b"), ("b", "c")]):
        landed.inline_edges(spark, rows).coalesce(1).write.mode("append").parquet(landing)
        streaming.append_edges(streaming.landed(spark, landing), table, str(tmp_path / "check")).awaitTermination()
    assert sorted(tuple(r) for r in spark.read.parquet(table).collect()) == [("a", "b"), ("b", "c")]

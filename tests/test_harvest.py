"""A harvest through a transport that answers from a file and fails midway."""

import json
import re
from pathlib import Path

import pytest

from lexweave.sources import harvest

ESCAPED = r'"((?:[^"\\]|\\.)*)"'


def unescaped(x):
    return re.sub(r"\\(.)", lambda m: {"n": "\n", "r": "\r"}.get(m[1], m[1]), x)


def answer(url, query):
    """Answers the queries that harvest makes from the rows in url/rows; where url/fail holds a number, that many answers come before one fails, once."""
    place = Path(url)
    with (place / "asked").open("a") as log:
        log.write(query + "\n")
    fail = place / "fail"
    if fail.exists() and len((place / "asked").read_text().splitlines()) > int(fail.read_text()):
        fail.unlink()
        raise TimeoutError("no answer")
    rows = [tuple(r) for r in json.loads((place / "rows").read_text())]
    if (m := re.search(rf"FILTER\(STR\(\?source\) > {ESCAPED}\)", query)) is not None:
        rows = [r for r in rows if r[0] > unescaped(m[1])]
    elif (m := re.search(rf"STR\(\?source\) = {ESCAPED} && STR\(\?target\) > {ESCAPED}", query)) is not None:
        rows = [r for r in rows if r > (unescaped(m[1]), unescaped(m[2]))]
    if (m := re.search(rf"STR\(\?source\) <= {ESCAPED}", query)) is not None:
        rows = [r for r in rows if r[0] <= unescaped(m[1])]
    if "MAX(" in query:
        return made([{"key": max(r[0] for r in rows)}] if rows else [{}])
    if "AS ?key" in query:
        return made([{"key": k} for k in sorted({r[0] for r in rows})[int(re.search(r"OFFSET (\d+)", query)[1]) :][:1]])
    return made([{"source": a, "target": b} for a, b in sorted(set(rows))[: int(re.search(r"LIMIT (\d+)", query)[1])]])


def made(rows):
    return json.dumps({"results": {"bindings": [{k: {"value": v} for k, v in r.items()} for r in rows]}})


@pytest.fixture
def source(spark, tmp_path):
    spark.dataSource.register(harvest.Harvest)
    rows = [(f"6{i:03}", f"3{j}") for i in range(40) for j in range(i % 4 + 1)] + [("6007", f"hub {j:02}") for j in range(25)] + [('6"\\quote', "3\nx")]
    (tmp_path / "rows").write_text(json.dumps(rows))
    options = harvest.question("citations", sector="6") | {"endpoint": str(tmp_path), "transport": "tests.test_harvest:answer", "keys": "6", "rows": "7"}
    return tmp_path, rows, options


def test_a_batch_has_every_row_once(spark, source):
    place, rows, options = source
    got = spark.read.format("sparql_harvest").options(**options).load()
    assert sorted(tuple(r) for r in got.collect()) == sorted(rows)
    asked = (place / "asked").read_text()
    assert 'FILTER(?c0 IN ("6"^^xsd:string))' in asked and "cdm:work_cites_work/cdm:resource_legal_id_celex ?target" in asked
    (place / "rows").write_text("[]")
    assert spark.read.format("sparql_harvest").options(**options).load().count() == 0


def test_a_stream_that_fails_midway_and_goes_on(spark, source):
    place, rows, options = source

    def run():
        stream = spark.readStream.format("sparql_harvest").options(**options).load()
        query = stream.writeStream.format("parquet").option("path", str(place / "out")).option("checkpointLocation", str(place / "check")).trigger(availableNow=True).start()
        query.awaitTermination()

    (place / "fail").write_text("14")
    with pytest.raises(Exception, match="no answer"):
        run()
    assert not (place / "fail").exists()
    run()
    got = spark.read.parquet(str(place / "out"))
    assert sorted(tuple(r) for r in got.collect()) == sorted(rows)
    rows += [("7001", "31"), ("7002", "32")]
    (place / "rows").write_text(json.dumps(rows))
    before = len((place / "asked").read_text().splitlines())
    run()
    assert sorted(tuple(r) for r in spark.read.parquet(str(place / "out")).collect()) == sorted(rows)
    assert len((place / "asked").read_text().splitlines()) - before < 8


def test_questions():
    made_ = harvest.Question(harvest.question("judgments", year="2010", preliminary_ruling=True) | {"endpoint": "x"})
    query = made_._query("?celex", [], "")
    for part in ('"2010"^^xsd:gYear', '"CJ"^^xsd:string, "TJ"^^xsd:string', "procjur/REFER_PREL>", "resource-type/JUDG>"):
        assert part in query
    assert harvest.quoted('a"b^^xsd:string') == '"a\\"b"^^xsd:string' and harvest.quoted("http://x> } #") == '"http://x> } #"'

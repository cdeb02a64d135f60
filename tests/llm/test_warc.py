import base64
import gzip
import hashlib
import io
import json
import zlib

import duckdb
import pytest

from lexweave.llm import warc

from ..oracle import compare


def test_normaliser_members_stand_alone():
    records = [warc.record(i, f"http://x/{i}", b"p" * n + b"\r\n\r\nWARC/1.1\r\n") for i, n in enumerate((0, 5, 70_000, 3))] + [warc.record(9, None, b"y" * 2000, 4, True)]
    whole = gzip.compress(b"".join(records))
    for raw in (whole, gzip.compress(b"".join(records[:2])) + gzip.compress(b"".join(records[2:]))):
        out = io.BytesIO()
        index = list(warc.normalise(io.BytesIO(raw), out))
        data = out.getvalue()
        assert [zlib.decompress(data[x["offset"] : x["offset"] + x["length"]], warc.GZIP) for x in index] == records
        assert sum(x["length"] for x in index) == len(data) and index[-1]["type"] == "revisit"
    fields, http, body = warc.read_member(data[index[2]["offset"] :][: index[2]["length"]])
    assert body == b"p" * 70_000 + b"\r\n\r\nWARC/1.1\r\n" and base64.b32decode(fields["warc-payload-digest"][5:]) == hashlib.sha1(body).digest()


def test_normaliser_refuses_what_is_cut_off():
    raw = gzip.compress(warc.record(1, "u", b"x" * 5000))
    for bad in (raw[:-20], gzip.compress(warc.record(1, "u", b"x" * 50)[:-10]), gzip.compress(b"no archive")):
        with pytest.raises((ValueError, zlib.error)):
            list(warc.normalise(io.BytesIO(bad), io.BytesIO()))
    assert list(warc.normalise(io.BytesIO(b""), io.BytesIO())) == []


@pytest.mark.parametrize("broadcast", [200_000, 0])
def test_archives(spark, monkeypatch, broadcast, tmp_path):
    monkeypatch.setattr(warc, "BROADCAST_GROUPS", broadcast)
    monkeypatch.setattr(warc, "ARCHIVE_BYTES", 5000)
    long, short = "é" * 600, "s" * 999
    rows = [(1, "u1", long), (7, "u\r\n2", long), (3, None, long), (4, "u", short), (5, "u", short), (6, "u", None), (8, "u", ""), (9, "u", long + "."), (10, "u", "b" * 1000), (11, "u", "b" * 1000)]
    rows += [(20 + i, "u", "hot" * 400) for i in range(40)]
    pages = spark.createDataFrame([(*r, "digest") for r in rows], "page_id long, url string, html string, digest string")
    index, root = warc.archive(pages)
    got = sorted(tuple(r) for r in warc.read(index, root).collect())
    con = duckdb.connect()
    con.execute("CREATE TABLE pages(page_id BIGINT, url VARCHAR, html VARCHAR)")
    con.executemany("INSERT INTO pages VALUES (?, ?, ?)", rows)
    assert got == sorted((str(a), b, c, d, None if e is None else str(e)) for a, b, c, d, e in con.sql(warc.OP6_SQL).fetchall())
    lines = [json.loads(x) for p in {r["index"] for r in index.collect()} for x in open(p)]
    assert len(lines) == len(rows) and {r.offset for r in index.collect()} == {x["offset"] for x in lines}


def test_edges(spark):
    long = "z" * 2000
    pages = spark.createDataFrame([(None, "u", long), (None, "u", long), (2, "u", long), (2, "u", long)], "page_id long, url string, html string")
    index, root = warc.archive(pages)
    assert sorted((str(r.ident), r.record_type, str(r.refers_to)) for r in warc.read(index, root).collect()) == [("2", "response", "None")] * 2 + [("None", "revisit", "2")] * 2
    index, root = warc.archive(pages.limit(0))
    assert warc.read(index, root).count() == 0


def test_query(spark, data):
    compare(spark, data, warc.op6_warc, warc.OP6_SQL)

"""Compares a query with its SQL in DuckDB."""

import glob
import os

import duckdb


def rows(values):
    return sorted(tuple(repr(round(x, 9)) if isinstance(x, float) else repr(x) for x in r) for r in values)


def compare(spark, sf_dir, run, sql):
    con = duckdb.connect()
    for p in glob.glob(f"{sf_dir}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    got = run(spark, sf_dir)
    want = con.sql(sql)
    names = sorted(got.columns)
    assert names == sorted(want.columns)
    order = ", ".join(f'"{n}"' for n in names)
    assert rows(tuple(r) for r in got.select(*names).collect()) == rows(con.sql(f"SELECT {order} FROM ({sql})").fetchall())

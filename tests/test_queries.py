"""Every registered query of the document network runs; those with SQL agree with it."""

import pytest

from lexweave.plans import catalogue

from .oracle import compare


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query(spark, data, name):
    if name in catalogue.ORACLE:
        compare(spark, data, catalogue.QUERIES[name], catalogue.ORACLE[name])
    else:
        got = catalogue.QUERIES[name](spark, data)
        assert got.columns and got.count() >= 0


def test_entry(spark, data):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())

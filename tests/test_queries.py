"""Every grid query against its SQL in DuckDB."""

import pytest

from gridframe import queries


@pytest.mark.parametrize("name", list(queries.QUERIES))
def test_query(spark, sf, same_as_sql, name):
    df = queries.QUERIES[name](spark, sf)
    if name in queries.ORACLES:
        same_as_sql(df, queries.ORACLES[name])
    else:
        assert df.count() == 10


def test_entry(spark, sf):
    assert queries.entry(spark, sf).count() == 5


def test_driver_contract():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
    assert set(queries.QUERIES) <= set(e.queries())

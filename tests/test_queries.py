"""Every registered query against its SQL on the smallest corpus."""

import pytest

import __spark_entry__ as entry
from check import compare, duck

SF, LARGER = "/root/testdata/sf0.001", "/root/testdata/sf0.01"
QUERIES, SQL = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return duck(SF)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    message, some = compare(spark, con, name, QUERIES[name], SQL.get(name), SF)
    if "rows=0" in message:  # nothing to show at the smallest scale
        message, some = compare(spark, duck(LARGER), name, QUERIES[name], SQL.get(name), LARGER)
    assert some and ("equal" in message or "no sql" in message), message


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_sql_has_a_query():
    assert set(SQL) <= set(QUERIES)

"""Every query with SQL must equal DuckDB on the smallest tables; the others must return rows."""

import os

import pytest
from check_oracle import compare, connect

import __spark_entry__ as entry

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_matches_sql(spark, con, name):
    got = entry.queries()[name](spark, SF).toPandas()
    assert compare(got, con.sql(entry.oracle_sql()[name]).df()) == "ok"


@pytest.mark.parametrize("name", sorted(set(entry.queries()) - set(entry.oracle_sql())))
def test_returns_rows(spark, name):
    assert entry.queries()[name](spark, SF).count() > 0


def test_entry(spark):
    assert entry.entry(spark).count() == 4

"""Every registered query against its SQL, at the smallest scale."""

from pathlib import Path

import pytest

import __spark_entry__ as registered
from checks.compare import connect, difference

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(SF).exists(), reason="no test data")


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", registered.queries())
def test_query(spark, con, name):
    df = registered.queries()[name](spark, SF)
    sql = registered.oracle_sql().get(name)
    assert difference(df, con, sql) is None if sql else df.count() >= 1


def test_every_sql_has_a_query():
    assert set(registered.oracle_sql()) <= set(registered.queries())


def test_entry(spark):
    levels = {r["level"] for r in registered.entry(spark).collect()}
    assert {"ERROR", "PURCHASE", "WARNING", "INFO", "DEBUG"} <= levels

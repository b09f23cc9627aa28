"""Every named query runs; those with SQL agree with it."""

import pytest
from compare import differences, duck

import __spark_entry__ as registry

QUERIES, SQL = registry.queries(), registry.oracle_sql()


@pytest.fixture(scope="module")
def con(data):
    return duck(data)


def test_every_sql_has_a_query():
    assert set(SQL) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(SQL))
def test_agrees_with_sql(spark, data, con, name):
    assert differences(QUERIES[name](spark, data), con, SQL[name]) == ""


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_runs(spark, data, name):
    assert QUERIES[name](spark, data).count() > 0


def test_the_comparison_notices_a_wrong_value(spark, con):
    wrong = spark.sql("SELECT 1 AS a, 2.0D AS b")
    assert differences(wrong, con, "SELECT 1 AS a, 2.0::DOUBLE AS b") == ""
    assert "only here" in differences(wrong, con, "SELECT 1 AS a, 2.5::DOUBLE AS b")
    assert "columns" in differences(wrong, con, "SELECT 1 AS a, 2.0::DOUBLE AS c")
    assert "types" in differences(wrong, con, "SELECT 1 AS a, '2.0' AS b")


def test_entry(spark):
    assert registry.entry(spark).columns == ["category", "sales", "profit"]

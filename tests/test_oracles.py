"""Every registered query against its SQL counterpart, all rows."""

import pytest
from compare import TESTDATA, connect, difference

import __spark_entry__ as entry
from vakanz.plans import oracles, registered

FOLDER = f"{TESTDATA}/sf0.001"
QUERIES, ORACLES = registered.queries(), oracles.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return connect(FOLDER)


def test_every_query_has_a_counterpart():
    assert set(QUERIES) == set(ORACLES)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    same_columns, only_spark, only_sql, rows = difference(
        QUERIES[name](spark, FOLDER), con, ORACLES[name]
    )
    assert same_columns
    assert (not only_spark, not only_sql) == (True, True), (
        list(only_spark)[:3],
        list(only_sql)[:3],
    )
    assert rows > 0


def test_entry(spark):
    assert entry.entry(spark).columns == ["intent", "term", "cnt", "rnk"]

"""Every registered query gives the rows, columns and types its SQL gives on an independent engine."""

import compare
import pytest

import __spark_entry__ as contract
from forecourt.plans import oracle, registry

QUERIES, SQL = registry.queries(), oracle.oracle_sql()


def test_every_query_has_sql():
    assert set(QUERIES) == set(SQL)


def test_every_query_is_registered():
    assert set(QUERIES) <= set(contract.queries()) and set(SQL) <= set(contract.oracle_sql())


@pytest.fixture(scope="module")
def connection(testdata):
    return compare.connect(testdata)


@pytest.mark.parametrize("name", list(QUERIES))
def test_same_result(spark, testdata, connection, name):
    assert compare.difference(QUERIES[name](spark, testdata), connection, SQL[name]) is None


def test_flagship_runs(spark, testdata):
    assert contract.entry(spark).count() > 0

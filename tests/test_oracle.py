"""Every registered query gives the rows of its SQL oracle, on whole tables."""

import pytest

import __spark_entry__ as entry
from repoatlas.catalog.oracle import oracle_sql
from repoatlas.catalog.queries import QUERIES
from tests.oracle_check import oracle_connection, oracle_rows, spark_rows

SF_DIR = "/root/testdata/sf0.01"
ORACLES = oracle_sql()


@pytest.fixture(scope="module")
def con():
    return oracle_connection(SF_DIR)


def test_every_query_has_an_oracle():
    assert set(QUERIES) == set(ORACLES)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query_equals_oracle(spark, con, name):
    columns, rows = spark_rows(QUERIES[name](spark, SF_DIR))
    expected_columns, expected_rows = oracle_rows(con, ORACLES[name])
    assert columns == expected_columns
    assert rows == expected_rows
    assert rows


def test_entry(spark):
    assert entry.entry(spark).count() > 0

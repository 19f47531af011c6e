"""Queries of this package whose result SQL can state, on whole tables."""

import pytest

from repoatlas.llm.queries import ORACLES, QUERIES
from tests.oracle_check import oracle_connection, oracle_rows, spark_rows

SF_DIR = "/root/testdata/sf0.01"


@pytest.mark.parametrize("name", list(ORACLES))
def test_query_equals_oracle(spark, name):
    got = spark_rows(QUERIES[name](spark, SF_DIR))
    want = oracle_rows(oracle_connection(SF_DIR), ORACLES[name])
    assert got == want
    assert got[1]

"""Queries with a SQL twin return exactly its rows."""

import pytest
from compare import connect, difference

from faultline.llm.queries import queries
from faultline.llm.sql import oracle_sql

SMALL = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_matches_sql(spark, name):
    assert difference(queries()[name](spark, SMALL), connect(SMALL), oracle_sql()[name]) is None

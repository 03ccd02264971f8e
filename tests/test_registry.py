"""Every registered query with a SQL twin returns exactly its rows."""

import pytest
from compare import connect, difference
from conftest import SF

from __spark_entry__ import entry, oracle_sql, queries

SQL, QUERIES = oracle_sql(), queries()


@pytest.fixture(scope="module")
def con():
    return connect(SF)


def test_every_twin_has_a_query():
    assert not set(SQL) - set(QUERIES)


def test_entry_has_rows(spark):
    assert entry(spark).count() > 0


@pytest.mark.parametrize("name", sorted(SQL))
def test_matches_sql(spark, con, name):
    assert difference(QUERIES[name](spark, SF), con, SQL[name]) is None

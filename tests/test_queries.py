"""Every registered query runs on the small tables and equals its SQL twin."""

import pytest

from __spark_entry__ import entry, oracle_sql, queries
from oracle import compare, connect

QUERIES, SQL = queries(), oracle_sql()
MAY_BE_EMPTY = {"search_fuzzy", "phonetic_duplicates", "people", "suggest_idents"}


@pytest.fixture(scope="module")
def con(small_dir):
    return connect(small_dir)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(name, spark, con, small_dir):
    problem, _ = compare(spark, con, QUERIES[name], SQL.get(name), small_dir)
    if problem == "no rows" and name in MAY_BE_EMPTY:
        return
    assert problem is None, problem


def test_entry(spark):
    assert entry(spark).count() > 0


def test_sql_has_queries():
    assert set(SQL) <= set(QUERIES)

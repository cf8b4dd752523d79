"""Every registered core query against its SQL on the smallest tables."""

import pytest

import __spark_entry__ as entry
from tests.oracle import compare, connect

LLM = lambda f: f.__module__.startswith("tidelog.llm")
QUERIES, SQL = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def con(sf):
    return connect(sf)


@pytest.mark.parametrize("name", sorted(k for k, f in QUERIES.items() if k in SQL and not LLM(f)))
def test_query(spark, sf, con, name):
    compare(QUERIES[name](spark, sf), con, SQL[name])


def test_sql_has_a_query():
    assert set(SQL) <= set(QUERIES)


def test_entry(spark):
    assert entry.entry(spark).count() > 0

import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))
from oracle import SF, compare, connect  # noqa: E402
from quarry.queries import oracle_sql, queries  # noqa: E402

import __spark_entry__ as entry  # noqa: E402

QUERIES, SQL = queries(), oracle_sql()


@pytest.fixture(scope="module")
def con():
    return connect()


@pytest.mark.parametrize("name", sorted(SQL))
def test_equals_sql(spark, con, name):
    compare(spark, con, QUERIES[name], SQL[name])


def test_every_query_has_sql_or_runs(spark):
    for name in set(QUERIES) - set(SQL):
        assert QUERIES[name](spark, SF).columns


def test_driver_contract(spark):
    assert set(QUERIES) <= set(entry.queries()) and set(SQL) <= set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).count() > 0


def test_entry_without_optional_parts(spark, monkeypatch):
    import importlib.util

    real = importlib.util.find_spec
    monkeypatch.setattr(importlib.util, "find_spec", lambda name, *a: None if name in ("quarry.llm", "corpus_pipeline") else real(name, *a))
    assert set(entry.queries()) == set(QUERIES) and set(entry.oracle_sql()) == set(SQL)

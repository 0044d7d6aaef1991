"""Every registered query that has check SQL equals it row for row on the small tables.

Queries of the training-data operators are tested beside their brute-force forms.
"""

import pytest

import __spark_entry__ as entry
from workload import MODULES
from workload.compare import compare, connect

QUERIES = {name: q for module in MODULES for name, q in module.QUERIES.items()}
SQL = {name: sql for module in MODULES for name, sql in module.ORACLES.items()}


@pytest.fixture(scope="module")
def con(small_dir):
    return connect(small_dir)


def test_every_sql_has_a_query():
    assert set(SQL) <= set(QUERIES) and set(entry.oracle_sql()) <= set(entry.queries())
    assert set(QUERIES) <= set(entry.queries())


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_its_sql(spark, con, small_dir, name):
    ok, note = compare(spark, con, small_dir, name, QUERIES[name], SQL[name])
    assert ok, note


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_query_without_sql_has_rows(spark, con, small_dir, name):
    """Their rows are held against walks and plain tables in the other test files."""
    ok, note = compare(spark, con, small_dir, name, QUERIES[name], None)
    assert ok is None and not note.startswith(f"{name}: 0 rows"), note


def test_entry(spark):
    assert entry.entry(spark).count() > 0

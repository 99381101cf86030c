"""Every query with a SQL counterpart gives the same rows in DuckDB."""

from __future__ import annotations

import duckdb
import pytest

import __spark_entry__ as entry
from tests.conftest import SF

TABLES = [
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
    "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
]
# The corpus operators have their own tests.
ORACLES = {k: v for k, v in entry.oracle_sql().items() if k not in entry.CORPUS_QUERIES}


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    return connection


def cell(value):
    if value is None:
        return "null"
    if isinstance(value, (bool, str)):
        return str(value)
    return repr(float(value))


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(cell(r[i]) for i in order) for r in data)


def test_every_query_has_sql():
    assert set(entry.queries()) - set(entry.CORPUS_QUERIES) == set(ORACLES)
    assert set(ORACLES) <= set(entry.queries())


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_rows_as_sql(spark, duck, name):
    result = entry.queries()[name](spark, SF)
    expected = duck.execute(ORACLES[name])
    names = [c[0] for c in expected.description]
    assert sorted(result.columns) == sorted(names)
    got = rows(result.columns, [tuple(r) for r in result.collect()])
    assert got == rows(names, expected.fetchall())
    assert got


def test_entry(spark):
    assert entry.entry(spark).count() > 0

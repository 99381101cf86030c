"""Every corpus query with a SQL counterpart gives the same rows in DuckDB."""

from __future__ import annotations

import duckdb
import pytest

import __spark_entry__ as entry
from mlledger.llm import license_digest
from mlledger.llm.oracles import OP10
from tests.conftest import SF
from tests.test_oracles import duck, rows  # noqa: F401

NAMES = sorted(set(entry.oracle_sql()) & set(entry.CORPUS_QUERIES))


def test_all_are_registered():
    numbers = {n.split("_")[0] for n in entry.CORPUS_QUERIES}
    assert numbers == {f"op{i}" for i in range(1, 14)} | {"pipeline"}
    assert NAMES


@pytest.mark.parametrize("name", NAMES)
def test_same_rows_as_sql(spark, duck, name):  # noqa: F811
    result = entry.queries()[name](spark, SF)
    expected = duck.execute(entry.oracle_sql()[name])
    names = [c[0] for c in expected.description]
    assert sorted(result.columns) == sorted(names)
    assert rows(result.columns, [tuple(r) for r in result.collect()]) == rows(
        names, expected.fetchall()
    )


def test_copyright_lines_are_read_as_in_sql(spark):
    """Lines that begin with "copyright", in every position of a licence."""
    lines = [
        "Copyright Jane Doe", "copyright the software,", "Copyright (c) 2020 A", "# (c) <year> B", "© C",
        "copyright if you do not accept", "copyright notices, and", "Copyright: Z", "copyrighted work",
        "All rights reserved.", " * Copyright  holders may", "copyright and more", "(C) 19yy name",
    ]
    body = license_digest.ISC.split("\n")
    rows = []
    for line in lines:
        for k in range(len(body) + 1):
            rows += ["\n".join([*body[:k], *extra, *body[k:]]) for extra in ([line], ["", line, "", ""], [line, line])]
    rows += [None, "", "\n", "copyright", *lines]
    docs = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    got = {tuple(r) for r in license_digest.scan_licenses(docs).collect()}
    connection = duckdb.connect()
    connection.register("documents", docs.toArrow())
    assert got == set(connection.execute(OP10).fetchall())
    assert len({r[2] for r in got}) > 1

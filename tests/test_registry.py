"""Every registered query against its SQL on the smallest tables."""

from __future__ import annotations

import os

import pytest

import check
from __spark_entry__ import entry, oracle_sql, queries
from marquee_checks.oracle import ORACLE
from marquee_checks.queries import QUERIES

FOLDER = "/root/testdata/sf0.001"
needs_tables = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="test tables are absent")


@pytest.fixture(scope="module")
def connection():
    return check.connect(FOLDER)


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLE)
    assert set(QUERIES) <= set(queries()) and set(oracle_sql()) <= set(queries())


@needs_tables
def test_entry_returns_rows(spark):
    assert entry(spark).count() > 0


@needs_tables
@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_sql(spark, connection, name):
    assert check.compare(spark, connection, FOLDER, name) is None

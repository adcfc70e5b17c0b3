"""Every registered query against its SQL oracle."""

from __future__ import annotations

import os

import duckdb
import pytest

import __spark_entry__ as entry

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="session")
def con():
    found = duckdb.connect()
    for name in TABLES:
        found.execute(f"CREATE VIEW {name} AS SELECT * FROM '{DATA}/{name}.parquet'")
    return found


def plain(value):
    if value is None or value != value:
        return "~"
    if isinstance(value, bool):
        return str(value)
    try:
        return f"{float(value):.6g}"
    except (TypeError, ValueError):
        return str(value)[:10] if hasattr(value, "year") else str(value)


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_query_matches_oracle(spark, con, name):
    result = entry.queries()[name](spark, DATA)
    expected = con.execute(entry.oracle_sql()[name])
    columns = [c[0] for c in expected.description]
    want = sorted(tuple(map(plain, r)) for r in expected.fetchall())
    got = sorted(tuple(map(plain, r)) for r in result.select(*columns).collect())
    assert sorted(columns) == sorted(result.columns)
    assert got == want


def test_entry(spark):
    assert entry.entry(spark).count() == 7

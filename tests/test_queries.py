"""Every query with SQL gives the rows that DuckDB gives for it, on the smallest tables."""

from __future__ import annotations

from pathlib import Path

import duckdb
import pytest

import compare
from lodestone.plans import config_queries, delta_queries, library_queries, registry, source_queries, store_queries, synthesis_queries, text_queries, workflow_queries  # noqa: F401

TABLES = Path("/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def db():
    if not TABLES.is_dir():
        pytest.skip("no tables here")
    connection = duckdb.connect()
    for t in compare.TABLES:
        connection.execute(f"CREATE VIEW {t} AS SELECT * FROM '{TABLES}/{t}.parquet'")
    return connection


@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_query(spark, db, name):
    df = registry.QUERIES[name](spark, str(TABLES))
    columns = sorted(df.columns)
    got = sorted(tuple(compare.value(r[c]) for c in columns) for r in df.collect())
    result = db.execute(registry.SQL[name])
    theirs = [d[0] for d in result.description]
    assert sorted(theirs) == columns
    assert got == sorted(tuple(compare.value(r[theirs.index(c)]) for c in columns) for r in result.fetchall())


def test_every_query_has_sql():
    assert registry.QUERIES.keys() == registry.SQL.keys()

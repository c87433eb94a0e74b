"""Queries with SQL against DuckDB."""

import duckdb
import pytest

from gradebook.llm.queries import ORACLES, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, sf, name):
    con = duckdb.connect()
    for t in ("documents", "conversations"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    want = con.sql(ORACLES[name])
    columns = sorted(want.columns)
    got = QUERIES[name](spark, sf)
    assert sorted(got.columns) == columns
    rows = [tuple(str(r[c]) for c in columns) for r in got.collect()]
    order = [want.columns.index(c) for c in columns]
    assert sorted(rows) == sorted(tuple(str(r[k]) for k in order) for r in want.fetchall())

"""Registered queries against their SQL in DuckDB."""

import pytest

duckdb = pytest.importorskip("duckdb")

from graphloom.plans.registry import ORACLES, QUERIES  # noqa: E402

TABLES = ("events", "documents", "conversations", "part", "supplier", "benchmark")


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_rows(spark, sf, name):
    db = duckdb.connect()
    for t in TABLES:
        db.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    ours, theirs = QUERIES[name](spark, sf), db.sql(ORACLES[name])
    columns = sorted(ours.columns)
    assert columns == sorted(theirs.columns)
    order = [theirs.columns.index(c) for c in columns]
    want = sorted(tuple(str(row[k]) for k in order) for row in theirs.fetchall())
    assert sorted(tuple(str(row[c]) for c in columns) for row in ours.collect()) == want

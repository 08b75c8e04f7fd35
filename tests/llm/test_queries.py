"""The queries that SQL can express, against their SQL on a small table."""

from __future__ import annotations

import math

import duckdb
import pytest

from aurum.llm import queries

FOLDER = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_matches_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "embeddings"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    got, want = queries.QUERIES[name](spark, FOLDER), con.sql(queries.ORACLES[name])
    assert sorted(got.columns) == sorted(want.columns)
    order = sorted(got.columns)
    plain = lambda v: None if isinstance(v, float) and math.isnan(v) else v
    mine = sorted((tuple(plain(r[c]) for c in order) for r in got.collect()), key=str)
    theirs = sorted((tuple(plain(r[want.columns.index(c)]) for c in order) for r in want.fetchall()), key=str)
    assert mine == theirs

"""Every registered query against its SQL on the smallest tables."""

from __future__ import annotations

import math

import duckdb
import pytest

from aurum import catalogue

FOLDER = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(value):
    if value is None or isinstance(value, float) and math.isnan(value):
        return "~"
    return f"{float(value):.9g}" if isinstance(value, (int, float)) and not isinstance(value, bool) else str(value)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_matches_sql(spark, duck, name):
    got = catalogue.QUERIES[name](spark, FOLDER)
    want = duck.sql(catalogue.ORACLES[name])
    assert sorted(got.columns) == sorted(want.columns)
    order = sorted(got.columns)
    mine = sorted(tuple(plain(r[c]) for c in order) for r in got.collect())
    theirs = sorted(tuple(plain(r[want.columns.index(c)]) for c in order) for r in want.fetchall())
    assert mine == theirs

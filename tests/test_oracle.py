"""Queries against their SQL on DuckDB. ORACLE_ALL=1 runs every one, else every sixth by name."""

import os

import duckdb
import pytest

import check
from tapeloom import plans

ALL = sorted(plans.ORACLES)
NAMES = ALL if os.environ.get("ORACLE_ALL") else ALL[::6]


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for t in check.TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", NAMES)
def test_matches_sql(spark, sf, duck, name):
    got = plans.QUERIES[name](spark, sf).toPandas()
    want = duck.execute(plans.ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert check.canonical(got) == check.canonical(want)


def test_every_query_is_known():
    assert set(plans.ORACLES) <= set(plans.QUERIES)
    assert len(plans.QUERIES) > 200

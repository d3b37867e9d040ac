"""Every catalogued query against its SQL in DuckDB, on the smallest tables."""

import os

import duckdb
import pytest

from keelson.plans import catalog

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for f in os.listdir(SF):
        c.sql(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{f}'")
    return c


@pytest.mark.parametrize("name", sorted(catalog.SQL))
def test_matches_sql(spark, duck, name):
    got = catalog.QUERIES[name](spark, SF)
    cols = sorted(got.columns)
    names = ", ".join(f'"{c}"' for c in cols)
    want = duck.sql(f"SELECT {names} FROM ({catalog.SQL[name]})").fetchall()
    assert sorted(map(str, map(tuple, got.select(cols).collect()))) == sorted(map(str, want))


def test_simulations_count_every_access(spark):
    rows = catalog.QUERIES["tinylfu_sim"](spark, SF).collect()
    events = spark.read.parquet(f"{SF}/events.parquet").filter("user_id IS NOT NULL").count()
    assert sum(r.hits + r.misses for r in rows) == events

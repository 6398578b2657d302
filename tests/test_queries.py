"""Every query of the engine against DuckDB on the smallest tables."""

import glob
import math
import os
from collections import Counter

import duckdb
import pytest

import __spark_entry__
from policyspark.plans.queries import ORACLES, QUERIES

TINY = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in glob.glob(f"{TINY}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return con


def plain(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return None
    return f"{float(v):.7g}" if isinstance(v, (int, float)) and not isinstance(v, bool) or type(v).__name__ == "Decimal" else str(v)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_against_sql(spark, duck, name):
    made = QUERIES[name](spark, TINY)
    cursor = duck.execute(ORACLES[name])
    columns = [d[0] for d in cursor.description]
    assert sorted(columns) == sorted(made.columns)
    expect = Counter(tuple(plain(v) for _, v in sorted(zip(columns, row, strict=True))) for row in cursor.fetchall())
    got = Counter(tuple(plain(v) for _, v in sorted(r.asDict().items())) for r in made.collect())
    assert got == expect


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_runs(spark, name):
    assert QUERIES[name](spark, TINY).count() > 0


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(ORACLES) <= set(QUERIES) <= set(__spark_entry__.queries())

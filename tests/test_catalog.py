"""Every catalog query against DuckDB on the smallest tables."""

import datetime
import os
from decimal import Decimal

import duckdb
import pytest

from plenum.plans import catalog

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in os.listdir(DATA):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{DATA}/{f}'")
    return con


def rows(found, columns):
    at = [columns.index(c) for c in sorted(columns)]
    plain = lambda v: float(v) if isinstance(v, Decimal | float) else v
    return sorted(repr([plain(r[i]) for i in at]) for r in found)


@pytest.mark.parametrize("name", catalog.SQL)
def test_same_as_duckdb(spark, duck, name):
    ours = catalog.run(name, spark, DATA)
    theirs = duck.sql(catalog.oracle(name))
    assert sorted(ours.columns) == sorted(theirs.columns)
    assert rows([tuple(r) for r in ours.collect()], ours.columns) == rows(theirs.fetchall(), theirs.columns)


def test_filters_reach_the_scan(spark):
    plan = catalog.run("upcoming_deadlines", spark, DATA)._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(o_orderstatus), EqualTo(o_orderstatus,O)]" in plan
    assert "TakeOrderedAndProject" in plan


def test_a_null_date_passes_the_overlap(spark):
    orders = spark.createDataFrame([(1, None), (2, datetime.datetime(1990, 1, 1)), (3, datetime.datetime(1996, 3, 5))], "o_orderkey long, o_orderdate timestamp")
    assert sorted(r.id for r in spark.sql(catalog.SQL["discover_date_overlap"], orders=orders).collect()) == [1, 3]

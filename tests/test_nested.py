"""Nested operators on small frames, and their queries against DuckDB."""

import os

import duckdb
import pytest
from pyspark.sql import functions as F

from plenum.operators import nested
from plenum.plans import documents

from .test_catalog import DATA, rows

L = F.lit


@pytest.mark.parametrize("name", documents.QUERIES)
def test_same_as_duckdb(spark, name):
    con = duckdb.connect()
    for f in os.listdir(DATA):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{DATA}/{f}'")
    ours, theirs = documents.queries()[name](spark, DATA), con.sql(documents.oracles()[name])
    assert sorted(ours.columns) == sorted(theirs.columns)
    assert rows([tuple(r) for r in ours.collect()], ours.columns) == rows(theirs.fetchall(), theirs.columns)


def value(spark, column):
    return spark.range(1).select(column.alias("v")).head().v


def test_children_of_a_parent_without_any(spark):
    parents, children = spark.createDataFrame([(1,), (2,)], "k long"), spark.createDataFrame([(1, 9), (1, 3)], "k long, v long")
    found = {r.k: [c.v for c in r.kids] for r in nested.with_children(parents, children, "k", "kids", "v").collect()}
    assert found == {1: [3, 9], 2: []}


@pytest.mark.parametrize(("base", "chosen", "likes", "kudos"), [(None, "likes", 3, 0), ("likes", None, 2, 0), ("likes", "kudos", 2, 0), (None, None, 2, 0)])
def test_toggled(spark, base, chosen, likes, kudos):
    counts = F.create_map(L("likes"), L(2), L("kudos"), L(None).cast("int"))
    assert value(spark, nested.toggled(counts, L(base).cast("string"), L(chosen).cast("string"))) == {"likes": likes, "kudos": kudos}


def test_present(spark):
    assert value(spark, nested.present(F.create_map(L("a"), L(0), L("b"), L(1)))) == {"b": 1}


def test_steps(spark):
    assert [s.state for s in value(spark, nested.steps("abc", L(1), L(False)))] == ["completed", "current", "upcoming"]
    assert [s.state for s in value(spark, nested.steps("abc", L(2), L(True)))] == ["completed"] * 3


def test_history_drops_what_both_list(spark):
    schema = "id long, verified_achievements array<struct<title:string,year:int>>, timeline array<struct<year:int,items:array<struct<title:string>>>>"
    profiles = spark.createDataFrame([(1, [("A", 2020)], [(2020, [("A",), ("B",)])]), (2, None, [])], schema)
    assert sorted(map(tuple, nested.history(profiles).collect())) == [(1, "A", 2020), (1, "B", 2020)]


def test_ranks_with_ties_nulls_and_no_rows(spark):
    t = spark.range(1000).select("id", F.when(F.col("id") % 10 > 0, F.col("id") % 7).alias("v"))
    found = [r.id for r in nested.ranked(t, "v", F.col("id")).orderBy("rank").collect()]
    assert found == [r.id for r in t.orderBy(F.col("v").asc_nulls_last(), "id").collect()]
    assert sorted(r["rank"] for r in nested.ranked(t, "v", F.col("id"), descending=True).collect()) == list(range(1, 1001))
    assert nested.ranked(t.limit(0), "v").count() == 0


def test_ranks_of_large_whole_numbers(spark):
    from plenum.operators import nested

    rows = [(2**60 + i,) for i in (3, 1, 2, 0)] + [(None,), (5,)]
    t = spark.createDataFrame(rows, "v long")
    up = {r.v: r["rank"] for r in nested.ranked(t, "v").collect()}
    down = {r.v: r["rank"] for r in nested.ranked(t, "v", descending=True).collect()}
    assert up == {5: 1, 2**60: 2, 2**60 + 1: 3, 2**60 + 2: 4, 2**60 + 3: 5, None: 6}
    assert down == {2**60 + 3: 1, 2**60 + 2: 2, 2**60 + 1: 3, 2**60: 4, 5: 5, None: 6}


def test_places_in_runs(spark):
    """The same places as a window gives, with one owner that has most rows, null owners and values, and ties."""
    from plenum.operators.ordering import newest_first, placed, placed_in_runs

    rows = spark.range(3000).selectExpr("id", "CASE WHEN id % 3 < 2 THEN 'hot' WHEN id % 9 = 2 THEN NULL ELSE concat('o', id % 7) END AS owner", "IF(id % 11 = 0, NULL, id * 37 % 101) AS at", "'x' AS _n").repartition(6, "id")
    order = (F.col("at").desc_nulls_last(), F.col("id").desc())
    want = {(r.id, r.owner, r.place) for r in placed(rows, ["owner"], *order).collect()}
    assert {(r.id, r.owner, r.place) for r in placed_in_runs(rows, ["owner"], *order).collect()} == want
    assert {(r.id, r.owner, r.place) for r in newest_first(rows, "owner", "at", "id", few=True).collect()} == want
    assert placed_in_runs(rows.limit(0), ["owner"], *order).count() == 0
    tied = placed_in_runs(rows.withColumn("same", F.lit(1)), ["same"], F.col("same")).select("place").distinct()
    assert tied.count() == 3000


def test_active_facets(spark):
    from plenum.services.discovery import active_facets

    t = spark.createDataFrame([("All", "", None, [], False, None), ("x", "Rome", 5, ["Online"], True, None), (None, None, None, None, None, None)], "industry string, location string, price_most int, formats array<string>, brochure boolean, since date").withColumn("keyword", F.lit("k"))
    assert [r[0] for r in t.select(active_facets(t)).collect()] == [0, 5, 0]

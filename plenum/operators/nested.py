"""Operators that build or read nested columns: child arrays, agendas, reaction counters, timelines, ranks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Ranges that a global rank is computed in.
RANGES = 64


def with_children(parents: DataFrame, children: DataFrame, on: str, name: str, *columns: str) -> DataFrame:
    """Each parent with an array of its children's columns, ordered by these; empty without any.

    Children are grouped before the join, so one shuffle of each side by the key is enough.
    """
    grouped = children.groupBy(on).agg(F.array_sort(F.collect_list(F.struct(*columns))).alias(name))
    return parents.join(grouped, on, "left").withColumn(name, F.coalesce(name, F.array()))


def agenda(sessions: DataFrame, day: Column, *columns: str) -> DataFrame:
    """date, day_name, sessions: the sessions of each day as an array in the order of the columns."""
    listed = F.array_sort(F.collect_list(F.struct(*columns))).alias("sessions")
    return sessions.groupBy(day.cast("date").alias("date")).agg(listed).select("date", F.date_format("date", "EEEE").alias("day_name"), "sessions")


def steps(labels: Sequence[str], current: Column, final: Column) -> Column:
    """Array of (label, state): completed before the current step, current at it, upcoming after; a final current step is completed."""
    state = lambda i: F.when((i < current) | ((i == current) & final), "completed").when(i == current, "current").otherwise("upcoming")
    return F.transform(F.array(*map(F.lit, labels)), lambda label, i: F.struct(label.alias("label"), state(i).alias("state")))


def breakdown(posts: DataFrame, *counters: str) -> DataFrame:
    """reaction, total: the sum of each counter column (null as 0) over all posts, without zeros. One pass, then a row per counter."""
    sums = posts.agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in counters))
    return sums.unpivot([], list(counters), "reaction", "total").filter("total <> 0")


def toggled(counts: Column, base: Column, chosen: Column) -> Column:
    """Counters (a map) as shown to someone whose stored reaction is base and whose present one is chosen.

    Only a first reaction adds one; going from one reaction to another, or to none, changes no counter.
    """
    added = F.when(chosen.isNotNull() & base.isNull(), 1).otherwise(0)
    return F.transform_values(counts, lambda k, v: F.coalesce(v, F.lit(0)) + F.when(k.eqNullSafe(chosen), added).otherwise(0))


def present(counts: Column) -> Column:
    """The counters above zero."""
    return F.map_filter(counts, lambda k, v: v > 0)


def starting_price(packages: Column) -> Column:
    """The least price in an array of packages; null for an empty one."""
    return F.array_min(F.transform(packages, lambda p: p["price"]))


def history(profiles: DataFrame) -> DataFrame:
    """id, title, year: verified achievements and the items of the timeline, once for each title and year.

    profiles: id, verified_achievements (array of title, year, ...), timeline (array of year, items: array of title, ...).
    """
    achieved = profiles.select("id", F.explode("verified_achievements").alias("a")).select("id", "a.title", "a.year")
    lived = profiles.select("id", F.explode("timeline").alias("t")).select("id", F.explode("t.items").alias("i"), "t.year").select("id", "i.title", "year")
    return achieved.unionByName(lived).distinct()


def ranked(table: DataFrame, by: str, *ties: Column, descending: bool = False) -> DataFrame:
    """table with rank, from 1 over all rows in the order of a numeric column and then of the ties.

    A window over everything would be one task. Splitters from approximate
    percentiles cut the column into RANGES; rows are numbered within their
    range, and the counts of the ranges before it are added. Only splitters and
    counts, at most RANGES of each, come to the driver. Rows that share one
    value share a range. Nulls come last.
    """
    key = -F.col(by).cast("double") if descending else F.col(by).cast("double")
    cuts = table.agg(F.percentile_approx(key, [i / RANGES for i in range(1, RANGES)], 10_000)).head()[0] or []
    cuts = sorted(set(cuts))
    part = F.when(key.isNull(), len(cuts) + 1)
    for i, bound in enumerate(cuts):
        part = part.when(key <= bound, i)
    rows = table.withColumn("_part", part.otherwise(len(cuts)))
    before, offsets = 0, []
    for p, n in sorted(tuple(r) for r in rows.groupBy("_part").count().collect()):
        offsets.append((p, before))
        before += n
    offset = F.lit(0)
    for p, n in offsets:
        offset = F.when(F.col("_part") == p, F.lit(n)).otherwise(offset)
    order = F.col(by).desc_nulls_last() if descending else F.col(by).asc_nulls_last()  # the column itself: doubles would merge large whole numbers
    number = F.row_number().over(Window.partitionBy("_part").orderBy(order, *ties))
    return rows.withColumn("rank", number.cast("long") + offset).drop("_part")

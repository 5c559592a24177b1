"""Owner lists in an order: a place per owner instead of one sort of everything, and sorts with a total order."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plenum.sources.tables import work_folder


def placed(rows: DataFrame, owner: Sequence[str], *order: Column) -> DataFrame:
    """rows with place, from 0 in the list of their owner."""
    return rows.withColumn("place", F.row_number().over(Window.partitionBy(*owner).orderBy(*order)).cast("long") - 1)


def placed_in_runs(rows: DataFrame, owner: Sequence[str], *order: Column) -> DataFrame:
    """As placed(), for owners with more rows than one task should sort. Runs at once; rows that tie come in any order.

    Rows are range-partitioned by sampled splitters over owner and order, and
    sorted externally into runs on disk; an owner's rows may lie in any number
    of runs. A place is the place inside of the run and the number of the
    owner's rows in the runs before, which are one count per owner and run.
    """
    spark, folder = rows.sparkSession, work_folder(rows.sparkSession)
    keys = [*[F.col(c).asc_nulls_first() for c in owner], *order, F.col("_tie").asc()]
    ranged = rows.withColumn("_tie", F.xxhash64(F.monotonically_increasing_id())).repartitionByRange(*keys).sortWithinPartitions(*keys)
    inside = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))  # the row's number in its partition
    ranged.drop("_tie").withColumns({"_run": F.spark_partition_id(), "_in": inside}).write.parquet(folder)
    runs = spark.read.parquet(folder)
    earlier = Window.partitionBy(*owner).orderBy("_run").rowsBetween(Window.unboundedPreceding, -1)
    parts = runs.groupBy("_run", *owner).agg(F.count(F.lit(1)).alias("_n"), F.min("_in").alias("_first"))
    parts = parts.select(F.col("_run").alias("_r"), *[F.col(c).alias(f"_o_{c}") for c in owner], (F.coalesce(F.sum("_n").over(earlier), F.lit(0)) - F.col("_first")).alias("_add"))
    same = F.col("_run") == F.col("_r")
    for c in owner:
        same = same & F.col(c).eqNullSafe(F.col(f"_o_{c}"))
    return runs.join(parts, same).withColumn("place", F.col("_in") + F.col("_add")).select(*rows.columns, "place")


def newest_first(rows: DataFrame, owner: str, at: str, key: str, who: str | Column | None = None, few: bool = False) -> DataFrame:
    """Rows of each owner, or of one, with place: the newest first (nulls last), equal times by key, descending.

    few: owners are few and have long lists, so places are made in runs, at once.
    """
    if who is not None:
        rows = rows.filter(F.col(owner) == who)
    return (placed_in_runs if few else placed)(rows, [owner], F.col(at).desc_nulls_last(), F.col(key).desc())


def by_locale(text: Column) -> Column:
    """text to sort by as readers expect it: letters by alphabet, accents and then case only between equal letters."""
    return F.collate(text, "UNICODE")


def first_k(rows: DataFrame, k: int, *order: Column) -> DataFrame:
    return rows.orderBy(*order).limit(k)


def first_match(rows: DataFrame, wanted: Column, *order: Column) -> DataFrame:
    """The first row that meets the condition; the first of all if none does."""
    return rows.orderBy(F.coalesce(wanted, F.lit(False)).desc(), *order).limit(1)


def split_by(rows: DataFrame, condition: Column) -> tuple[DataFrame, DataFrame]:
    """Rows that meet a condition, and the others (null counts as not met)."""
    met = F.coalesce(condition, F.lit(False))
    return rows.filter(met), rows.filter(~met)

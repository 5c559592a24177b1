"""Tables on disk that change by key: only the partitions that hold changed keys are written anew."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from plenum.operators.tables import deleted, upsert

BUCKET = "_bucket"


def exists(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def remove(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


@dataclass(frozen=True)
class StoredTable:
    """A Parquet table laid out by a hash of its key in ``buckets`` partitions.

    A change reads the partitions of the keys that it names, and replaces them
    by a dynamic partition overwrite; the others keep their files. Spark stages
    the new files and moves them when the job is done, so a job that fails
    before leaves the table as it was. One writer at a time. A bucket should
    hold what a few tasks can rewrite: about a GB.
    """

    spark: SparkSession
    path: str
    key: Sequence[str]
    buckets: int = 64

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64(*self.key), F.lit(self.buckets)).cast("int")

    @cached_property
    def _schema(self) -> StructType:
        return self.spark.read.parquet(self.path).schema

    def _read(self) -> DataFrame:
        return self.spark.read.schema(self._schema).parquet(self.path)

    def _dealt(self, rows: DataFrame) -> DataFrame:
        """rows with one task per bucket."""
        return rows.repartitionById(self.buckets, self._bucket())

    def _write(self, rows: DataFrame) -> list[int]:
        """Replaces the partitions that rows have, and returns their numbers."""
        seen = Observation()
        dealt = rows.withColumn(BUCKET, self._bucket()).observe(seen, F.collect_set(BUCKET).alias("buckets"))
        dealt.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(BUCKET).parquet(self.path)
        return seen.get["buckets"]

    def create(self, rows: DataFrame) -> StoredTable:
        """Writes the first rows. A table without rows is a folder with a file of its schema."""
        if not self._write(self._dealt(rows)):
            rows.withColumn(BUCKET, self._bucket()).limit(0).write.mode("overwrite").parquet(f"{self.path}/{BUCKET}=0")
        return self

    def rows(self) -> DataFrame:
        return self._read().drop(BUCKET)

    def _change(self, keys: DataFrame, make: Callable[[DataFrame], DataFrame]) -> list[int]:
        """Rewrites the partitions of these keys by make(their rows); returns them."""
        touched = sorted(r[0] for r in keys.select(self._bucket()).distinct().collect())  # at most one number per bucket
        if not touched:
            return []
        old = self._read()
        left = self._write(self._dealt(make(old.filter(F.col(BUCKET).isin(touched)).drop(BUCKET))))
        for bucket in set(touched) - set(left):  # all of its rows went
            remove(self.spark, f"{self.path}/{BUCKET}={bucket}")
        return touched

    def upsert(self, changes: DataFrame) -> list[int]:
        """Whole rows, keys once each: replaces those with the same key and adds the others. Returns the partitions written."""
        return self._change(changes, lambda old: upsert(old, changes, self.key).select(old.columns))

    def delete(self, keys: DataFrame) -> list[int]:
        """Removes the rows with these keys."""
        return self._change(keys, lambda old: deleted(old, keys, self.key))

    def update(self, keys: DataFrame, **values: Column) -> list[int]:
        """Sets columns of the rows with these keys, by expressions over the old row and over what else keys has (as new.<column>)."""

        def make(old: DataFrame) -> DataFrame:
            new = F.struct(*[F.col(c) for c in keys.columns]).alias("new")
            joined = old.join(keys.select(*self.key, new), list(self.key), "left")
            hit = F.col("new").isNotNull()
            return joined.withColumns({c: F.when(hit, v).otherwise(F.col(c)) for c, v in values.items()}).select(old.columns)

        return self._change(keys, make)

    def merge(self, changes: DataFrame, combine: dict[str, Column]) -> list[int]:
        """Per key of changes (once each) one row by expressions over old.<column> (null for new keys) and new.<column>; the key stays."""

        def make(old: DataFrame) -> DataFrame:
            both = old.select(*self.key, F.struct("*").alias("old")).join(changes.select(*self.key, F.struct("*").alias("new")), list(self.key), "full")
            made = lambda c: F.when(F.col("new").isNull(), F.col(f"old.{c}")).otherwise(combine[c])
            return both.select(*[F.col(c) if c in self.key else made(c).alias(c) for c in old.columns])

        return self._change(changes, make)

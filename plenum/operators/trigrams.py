"""Substring search over many texts: a posting table of trigrams gives candidates, which are verified on the texts."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Length of a gram; shorter queries have none and scan the texts.
LENGTH = 3


def grams(text: Column) -> Column:
    """The different runs of LENGTH characters of a text in lower case, in time linear in its length; none for null."""
    characters = F.split(F.lower(F.coalesce(text, F.lit(""))), "")

    def runs(chars: Column) -> Column:
        starts = F.when(F.size(chars) >= LENGTH, F.sequence(F.lit(0), F.size(chars) - LENGTH))
        return F.array_distinct(F.transform(starts, lambda i: F.concat(*[F.get(chars, i + k) for k in range(LENGTH)])))

    return F.element_at(F.transform(F.array(characters), runs), 1)  # the characters are split once


@dataclass(frozen=True)
class Postings:
    """A Parquet table (bucket, gram, id) with a row per different gram of a text; bucket is a partition, files are sorted by gram."""

    spark: SparkSession
    path: str
    buckets: int = 64

    def _bucket(self, gram: Column) -> Column:
        return F.pmod(F.xxhash64(gram), F.lit(self.buckets)).cast("int")

    def build(self, texts: DataFrame, key: str, text: str) -> Postings:
        """Writes the postings of all texts (keys once each). A gram that most texts have is dealt over several files by key."""
        rows = texts.select(F.col(key).alias("id"), F.explode(grams(F.col(text))).alias("gram")).withColumn("bucket", self._bucket(F.col("gram")))
        part = F.pmod(F.xxhash64("id"), F.lit(8))
        rows.repartition("bucket", part).sortWithinPartitions("bucket", "gram", "id").write.partitionBy("bucket").parquet(self.path)
        return self

    def candidates(self, query: str) -> DataFrame:
        """id: the texts that have every gram of a query of LENGTH characters or more.

        Buckets that hold none of the grams aren't read, and of the others only the row groups around the grams.
        """
        own = self.spark.range(1).select(F.explode(grams(F.lit(query))).alias("gram")).withColumn("bucket", self._bucket(F.col("gram"))).collect()  # a row per gram of the query
        rows = self.spark.read.parquet(self.path).filter(F.col("bucket").isin([r.bucket for r in own]) & F.col("gram").isin([r.gram for r in own]))
        return rows.groupBy("id").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") == len(own)).select("id")

    def search(self, texts: DataFrame, key: str, text: str, query: str) -> DataFrame:
        """The rows of texts that hold the query in any case, as contains() finds them; texts without null in text only."""
        holds = F.contains(F.lower(F.col(text)), F.lit(query.lower()))
        if len(query) < LENGTH:
            return texts.filter(holds)
        return texts.join(self.candidates(query).withColumnRenamed("id", key), key, "left_semi").filter(holds)

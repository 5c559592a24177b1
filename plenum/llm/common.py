"""Small helpers shared by the corpus operators."""

from __future__ import annotations

import atexit
import contextlib
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plenum.sources.tables import shared_folder

#: ASCII white space, as a Java character class body.
SPACE = r"\x20\x09-\x0D"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Folders that cut() wrote in this process and nothing has discarded yet, in order; what is left when the process ends is deleted then.
WRITTEN: list[str] = []


def scratch(spark: SparkSession) -> str:
    """The folder that all executors share; where the session names none, a local one if all runs in one process, else an error."""
    return shared_folder(spark)


def own(path: str) -> None:
    """Lists a folder for discard(), and for the end of the process."""
    if not WRITTEN:
        atexit.unregister(_discard_all)
        atexit.register(_discard_all)
    WRITTEN.append(path)


def _discard_all() -> None:
    spark = SparkSession.getActiveSession()
    if spark is not None:
        with contextlib.suppress(Exception):  # the session, or its JVM, may be gone
            discard(spark, WRITTEN)


def cut(df: DataFrame) -> DataFrame:
    """Writes df to the shared folder at once and reads it back, so that a lost executor costs no recomputation.

    Results are read from these tables lazily, so only the caller knows when they can go: see discard().
    """
    path = f"{scratch(df.sparkSession)}/{uuid.uuid4().hex}"
    own(path)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(spark: SparkSession, paths: list[str]) -> None:
    """Deletes tables that cut() wrote, once nothing reads them any more."""
    for path in list(paths):
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
        WRITTEN.remove(path)


def bounded(spark: SparkSession) -> SparkSession:
    """For applications, not operators: bounds what goes to a Python worker at once by bytes, unless the session has a bound already."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(name) == str(64 << 20) + "b":
        spark.conf.set(name, "4m")
    return spark


def let(value: Column, body) -> Column:
    """body(value), with value evaluated once, even where body uses it inside of lambdas."""
    return F.element_at(F.transform(F.array(value), body), 1)


def ascii_lower(text: Column) -> Column:
    """Lower-cases A-Z and nothing else."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def n_words(text: Column) -> Column:
    """Number of maximal runs of anything but ASCII white space; 0 for null.

    White space becomes single spaces by plain replacements (a regular
    expression only where two stand together), so the words are one more than
    the spaces that are left: no array of words is built.
    """
    flat = F.coalesce(text, F.lit(""))
    for c in "\t\n\x0b\x0c\r":
        flat = F.replace(flat, F.lit(c), F.lit(" "))
    flat = F.trim(F.when(F.contains(flat, F.lit("  ")), F.regexp_replace(flat, " {2,}", " ")).otherwise(flat))
    return F.when(flat == "", F.lit(0)).otherwise(F.length(flat) - F.length(F.replace(flat, F.lit(" "), F.lit(""))) + 1).cast("long")


#: A key is hot with more rows than this, and more than one of HOT_KEYS of all; its rows are dealt into HOT_PARTS.
HOT_ROWS, HOT_KEYS, HOT_PARTS = 1000, 10_000, 64


def join_counted(rows: DataFrame, keys: DataFrame, on: list[str], *spread: str) -> DataFrame:
    """Inner join of rows with keys, which has one row per key and in n the number of its rows in rows.

    Fewer than HOT_KEYS keys can be hot, so their list is broadcast. Rows of a
    hot key are dealt by the hash of the spread columns, and the key's row goes
    to each part, so no task gets all of it. keys is read three times, one of
    them at once, so it should be a written table.
    """
    total = keys.agg(F.sum("n")).head()[0] or 0
    least = max(HOT_ROWS, total // HOT_KEYS)
    hot = keys.filter(F.col("n") > least).select(*on, F.lit(True).alias("_hot"))
    part = F.when(F.col("_hot"), F.pmod(F.xxhash64(*spread), F.lit(HOT_PARTS))).otherwise(F.lit(0)).cast("int")
    dealt = rows.join(F.broadcast(hot), on, "left").withColumn("_part", part).drop("_hot")
    parts = F.when(F.col("n") > least, F.sequence(F.lit(0), F.lit(HOT_PARTS - 1))).otherwise(F.array(F.lit(0)))
    return dealt.join(keys.withColumn("_part", F.explode(parts)), [*on, "_part"]).drop("_part")

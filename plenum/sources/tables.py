"""Reading tables with their declared schemas, JSON columns, and writing results."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Schemas of the JSON columns.
JSON = {
    "keywords": "array<string>",
    "benefits": "array<string>",
    "co_authors": "array<struct<name:string,affiliation:string,email:string>>",
    "scores": "map<string,double>",
    "ratings": "map<string,double>",
}


def read(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def decoded(table: DataFrame, **schemas: str) -> DataFrame:
    """Parses the JSON columns of a table by their schemas (those known by name, and those given); malformed values become null."""
    known = {c: s for c, s in {**JSON, **schemas}.items() if dict(table.dtypes).get(c) == "string"}
    return table.withColumns({c: F.from_json(c, s) for c, s in known.items()})


def as_json(table: DataFrame) -> DataFrame:
    """One column, value: each row as JSON text."""
    return table.select(F.to_json(F.struct("*")).alias("value"))


def write_json(table: DataFrame, path: str) -> None:
    table.write.mode("errorifexists").json(path)


def append_json(table: DataFrame, path: str) -> None:
    table.write.mode("append").json(path)


def read_json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rows of JSON files by their schema, never inferred; malformed ones are dropped."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)


def shared_folder(spark: SparkSession) -> str:
    """The folder for intermediate data that the driver and all executors see; a local one only where all runs in one process."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder is None:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = f"{tempfile.gettempdir()}/plenum-checkpoint"
    return folder.rstrip("/")


#: Folders of this process, to be deleted when it ends.
_OWNED: list[tuple[SparkSession, str]] = []


def work_folder(spark: SparkSession) -> str:
    """A new folder below the shared one. Frames read from it are lazy, so it stays until the process ends, or drop_folders()."""
    if not _OWNED:
        atexit.register(drop_folders)
    _OWNED.append((spark, f"{shared_folder(spark)}/{uuid.uuid4().hex}"))
    return _OWNED[-1][1]


def drop_folders() -> None:
    """Deletes all folders of this process; a session that has ended leaves its own."""
    while _OWNED:
        spark, folder = _OWNED.pop()
        with contextlib.suppress(Exception):  # the session, or its JVM, may be gone
            at = spark._jvm.org.apache.hadoop.fs.Path(folder)
            at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)

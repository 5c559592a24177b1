"""Streams, stored tables and writes with constraints as registered queries, each with SQL for DuckDB that was written on its own.

Streams read files of one time slice each, one file a batch, in the order of
time, so state is carried over many batches.
"""

from __future__ import annotations

import time
from datetime import timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from plenum.sources import guarded
from plenum.sources.stored import StoredTable, exists
from plenum.sources.tables import read, work_folder
from plenum.streaming import cache, conversations, delivery, frames, recovery

#: Slices of a stream: this many, or as many as keep a slice below so many rows.
SLICES, SLICE_ROWS = 6, 200_000


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events, with times that streams take for event time."""
    return read(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))


def _sliced(rows: DataFrame, at: str, slices: int = SLICES) -> tuple[DataFrame, int]:
    """rows with _slice, a number from 0 that ascends with the time, and how many there are."""
    low, high, n = rows.agg(F.min(F.unix_micros(at)), F.max(F.unix_micros(at)), F.count(F.lit(1))).head()
    slices = max(slices, -(-n // SLICE_ROWS))
    if low is None:
        return rows.withColumn("_slice", F.lit(0)).filter(F.col(at).isNotNull()), 1
    return rows.withColumn("_slice", F.floor((F.unix_micros(at) - low) * slices / (high - low + 1)).cast("int")).filter("_slice IS NOT NULL"), slices


def _arrive(dealt: DataFrame, slices: range, folder: str) -> None:
    """Writes one more file into a stream's folder for each of these slices, all that have rows in one pass.

    A stream takes files by their time, so the files get times in the order of
    their slices; the file system must keep them (local ones and HDFS do).
    """
    spark = dealt.sparkSession
    dealt.repartitionById(slices.stop, "_slice").write.mode("append").partitionBy("_slice").parquet(folder)
    path = spark._jvm.org.apache.hadoop.fs.Path
    files, now = path(folder).getFileSystem(spark._jsc.hadoopConfiguration()), time.time_ns() // 1_000_000
    for k in slices:
        at = f"{folder}/_slice={k}"
        if not exists(spark, at):
            spark.createDataFrame([], dealt.drop("_slice").schema).write.parquet(at)
        for file in files.listStatus(path(at)):
            files.setTimes(file.getPath(), now + k, -1)
            if files.getFileStatus(file.getPath()).getModificationTime() != now + k:
                raise ValueError(f"the file system of {folder} does not keep the times of files, so slices can't be put in order")


def _arrived(spark: SparkSession, schema: StructType, folder: str) -> DataFrame:
    """The slices in a folder as a streaming frame, one a batch; schema: as they were dealt."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(folder).drop("_slice")


def by_slices(rows: DataFrame, at: str, slices: int = SLICES) -> DataFrame:
    """rows as a streaming frame that gets one slice of time a batch; rows without a time aren't in any."""
    folder = work_folder(rows.sparkSession)
    dealt, n = _sliced(rows, at, slices)
    _arrive(dealt, range(n), folder)
    return _arrived(rows.sparkSession, dealt.schema, folder)


def cached_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lookups answered from a cache that keeps an answer for an hour; the answer is the lookup that fetched it."""
    query = F.concat(F.lit(" "), F.initcap("event_type"), F.lit(" "), (F.col("user_id") % 10).cast("string"), F.lit("\t"))
    lookups = _events(spark, sf_dir).select(query.alias("query"), F.col("event_id").alias("id"), F.col("ts").alias("asked_at"), F.col("event_id").cast("string").alias("found"))
    folder = work_folder(spark)
    found = cache.answered(by_slices(lookups, "asked_at"))
    conversations.run_to_end(found, folder, "append", lambda rows, n: rows.write.mode("overwrite").parquet(f"{folder}/rows/batch={n}"))
    return spark.read.parquet(f"{folder}/rows").select("query", "id", "answer", "hit", F.date_format("fetched_at", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("fetched_at"))


CACHED = """
WITH RECURSIVE look AS (
  SELECT lower(event_type) || ' ' || user_id % 10 AS query, event_id AS id, ts FROM events
), fetched AS (
  SELECT query, min(ts) AS ts FROM look GROUP BY query
  UNION ALL
  SELECT f.query, min(l.ts) FROM fetched f JOIN look l ON l.query = f.query AND l.ts >= f.ts + INTERVAL 1 HOUR GROUP BY f.query
), answer AS (
  SELECT f.query, f.ts, min(l.id) AS id FROM fetched f JOIN look l ON l.query = f.query AND l.ts = f.ts GROUP BY f.query, f.ts
)
SELECT l.query, l.id, CAST(a.id AS VARCHAR) AS answer, l.id <> a.id AS hit, strftime(a.ts, '%Y-%m-%d %H:%M:%S.%f') AS fetched_at
FROM look l ASOF JOIN answer a ON l.query = a.query AND l.ts >= a.ts
"""


def _socket(connection: str, payload: str) -> None:
    """Stands for a connection's send; a name that ends in x is stale."""
    if connection.endswith("x"):
        raise ConnectionError(connection)


def deliveries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events sent to each open connection of their receivers, with the stream run twice over the same log: how many went, and how many were lost to a stale one."""
    events = _events(spark, sf_dir).select(F.col("user_id").alias("to"), F.col("event_id").cast("string").alias("id"), F.col("ts").alias("created_at"), F.col("event_type").alias("type"))
    stale = F.when(F.col("o_orderpriority") == "1-URGENT", "x").otherwise("")
    connections = read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("user"), F.concat(F.col("o_orderkey").cast("string"), stale).alias("connection"), (F.col("o_orderstatus") != "F").alias("open"))
    stream, log = by_slices(events, "created_at"), work_folder(spark)
    live = delivery.kept(connections)
    try:
        for again in range(2):
            conversations.run_to_end(stream, f"{log}/{again}", "append", lambda batch, n: delivery.deliver(batch, n, live, _socket, log))
    finally:
        live.unpersist()
    return delivery.outcomes(spark, log).groupBy("connection").agg(F.count_if("sent").alias("sent"), F.count_if(~F.col("sent")).alias("stale"), F.count_if(F.col("sent").isNull()).alias("unknown"))


def frames_by_kind(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw frames from a stream, dealt into events and rejects in one parse: how many of each kind, type and partner."""
    good = F.to_json(F.struct(F.lit("message").alias("type"), F.col("user_id").cast("string").alias("partner_id"), F.col("props").alias("text"), F.col("ts").alias("created_at"), F.lit(False).alias("thread_open")))
    value = (
        F.when(F.col("event_type") == "error", F.substring(good, 1, 30))
        .when(F.col("event_type") == "view", F.concat(F.lit('{"type":"typing","partner_id":"'), F.col("user_id").cast("string"), F.lit('"}')))
        .when(F.col("event_type") == "signup", F.lit('{"type":"message","text":"no partner"}'))
        .when(F.col("value") > 50, F.lit(None))
        .otherwise(good)
    )
    raw, folder = _events(spark, sf_dir).select(value.alias("value"), "ts"), work_folder(spark)
    conversations.run_to_end(by_slices(raw, "ts").select("value"), folder, "append", lambda batch, n: frames.into_two(batch, n, f"{folder}/events", f"{folder}/rejects"))
    events = spark.read.parquet(f"{folder}/events").select(F.lit(frames.GOOD).alias("kind"), "type", "partner_id")
    rejects = spark.read.parquet(f"{folder}/rejects").select("kind", "type", F.lit(None).cast("string").alias("partner_id"))
    return events.unionByName(rejects).groupBy("kind", "type", "partner_id").agg(F.count(F.lit(1)).alias("n"))


class Interrupted(Exception):
    """Stands for the loss of the process."""


def _interrupted(apply, batch: int, before: bool):
    """apply, but at one batch it stops the stream, before or after its work."""

    def one(rows: DataFrame, n: int) -> None:
        if n == batch and before:
            raise Interrupted
        apply(rows, n)
        if n == batch:
            raise Interrupted

    return one


def message_stream_recovered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversation state after a batch that was done twice, an outage whose messages never came by the stream, and a second interruption.

    Each slice of time arrives together with the last hour of the slice before,
    so messages are delivered again; the third slice never arrives and is made up
    for by a snapshot, which also holds messages that the stream delivers later.
    """
    sent = _events(spark, sf_dir).select(F.col("event_id").cast("string").alias("id"), F.col("user_id").cast("string").alias("partner_id"), F.col("event_type").alias("text"), F.col("ts").alias("created_at"), (F.col("event_type") == "view").alias("thread_open"))
    dealt, n = _sliced(sent, "created_at")
    folder = work_folder(spark)
    table = recovery.state_table(spark, f"{folder}/state")
    hour = timedelta(hours=1)
    ends = {r["_slice"]: r["till"] for r in dealt.groupBy("_slice").agg(F.max("created_at").alias("till")).collect()}  # one row per slice
    till = spark.createDataFrame(list(ends.items()), "_slice int, _till timestamp")
    again = F.when(F.col("created_at") > F.col("_till") - hour, F.col("_slice") + 1)
    twice = dealt.join(F.broadcast(till), "_slice").withColumn("_slice", F.explode(F.array_compact(F.array("_slice", again)))).select(dealt.columns)
    stream = lambda: recovery.once(_arrived(spark, dealt.schema, f"{folder}/live"))

    def arrive(slices: range) -> None:
        _arrive(twice.filter(F.col("_slice").between(slices.start, slices.stop - 1)), slices, f"{folder}/live")

    def run(apply) -> None:
        try:
            recovery.start(stream(), f"{folder}/log", apply).awaitTermination()
        except Exception as e:
            if Interrupted.__name__ not in str(e):
                raise

    arrive(range(2))
    plain = recovery.take_up(table)
    run(_interrupted(plain, 1, before=False))  # done, but not noted as done: comes again
    run(plain)
    snapshot = ends.get(2, ends.get(1, ends.get(0)))  # the outage: slice 2 is in the snapshot only
    if snapshot is not None:
        recovery.refresh(table, sent, snapshot, batch=1)
    arrive(range(3, n))
    later = recovery.take_up(table, snapshot)
    run(_interrupted(later, 3, before=True))
    run(later)
    return table.rows().select("partner_id", "last_message", F.col("last_time").cast("timestamp_ntz").alias("last_time"), "unread")


def _people(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("organization"), F.round(F.col("c_acctbal") * 100).cast("long").alias("visits"))


def stored_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stored table after an upsert of orders' customers, an update of one segment and a delete of one nation's, each writing only the partitions it touches."""
    people, orders = _people(spark, sf_dir), read(spark, sf_dir, "orders")
    table = StoredTable(spark, work_folder(spark), ["id"]).create(people)
    table.upsert(orders.filter("o_orderstatus = 'P'").groupBy((F.col("o_custkey") + F.when(F.col("o_orderpriority") == "5-LOW", 1_000_000).otherwise(0)).alias("id")).agg(F.lit("seen").alias("name"), F.lit(None).cast("string").alias("organization"), F.count(F.lit(1)).alias("visits")))
    table.update(people.filter("organization = 'BUILDING'").select("id"), visits=F.col("visits") + 1, organization=F.lit("building"))
    table.delete(read(spark, sf_dir, "customer").filter("c_nationkey = 7").select(F.col("c_custkey").alias("id")))
    table.merge(orders.groupBy(F.col("o_custkey").alias("id")).agg(F.count(F.lit(1)).alias("visits")), {"name": F.coalesce("old.name", F.lit("new")), "organization": F.col("old.organization"), "visits": F.coalesce("old.visits", F.lit(0)) + F.col("new.visits")})
    return table.rows()


STORED = """
WITH people AS (SELECT c_custkey AS id, c_name AS name, c_mktsegment AS organization, CAST(round(c_acctbal * 100) AS BIGINT) AS visits FROM customer),
changes AS (SELECT o_custkey + CASE WHEN o_orderpriority = '5-LOW' THEN 1000000 ELSE 0 END AS id, count(*) AS visits FROM orders WHERE o_orderstatus = 'P' GROUP BY 1),
upserted AS (SELECT * FROM people WHERE id NOT IN (SELECT id FROM changes) UNION ALL SELECT id, 'seen', NULL, visits FROM changes),
updated AS (SELECT u.id, u.name, CASE WHEN p.id IS NOT NULL THEN 'building' ELSE u.organization END AS organization, u.visits + CASE WHEN p.id IS NOT NULL THEN 1 ELSE 0 END AS visits
            FROM upserted u LEFT JOIN (SELECT id FROM people WHERE organization = 'BUILDING') p ON p.id = u.id),
kept AS (SELECT * FROM updated WHERE id NOT IN (SELECT c_custkey FROM customer WHERE c_nationkey = 7)),
visits AS (SELECT o_custkey AS id, count(*) AS n FROM orders GROUP BY 1)
SELECT coalesce(k.id, v.id) AS id, CASE WHEN k.id IS NULL THEN 'new' ELSE k.name END AS name, k.organization, CAST(coalesce(k.visits, 0) + coalesce(v.n, 0) AS BIGINT) AS visits FROM kept k FULL JOIN visits v ON v.id = k.id
"""


def writes_checked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Saved and followed conferences written against their declaration: who broke which rules, and what was accepted."""
    kind = "CASE event_type WHEN 'click' THEN 'saved' WHEN 'view' THEN 'followed' WHEN 'purchase' THEN 'bought' END AS type"
    rows = _events(spark, sf_dir).selectExpr("CAST(event_id AS STRING) AS id", "concat('u', user_id) AS user_id", "concat('c', event_id % 31) AS conference_id", kind, "ts AS created_at")
    users = read(spark, sf_dir, "customer").filter("c_mktsegment <> 'MACHINERY'").selectExpr("concat('u', c_custkey) AS id")
    folder = work_folder(spark)
    guarded.write(rows, "conference_interactions", folder, {"users": users}, F.col("created_at"), F.col("id"))
    good = guarded.accepted(spark, folder).select("id", F.lit("").alias("reasons"))
    return good.unionByName(guarded.quarantined(spark, folder).select("id", F.array_join("_reasons", "; ").alias("reasons")))


CHECKED = """
WITH rows AS (
  SELECT CAST(event_id AS VARCHAR) AS id, 'u' || user_id AS user_id, 'c' || event_id % 31 AS conference_id,
         CASE event_type WHEN 'click' THEN 'saved' WHEN 'view' THEN 'followed' WHEN 'purchase' THEN 'bought' END AS type, ts AS created_at FROM events
), placed AS (
  SELECT *, row_number() OVER (PARTITION BY user_id, conference_id, type ORDER BY created_at, id) AS place FROM rows
)
SELECT id, concat_ws('; ', CASE WHEN type IS NULL THEN 'type is null' END, CASE WHEN type = 'bought' THEN 'type is not allowed' END,
                     CASE WHEN type IS NOT NULL AND place > 1 THEN 'user_id conference_id type is taken' END,
                     CASE WHEN user_id NOT IN (SELECT 'u' || c_custkey FROM customer WHERE c_mktsegment <> 'MACHINERY') THEN 'user_id is not in users' END) AS reasons
FROM placed
"""

QUERIES = {
    "cached_answers": (cached_answers, CACHED),
    "deliveries": (deliveries, "SELECT connection, count(*) FILTER (WHERE connection NOT LIKE '%x') AS sent, count(*) FILTER (WHERE connection LIKE '%x') AS stale, CAST(0 AS BIGINT) AS unknown FROM (SELECT o_custkey, CASE WHEN o_orderpriority = '1-URGENT' THEN o_orderkey || 'x' ELSE CAST(o_orderkey AS VARCHAR) END AS connection FROM orders WHERE o_orderstatus <> 'F') c JOIN events ON user_id = o_custkey GROUP BY connection"),
    "frames_by_kind": (frames_by_kind, "SELECT kind, type, partner_id, count(*) AS n FROM (SELECT CASE WHEN event_type = 'error' THEN 'malformed' WHEN event_type IN ('view', 'signup') THEN 'foreign' WHEN value > 50 THEN 'malformed' ELSE 'good' END AS kind, CASE WHEN event_type = 'view' THEN 'typing' WHEN event_type = 'signup' THEN 'message' WHEN event_type = 'error' OR value > 50 THEN NULL ELSE 'message' END AS type, CASE WHEN event_type NOT IN ('error', 'view', 'signup') AND (value > 50) IS NOT TRUE THEN CAST(user_id AS VARCHAR) END AS partner_id FROM events) f GROUP BY kind, type, partner_id"),
    "message_stream_recovered": (message_stream_recovered, "SELECT CAST(user_id AS VARCHAR) AS partner_id, arg_max(event_type, ts) AS last_message, max(ts) AS last_time, count(*) FILTER (WHERE event_type <> 'view') AS unread FROM events GROUP BY user_id"),
    "stored_changes": (stored_changes, STORED),
    "writes_checked": (writes_checked, CHECKED),
}


def queries() -> dict:
    return {name: query for name, (query, _) in QUERIES.items()}


def oracles() -> dict[str, str]:
    return {name: text for name, (_, text) in QUERIES.items()}

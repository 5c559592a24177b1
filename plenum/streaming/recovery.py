"""Conversation state that survives interruptions: a stored table, batches that may be repeated, and snapshots after an outage."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from plenum.sources.stored import StoredTable

#: since: messages up to this time are in the row by a snapshot; batch: the last batch that the row has taken up.
STATE = "partner_id string, last_message string, last_time timestamp, unread long, since timestamp, batch long"


def once(live: DataFrame, within: str = "1 hour") -> DataFrame:
    """A streaming frame of messages (id, partner_id, text, created_at, thread_open), each id once although the source may deliver it again.

    The ids of the last ``within`` of event time are the state. Messages later than that are left out.
    """
    return live.withWatermark("created_at", within).dropDuplicatesWithinWatermark(["id"])


def _summed(messages: DataFrame) -> DataFrame:
    latest = F.max(F.struct("created_at", "id", "text"))
    return messages.groupBy("partner_id").agg(latest["text"].alias("last_message"), F.max("created_at").alias("last_time"), F.count_if(~F.coalesce("thread_open", F.lit(False))).alias("unread"))


def state_table(spark: SparkSession, path: str, buckets: int = 16) -> StoredTable:
    """An empty table of states."""
    return StoredTable(spark, path, ["partner_id"], buckets).create(spark.createDataFrame([], STATE))


def refresh(table: StoredTable, messages: DataFrame, at, batch: int) -> None:
    """Snapshot after an outage: all rows anew from the server's messages up to the time at; live messages up to then won't count again.

    batch: the last batch that was taken up before the snapshot. Conversations
    without a message so far start their count at the same time when they come up.
    """
    rows = _summed(messages.filter(F.col("created_at") <= F.lit(at)))
    table.upsert(rows.select("partner_id", "last_message", "last_time", "unread", F.lit(at).cast("timestamp").alias("since"), F.lit(batch).cast("long").alias("batch")))


def take_up(table: StoredTable, since=None) -> Callable[[DataFrame, int], None]:
    """For foreachBatch: adds a batch's messages to the table.

    A row remembers its last batch, so a repeated batch changes only rows that
    didn't get it. since: the time of the last snapshot, None without any.
    """

    def one(batch: DataFrame, n: int) -> None:
        new = batch if since is None else batch.filter(F.col("created_at") > F.lit(since))
        changes = _summed(new).withColumn("batch", F.lit(n).cast("long")).persist()  # the stream's state is worked off once, though a merge reads its changes twice
        old = lambda c: F.col(f"old.{c}")
        due = F.coalesce(old("batch") < F.col("new.batch"), F.lit(True))
        later = due & F.coalesce(F.col("new.last_time") >= old("last_time"), F.lit(True))
        try:
            table.merge(changes, {
                "last_message": F.when(later, F.col("new.last_message")).otherwise(old("last_message")),
                "last_time": F.when(later, F.col("new.last_time")).otherwise(old("last_time")),
                "unread": F.coalesce(old("unread"), F.lit(0)) + F.when(due, F.col("new.unread")).otherwise(F.lit(0)),
                "since": old("since"),
                "batch": F.greatest(old("batch"), F.col("new.batch")),
            })
        finally:
            changes.unpersist()

    return one


def start(stream: DataFrame, log: str, apply: Callable[[DataFrame, int], None]) -> StreamingQuery:
    """Starts, or goes on after an interruption, from the log: batches that weren't finished are done again with the same rows and number."""
    return stream.writeStream.option("checkpointLocation", log).trigger(availableNow=True).foreachBatch(apply).start()

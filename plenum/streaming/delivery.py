"""Delivery of events to every open connection of their receivers, at most once."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plenum.sources.stored import exists


#: Rows of the log: what became of a claim.
OUTCOME = "id string, connection string, sent boolean"


def open_by_user(connections: DataFrame) -> DataFrame:
    """A row per user (to) with all of its open connections, of a row per connection (user, connection, open)."""
    return connections.filter("open").groupBy(F.col("user").alias("to")).agg(F.collect_set("connection").alias("all"))


def kept(connections: DataFrame) -> DataFrame:
    """open_by_user for a caller whose connections stay the same over many batches: made once, and laid out so that only a batch's events are moved to meet them.

    The caller ends it by unpersist(). The events of one receiver and batch meet
    their connections in one task, so the batches should be bounded.
    """
    parts = int(connections.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return open_by_user(connections.withColumn("to", F.col("user")).repartition(parts, "to")).sortWithinPartitions("to").persist()


def fan_out(events: DataFrame, connections: DataFrame) -> DataFrame:
    """A row per event (to, id, ...) and open connection of its receiver, with the event as JSON text in payload.

    connections: a row per connection (user, connection, open), or what
    open_by_user or kept made of them. Receivers without an open connection get
    nothing. Connections are reduced to one row per user before they meet the
    events, so an event is moved once, to its receiver; of a receiver with very
    many events, adaptive execution splits the rows.
    """
    live = connections if connections.columns == ["to", "all"] else open_by_user(connections)
    sent = events.select("to", "id", "created_at", F.to_json(F.struct(*[c for c in events.columns if c != "to"])).alias("payload"))
    return sent.join(live, "to").select("to", "id", "created_at", "payload", F.explode("all").alias("connection"))


def _send_all(send: Callable[[str, str], None]) -> Callable:
    def send_all(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            went = []
            for connection, payload in zip(rows["connection"], rows["payload"], strict=True):
                try:
                    send(connection, payload)
                    went.append(True)
                except Exception:  # noqa: BLE001 a stale connection must not keep the others from their events
                    went.append(False)
            yield rows[["id", "connection"]].assign(sent=went)

    return send_all


def deliver(batch: DataFrame, n: int, connections: DataFrame, send: Callable[[str, str], None], log: str) -> None:
    """For foreachBatch: sends each event of batch n to all open connections of its receiver, in order per connection, and logs it.

    send gets the connection and the payload, runs on the executors, and fails
    where the connection is stale; other connections are served all the same.
    What is to be sent is claimed in the log before anything is sent. A batch
    that is repeated after an interruption finds its claims and sends nothing
    again: delivery is at most once, and claims without an outcome are events
    that may be lost. (A task that Spark itself runs twice sends its rows
    twice; id and connection tell such pairs apart from new events.)
    """
    claims = f"{log}/claims/batch={n}"
    if exists(batch.sparkSession, f"{claims}/_SUCCESS"):
        return
    sent = fan_out(batch, connections)
    sent.write.mode("overwrite").parquet(claims)
    claimed = batch.sparkSession.read.schema(sent.schema).parquet(claims).repartition("connection").sortWithinPartitions("connection", "created_at", "id").select("id", "connection", "payload")
    claimed.mapInPandas(_send_all(send), OUTCOME).write.mode("overwrite").parquet(f"{log}/outcomes/batch={n}")


def outcomes(spark, log: str) -> DataFrame:
    """batch, id, connection, sent: true, false for a stale connection, null where a claim has no outcome.

    A batch that was finished has an outcome for each claim; only the claims of
    the others are compared with their outcomes.
    """
    claims = spark.read.parquet(f"{log}/claims").select("batch", "id", "connection")
    path = spark._jvm.org.apache.hadoop.fs.Path
    files = path(log).getFileSystem(spark._jsc.hadoopConfiguration())
    batches = [int(d.getPath().getName().removeprefix("batch=")) for d in files.listStatus(path(f"{log}/claims")) if d.getPath().getName().startswith("batch=")]
    unfinished = [n for n in batches if not exists(spark, f"{log}/outcomes/batch={n}/_SUCCESS")]
    if len(unfinished) == len(batches) and not exists(spark, f"{log}/outcomes"):
        return claims.withColumn("sent", F.lit(None).cast("boolean"))
    found = spark.read.schema(f"{OUTCOME}, batch int").parquet(f"{log}/outcomes").select("batch", "id", "connection", "sent")
    if not unfinished:
        return found
    open_ = F.col("batch").isin(unfinished)
    return found.filter(~open_).unionByName(claims.filter(open_).join(found.filter(open_), ["batch", "id", "connection"], "left"))

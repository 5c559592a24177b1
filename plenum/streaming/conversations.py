"""Conversation state, thread logs and delivery from a stream of message events."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

EVENT = "struct<type:string,partner_id:string,text:string,created_at:timestamp,thread_open:boolean>"
#: Kinds of events: a message, and what sets a thread's unread count back.
MESSAGE, RESETS = "message", ("open", "read")
#: Parts that partners are dealt to where state has resets.
PARTS = 256
#: Microseconds that stand for no time.
NEVER = -(2**63)
_HELD = {"partner_id": pa.string(), "text": pa.string(), "last": pa.int64(), "unread": pa.int64(), "read": pa.int64()}


def frames(raw: DataFrame, *kinds: str) -> DataFrame:
    """raw: value (JSON text). The events of these kinds; malformed frames and other kinds are dropped."""
    parsed = raw.select(F.from_json("value", EVENT).alias("e")).select("e.*")
    return parsed.filter(F.col("type").isin(*kinds) & F.col("partner_id").isNotNull())


def messages(raw: DataFrame) -> DataFrame:
    return frames(raw, MESSAGE)


def state(events: DataFrame) -> DataFrame:
    """partner_id, last_message, last_time, unread; a streaming or a batch frame. Messages of an open thread count as read.

    Aggregates only, so that every part of a key's events is reduced before the shuffle. In update mode each batch writes the keys that it changed.
    """
    latest = F.max(F.struct("created_at", "text"))
    return events.groupBy("partner_id").agg(latest["text"].alias("last_message"), F.max("created_at").alias("last_time"), F.count_if(~F.coalesce("thread_open", F.lit(False))).alias("unread"))


def _packed(**columns: np.ndarray) -> bytes:
    """The state of one part: a row per partner."""
    table = pa.table({c: pa.array(v, _HELD[c], from_pandas=True) for c, v in columns.items()})
    with pa.BufferOutputStream() as to:
        with pa.ipc.new_stream(to, table.schema) as writer:
            writer.write_table(table)
        return to.getvalue().to_pybytes()


def _unpacked(state: bytes) -> dict[str, np.ndarray]:
    table = pa.ipc.open_stream(state).read_all()
    return {c: table[c].to_numpy() for c in table.column_names}


def _newest(code: np.ndarray, at: np.ndarray, text: pd.Series) -> np.ndarray:
    """The places of the last message of each code by time, then text; no text comes first."""
    order = np.lexsort((pd.factorize(text, sort=True)[0], at, code))
    return order[np.append(code[order][1:] != code[order][:-1], True)] if len(order) else order


def _advance(key: tuple, batches: Iterator[pd.DataFrame], held: GroupState) -> Iterator[pd.DataFrame]:
    came = pd.concat(batches, ignore_index=True)
    had = _unpacked(held.get[0]) if held.exists else {"partner_id": np.empty(0, object)}
    code, partners = pd.factorize(np.concatenate([had["partner_id"], came["partner_id"].to_numpy(object)]), use_na_sentinel=False)
    known, code = len(had["partner_id"]), code[len(had["partner_id"]) :]  # those of before keep their places

    def before(column: str, other) -> np.ndarray:
        values = np.full(len(partners), other, object if other is None else np.int64)
        values[:known] = had[column] if known else values[:known]
        return values

    text, last, unread, read = before("text", None), before("last", NEVER), before("unread", 0), before("read", NEVER)
    at, sent = came["at"].to_numpy(), came["sent"].to_numpy(bool)
    reset = np.full(len(partners), NEVER, np.int64)
    np.maximum.at(reset, code[~sent], at[~sent])
    unread[(reset > read) & (reset >= last)] = 0
    read = np.maximum(read, reset)
    counted = sent & ((read[code] == NEVER) | (at > read[code]))
    unread += np.bincount(code[counted], minlength=len(partners))
    newest = np.flatnonzero(sent)[_newest(code[sent], at[sent], came["text"][sent])]
    newest = newest[at[newest] >= last[code[newest]]]
    text[code[newest]], last[code[newest]] = came["text"].to_numpy(object)[newest], at[newest]
    held.update((_packed(partner_id=partners, text=text, last=last, unread=unread, read=read),))
    changed = np.unique(code)
    yield pd.DataFrame({"partner_id": partners[changed], "last_message": text[changed], "last": last[changed], "unread": unread[changed]})


def state_with_resets(events: DataFrame, parts: int = PARTS) -> DataFrame:
    """partner_id, last_message, last_time, unread of a streaming frame of messages and resets (type, partner_id, text, created_at); in update mode.

    A reset sets the count back; messages after it, by time, count again. Within
    a batch events may come in any order; a batch that arrives late counts its
    messages against the last reset. Partners are dealt to ``parts`` parts by a
    hash, and Python is called once per part and batch, with the columns of all
    its events; the state of a part is one small table. A part's state (about 50
    bytes and two texts per partner) and its events of one batch are held in
    memory, so parts should grow with the partners, and the source's batches
    should be bounded (maxFilesPerTrigger). A stream keeps the number it began with.
    """
    at = F.coalesce(F.unix_micros("created_at"), F.lit(NEVER))
    part = F.pmod(F.xxhash64("partner_id"), F.lit(parts)).cast("int")
    rows = events.select(part.alias("part"), "partner_id", F.coalesce(F.col("type") == MESSAGE, F.lit(False)).alias("sent"), "text", at.alias("at"))
    out = "partner_id string, last_message string, last long, unread long"
    state = rows.groupBy("part").applyInPandasWithState(_advance, out, "held binary", "update", GroupStateTimeout.NoTimeout)
    return state.select("partner_id", "last_message", F.when(F.col("last") != NEVER, F.timestamp_micros("last")).alias("last_time"), "unread")


def latest_of_updates(updates: DataFrame) -> DataFrame:
    """The newest row of each key from the rows of all batches (batch: their number)."""
    newest = F.max_by(F.struct("last_message", "last_time", "unread"), "batch")
    return updates.groupBy("partner_id").agg(newest.alias("s")).select("partner_id", "s.*")


def routed(events: DataFrame) -> DataFrame:
    """Events dealt by receiver (to) and in order, for delivery."""
    return events.repartition("to").sortWithinPartitions("to", "created_at")


def deliver(batch: DataFrame, send: Callable[[str, dict], None]) -> None:
    """Sends each event of a batch to its receiver from the executors, in order; a failure is dropped with its event (at most once)."""

    def each(rows: Iterator) -> None:
        for r in rows:
            try:
                send(r["to"], r.asDict())
            except Exception:  # noqa: BLE001 the receiver may be gone
                continue

    routed(batch).foreachPartition(each)


def run_to_end(stream: DataFrame, folder: str, mode: str, keep: Callable[[DataFrame, int], None]) -> None:
    """Runs a stream until its source is read, each batch through keep; its log in folder."""
    stream.writeStream.outputMode(mode).option("checkpointLocation", f"{folder}/log").trigger(availableNow=True).foreachBatch(keep).start().awaitTermination()


def fresh(answers: DataFrame, now: Column, seconds: int = 3600) -> DataFrame:
    """The newest answer (query, answer, fetched_at) of each normalised query that isn't older than that; a cache with a time to live."""
    key = F.lower(F.trim("query"))
    kept = answers.filter(F.col("fetched_at") > now - F.make_dt_interval(secs=F.lit(seconds)))
    return kept.groupBy(key.alias("query")).agg(F.max_by("answer", F.struct("fetched_at", "answer")).alias("answer"))

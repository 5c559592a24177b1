"""Answers kept for an hour: a cache with a time to live, as state of a stream."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from plenum.functions.text import strip

#: How long an answer holds: one hour.
SECONDS = 3600
_ROWS = "query string, id long, asked long, answer string, fetched long, hit boolean"
_HELD = "answer string, fetched long"


def _look_up(micros: int) -> Callable:
    def look_up(key: tuple, batches: Iterator[pd.DataFrame], held: GroupState) -> Iterator[pd.DataFrame]:
        if held.hasTimedOut:
            held.remove()
            return
        came = pd.concat(batches, ignore_index=True).sort_values(["asked", "id"], kind="stable")
        asked, found = came["asked"].to_numpy(), came["found"].to_numpy(dtype=object)
        answer, fetched = held.get if held.exists else (None, None)
        answers, times, hits = np.empty(len(asked), object), np.empty(len(asked), np.int64), np.ones(len(asked), bool)
        at = 0
        while at < len(asked):  # one step per fetch
            if fetched is None or asked[at] >= fetched + micros:
                answer, fetched, hits[at] = found[at], int(asked[at]), False
            till = max(at + 1, int(np.searchsorted(asked, fetched + micros)))
            answers[at:till], times[at:till] = answer, fetched
            at = till
        ends = (fetched + micros) // 1000  # state has milliseconds
        if ends > held.getCurrentWatermarkMs():
            held.update((answer, fetched))
            held.setTimeoutTimestamp(ends)
        elif held.exists:
            held.remove()
        yield pd.DataFrame({"query": key[0], "id": came["id"].to_numpy(), "asked": asked, "answer": answers, "fetched": times, "hit": hits})

    return look_up


def answered(lookups: DataFrame, seconds: int = SECONDS, late: str = "10 minutes") -> DataFrame:
    """query, id, asked_at, answer, fetched_at, hit of a streaming frame of lookups: id, query, asked_at, found (what a fetch brings at that time).

    Queries are the same without outer white space and in lower case. The first
    lookup fetches; later ones get its answer until ``seconds`` have passed since
    then, and the next one fetches again. An entry is dropped by a timer on event
    time as soon as the watermark shows that no lookup can use it any more, so
    the state holds the queries of the last hour (and ``late``) only. Lookups
    are taken in the order of asked_at inside a batch, and as they arrive across
    batches; those later than ``late`` are left out. A query's lookups of one
    batch are sorted in memory, so the source's batches should be bounded.
    """
    rows = lookups.select(F.lower(strip(F.coalesce("query", F.lit("")))).alias("query"), "id", "asked_at", F.unix_micros("asked_at").alias("asked"), "found")
    state = rows.withWatermark("asked_at", late).groupBy("query").applyInPandasWithState(_look_up(seconds * 1_000_000), _ROWS, _HELD, "append", GroupStateTimeout.EventTimeTimeout)
    return state.select("query", "id", F.timestamp_micros("asked").alias("asked_at"), "answer", F.timestamp_micros("fetched").alias("fetched_at"), "hit")

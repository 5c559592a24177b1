"""Raw JSON frames as a source: one parse, with what can't be used kept beside what can."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plenum.streaming.conversations import EVENT, MESSAGE

BROKEN = "_broken"
#: Kinds of frames: to be used, well-formed but of another type or without a partner, and malformed.
GOOD, FOREIGN, MALFORMED = "good", "foreign", "malformed"


def sorted_frames(raw: DataFrame, types: Iterable[str] = (MESSAGE,)) -> DataFrame:
    """raw (value: JSON text) with kind and the fields of the event; a batch or a streaming frame.

    A frame that isn't a JSON object, or a field of another type than declared,
    makes it malformed; null counts as malformed. value is kept.
    """
    schema = f"{EVENT.removesuffix('>')},{BROKEN}:string>"
    parsed = raw.withColumn("e", F.from_json("value", schema, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": BROKEN}))
    malformed = F.col("e").isNull() | F.col(f"e.{BROKEN}").isNotNull()
    usable = F.coalesce(F.col("e.type").isin(list(types)) & F.col("e.partner_id").isNotNull(), F.lit(False))
    kind = F.when(malformed, MALFORMED).when(usable, GOOD).otherwise(FOREIGN)
    return parsed.select("value", kind.alias("kind"), "e.*").drop(BROKEN)


def into_two(batch: DataFrame, n: int, events: str, rejects: str) -> None:
    """For foreachBatch: writes the events of batch n to one folder and the frames that can't be used, with their kind, to another.

    The batch is parsed once and kept while both are written. Each batch has a
    folder of its own, so a repeated batch replaces what it wrote before.
    """
    parsed = sorted_frames(batch).persist()
    try:
        parsed.filter(F.col("kind") == GOOD).drop("value", "kind").write.mode("overwrite").parquet(f"{events}/batch={n}")
        parsed.filter(F.col("kind") != GOOD).select("value", "kind", "type").write.mode("overwrite").parquet(f"{rejects}/batch={n}")
    finally:
        parsed.unpersist()

"""Exact de-duplication by content sort.

Rows are range-partitioned by sampled splitters over (head of the text, hash,
salt), each partition is sorted externally with the whole text as the last key,
and equal neighbours form a group. Only texts that occur very often get salts,
so no group of copies lands in one task; their groups are joined by a small
table of at most ``HOT_TEXTS`` rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: A text counts as hot above one row in HOT_TEXTS, so fewer than HOT_TEXTS texts are hot.
HOT_TEXTS = 10_000
#: ... and above this many rows.
HOT_ROWS = 200
#: Parts into which the rows of a hot text are dealt.
SALTS = 256


def grouped(docs: DataFrame, text: Column | None = None, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Adds _dd_keep_id, _dd_group_size, _dd_kept and _dd_sha to every row of docs. Counts the rows at once, to tell which texts are hot.

    docs: any columns, with doc_id and text. text: the normalised text (default:
    the text as it is). Null text counts as empty. Of equal texts the row with
    the largest doc_id stays, a null doc_id being the smallest; of rows that
    repeat that doc_id too, exactly one stays. An empty table gives an empty
    table. Other columns are carried along, whatever their names (names with
    the prefix ``_dd_`` are taken).
    """
    norm = F.coalesce(F.col("text") if text is None else text, F.lit(""))
    rows = docs.withColumns({"_dd_text": norm}).withColumns({"_dd_hash": F.xxhash64("_dd_text"), "_dd_head": F.substring("_dd_text", 1, 16)})
    least = max(hot_rows, docs.count() // HOT_TEXTS)
    hot = rows.groupBy("_dd_hash").agg(F.count(F.lit(1)).alias("_dd_n")).filter(F.col("_dd_n") > least).select("_dd_hash", F.lit(True).alias("_dd_hot"))
    # At most HOT_TEXTS rows: a proven bound for the broadcast.
    rows = rows.join(F.broadcast(hot), "_dd_hash", "left")
    salt = F.when(F.col("_dd_hot"), F.pmod(F.xxhash64("doc_id"), F.lit(SALTS))).otherwise(F.lit(0))
    ranged = rows.withColumn("_dd_salt", salt).repartitionByRange("_dd_head", "_dd_hash", "_dd_salt")
    equal = Window.partitionBy("_dd_head", "_dd_hash", "_dd_salt", "_dd_text")
    local = ranged.withColumns({
        "_dd_keep": F.max("doc_id").over(equal),
        "_dd_size": F.count(F.lit(1)).over(equal),
        "_dd_first": F.row_number().over(equal.orderBy(F.col("doc_id").desc_nulls_last())),
        "_dd_sha": F.sha2("_dd_text", 256),
    })
    # The hot texts' groups over all salts: pre-aggregated, at most HOT_TEXTS rows.
    whole = rows.filter("_dd_hot").groupBy(F.sha2("_dd_text", 256).alias("_dd_sha")).agg(F.max("doc_id").alias("_dd_all"), F.count(F.lit(1)).alias("_dd_alln"))
    out = local.join(F.broadcast(whole), "_dd_sha", "left").withColumns({
        "_dd_keep_id": F.when(F.col("_dd_alln").isNull(), F.col("_dd_keep")).otherwise(F.col("_dd_all")),
        "_dd_group_size": F.coalesce("_dd_alln", "_dd_size"),
    })
    # Rows of one doc_id share a salt; with a null keep_id every row of the group is in one salt.
    out = out.withColumn("_dd_kept", (F.col("_dd_first") == 1) & F.col("doc_id").eqNullSafe(F.col("_dd_keep_id")))
    return out.select(*[F.col(f"`{c}`") for c in docs.columns], "_dd_keep_id", "_dd_group_size", "_dd_kept", "_dd_sha")


def exact_dedup(docs: DataFrame, text: Column | None = None, hot_rows: int = HOT_ROWS) -> DataFrame:
    """One row per document, dropped ones too: doc_id, keep_id, group_size, kept, text_sha256."""
    return grouped(docs.select("doc_id", "text"), text, hot_rows).select("doc_id", F.col("_dd_keep_id").alias("keep_id"), F.col("_dd_group_size").cast("long").alias("group_size"), F.col("_dd_kept").alias("kept"), F.col("_dd_sha").alias("text_sha256"))


def keep_one(docs: DataFrame) -> DataFrame:
    """The rows of docs that stay, with the columns of docs."""
    return grouped(docs).filter("_dd_kept").select(*[F.col(f"`{c}`") for c in docs.columns])


SQL = """
SELECT doc_id,
       max(doc_id) OVER (PARTITION BY coalesce(text, '')) AS keep_id,
       CAST(count(*) OVER (PARTITION BY coalesce(text, '')) AS BIGINT) AS group_size,
       row_number() OVER (PARTITION BY coalesce(text, '') ORDER BY doc_id DESC NULLS LAST) = 1 AS kept,
       sha256(coalesce(text, '')) AS text_sha256
FROM documents
"""

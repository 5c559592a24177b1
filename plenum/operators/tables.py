"""Relational operators on frames: keyed merges, toggles, unions, search."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def upsert(table: DataFrame, changes: DataFrame, keys: Sequence[str]) -> DataFrame:
    """changes, and the rows of table whose keys aren't among them. Keys of changes are expected once each."""
    return table.join(changes.select(*keys), list(keys), "left_anti").select(table.columns).unionByName(changes, allowMissingColumns=True)


def insert_absent(table: DataFrame, rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """table, and one row of each new key."""
    return table.unionByName(rows.dropDuplicates(list(keys)).join(table.select(*keys), list(keys), "left_anti"), allowMissingColumns=True)


def toggle(table: DataFrame, rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows in one of the two only: what is there goes, what isn't comes."""
    gone = table.join(rows.select(*keys), list(keys), "left_anti").select(table.columns)
    new = rows.dropDuplicates(list(keys)).join(table.select(*keys), list(keys), "left_anti")
    return gone.unionByName(new, allowMissingColumns=True)


def mark_read(messages: DataFrame, conversation: Column, reader: Column, now: Column) -> DataFrame:
    """Sets read_at of the unread messages that others sent in a conversation."""
    unread = (F.col("conversation_id") == conversation) & (F.col("sender_id") != reader) & F.col("read_at").isNull()
    return messages.withColumn("read_at", F.when(unread, now).otherwise(F.col("read_at")))


def latest(table: DataFrame, keys: Sequence[str], *order: Column) -> DataFrame:
    """The first row of each key in this order: a partial top-1 before the shuffle keeps large keys cheap."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return table.withColumn("_rank", F.row_number().over(w)).filter("_rank = 1").drop("_rank")


def top(table: DataFrame, n: int, *order: Column) -> DataFrame:
    return table.orderBy(*order).limit(n)


def union_all(first: DataFrame, *others: DataFrame) -> DataFrame:
    """Rows of all; columns that some lack are null there."""
    for other in others:
        first = first.unionByName(other, allowMissingColumns=True)
    return first


def counted(table: DataFrame, keys: Sequence[str], **wanted: Column) -> DataFrame:
    """Per key, how many rows meet each condition."""
    return table.groupBy(*keys).agg(*(F.count_if(c).alias(name) for name, c in wanted.items()))


def search(table: DataFrame, query: str, texts: Sequence[str], lists: Sequence[str] = ()) -> DataFrame:
    """Rows with the query, as it stands and in any case, in a text column or an item of a list column; all for an empty query."""
    if not query:
        return table
    q = F.lit(query.lower())
    hit = F.lit(False)
    for c in texts:
        hit = hit | F.coalesce(F.contains(F.lower(c), q), F.lit(False))
    for c in lists:
        hit = hit | F.coalesce(F.exists(c, lambda x: F.contains(F.lower(x), q)), F.lit(False))
    return table.filter(hit)


def facets(table: DataFrame, **chosen: str | Sequence[str]) -> DataFrame:
    """Rows with the chosen value of each column ('All': any) or one of the chosen values (none: any)."""
    for c, value in chosen.items():
        if value and value != "All":
            table = table.filter(F.col(c) == value if isinstance(value, str) else F.col(c).isin(list(value)))
    return table


def inserted(table: DataFrame, rows: DataFrame) -> DataFrame:
    """table and rows; columns that rows lack are null."""
    return table.unionByName(rows, allowMissingColumns=True)


def updated(table: DataFrame, wanted: Column, **values: Column) -> DataFrame:
    """Sets columns where the condition holds, by literals or expressions over the old row; all see the old values."""
    met = F.coalesce(wanted, F.lit(False))
    return table.withColumns({c: F.when(met, v).otherwise(F.col(c)) for c, v in values.items()})


def patched(table: DataFrame, changes: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """Dynamic update: for rows whose key is in changes (once each), the columns that are not null there replace the old values."""
    new = changes.select(F.col(key), *(F.col(c).alias(f"_new_{c}") for c in columns))
    joined = table.join(new, key, "left").withColumns({c: F.coalesce(f"_new_{c}", c) for c in columns})
    return joined.select(table.columns)


def deleted(table: DataFrame, keys: DataFrame, on: Sequence[str]) -> DataFrame:
    """table without the rows whose key is in keys."""
    return table.join(keys.select(*on), list(on), "left_anti").select(table.columns)


def as_map(rows: DataFrame, owner: str, key: str, value: str) -> DataFrame:
    """owner, entries: a map from key to value for each owner. Keys of one owner are expected once each."""
    return rows.groupBy(owner).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(key, value)))).alias("entries"))


def lists_by(rows: DataFrame, owner: str, value: str, **wanted: Column) -> DataFrame:
    """owner, and for each condition the sorted array of values of the rows that meet it, in one pass."""
    return rows.groupBy(owner).agg(*(F.array_sort(F.collect_list(F.when(c, F.col(value)))).alias(name) for name, c in wanted.items()))

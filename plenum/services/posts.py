"""Community posts: filters, reactions and rankings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The counter of each reaction.
COUNTER = {"like": "likes", "celebrate": "celebrates", "insightful": "insightful", "kudos": "kudos"}


def counter_of(reaction: Column) -> Column:
    """The counter's name; null for an unknown reaction."""
    return F.create_map(*(F.lit(x) for kv in COUNTER.items() for x in kv))[reaction]


def reactions(post: str = "reactions") -> Column:
    """All reactions of a post, missing counters as 0."""
    return sum((F.coalesce(F.col(f"{post}.{c}"), F.lit(0)) for c in COUNTER.values()), F.lit(0))


def visible(posts: DataFrame, hidden: DataFrame) -> DataFrame:
    """Posts that aren't in hidden (post_id)."""
    return posts.join(hidden.select(F.col("post_id").alias("id")), "id", "left_anti")


def flagged(rows: DataFrame, flags: Column) -> DataFrame:
    """Rows whose id is true in a map of flags."""
    return rows.filter(F.coalesce(flags[F.col("id")], F.lit(False)))


def by_author(posts: DataFrame, name: str) -> DataFrame:
    return posts.filter(F.col("author") == name)


def total_reactions(posts: DataFrame) -> DataFrame:
    """author, total: reactions on an author's posts that aren't celebrations."""
    return posts.filter("post_type <> 'celebration'").groupBy("author").agg(F.sum(reactions()).alias("total"))


def with_keys(rows: DataFrame, keys: DataFrame, flag: str) -> DataFrame:
    """rows with a flag: whether the id is among the keys (id)."""
    there = keys.select("id").distinct().withColumn(flag, F.lit(True))
    return rows.join(there, "id", "left").withColumn(flag, F.coalesce(flag, F.lit(False)))


def prepended(new: Column, items: Column) -> Column:
    """A list with a new item at its head."""
    return F.concat(F.array(new), items)


def toggled(items: Column, item: Column) -> Column:
    """A list without the item if it held it, else with it at the end."""
    return F.when(F.array_contains(items, item), F.array_remove(items, item)).otherwise(F.array_append(items, item))


def added(items: Column, item: Column) -> Column:
    """A list that holds the item once."""
    return F.array_union(items, F.array(item))

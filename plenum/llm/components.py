"""Connected components of links, as joins and aggregations over written tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut

#: Rows of links and labels that one task gets, and the least number of tasks.
ROWS, TASKS = 100_000, 8


def components(links: DataFrame) -> DataFrame:
    """links: a, b (any sortable type). Returns node, label: the smallest node that can be reached, for every node with a link.

    Each round takes the least label among a node and its neighbours, and then
    that label's own label, so long chains halve; rounds end when nothing
    changes. Runs at once; the driver sees only whether a round changed anything.
    """
    ends = links.filter("a <> b").select(F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")), F.struct("a", F.col("a").alias("b")), F.struct(F.col("b").alias("a"), "b"))).alias("e"))
    both = cut(ends.select("e.*").distinct())  # each node is its own neighbour
    tasks = max(TASKS, both.count() // ROWS)  # a round is short, so what many near-empty files cost counts
    labels = cut(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("label")).coalesce(tasks))
    while True:
        near = both.join(labels, both.b == labels.node).groupBy("a").agg(F.min("label").alias("least"), F.max(F.when(F.col("a") == F.col("b"), F.col("label"))).alias("was"))
        jump = labels.select(F.col("node").alias("at"), F.col("label").alias("further"))
        found = cut(near.join(jump, F.col("least") == F.col("at")).select(F.col("a").alias("node"), F.col("further").alias("label"), (F.col("was") != F.col("further")).alias("changed")).coalesce(tasks))
        labels = found.select("node", "label")
        if found.filter("changed").isEmpty():
            return labels

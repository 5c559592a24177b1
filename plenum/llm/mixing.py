"""Mixing of sources to target weights along a time-varying curriculum.

Targets: each source's share of the token budget, filled up to a cap.
Curriculum: the weight schedule of a source is linear in training time; its
integral gives the cumulative token demand, whose inverse assigns a training
position to each document. Documents are then range-sorted by position.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, n_words

#: Weights dealt out to the sources in order, repeating.
WEIGHTS = (5.0, 2.0, 1.0)
#: The budget as a multiple of all sizes, and the most that a source gives as a multiple of its own.
BUDGET, CAP = 1.5, 2.0
#: Ends of the weight schedules, dealt out like WEIGHTS: weight at the start and the end of training, as multiples of the mean.
SCHEDULES = ((1.5, 0.5), (1.0, 1.0), (0.5, 1.5))
#: Parts into which each source is dealt for its running totals.
BUCKETS = 1024
SEED = 20240607


def _cycle(values, i: Column) -> Column:
    return F.element_at(F.array(*[F.lit(float(v)) for v in values]), (i % len(values) + 1).cast("int"))


def source_targets(sizes: DataFrame, weights=WEIGHTS, budget: float = BUDGET, cap: float = CAP) -> DataFrame:
    """sizes: source, size per document. Returns _src, source_size, target and the rank of each source.

    Water-filling: with level L, source i gets min(cap * S_i, L * w_i), and L is
    such that the targets add up to the budget. Sources in ascending order of
    cap * S_i / w_i fill up first; two running sums over the table of sources
    (one row each, after aggregation) give L. Null is a source of its own.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    rank = Window.orderBy(F.col("source").asc_nulls_last())
    per = per.withColumn("rank", F.row_number().over(rank) - 1).withColumn("w", _cycle(weights, F.col("rank")))
    per = per.withColumn("full", F.col("source_size") * cap)
    by_ratio = Window.orderBy(F.col("full") / F.col("w"), "rank").rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.orderBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    per = per.withColumns({
        "full_before": F.coalesce(F.sum("full").over(by_ratio), F.lit(0.0)),
        "w_left": F.sum("w").over(everything) - F.coalesce(F.sum("w").over(by_ratio), F.lit(0.0)),
        "wanted": F.sum("source_size").over(everything) * budget,
    })
    # The level that holds if exactly the sources before this one are full; the right one is the first that this source doesn't reach.
    per = per.withColumn("level", (F.col("wanted") - F.col("full_before")) / F.col("w_left"))
    level = F.min(F.when(F.col("full") >= F.col("level") * F.col("w"), F.struct(F.col("full") / F.col("w"), "rank", "level"))).over(everything)
    target = F.least(F.col("full"), F.coalesce(level["level"] * F.col("w"), F.col("full")))
    return per.select(F.col("source").alias("_src"), "source_size", target.alias("target"), "rank")


def assigned(docs: DataFrame, weights=WEIGHTS, budget: float = BUDGET, cap: float = CAP, schedules=SCHEDULES, seed: int = SEED) -> DataFrame:
    """doc_id, size, source_size, target, taken, position (0 to 1), positions (of whole copies) and _mx_h (the seeded hash) per row of docs.

    A document of a source with fraction f = target / source_size takes the
    words between two rounded points of the source's running demand: f * size
    to within one word, and never more than ``cap`` times its size. Null text
    has size 0, null source is a source; the order inside a source is that of
    the seeded hash, then doc_id, so reruns agree. Empty tables give empty
    tables; when all sizes are 0 all targets and positions are 0.
    """
    rows = docs.select("doc_id", "source", n_words(F.col("text")).alias("size"), row_hash(seed))
    rows = cut(rows.withColumn("b", F.pmod(F.col("_mx_h"), F.lit(BUCKETS))))  # five small columns, read several times
    # Running totals in two levels: over the buckets of a source (BUCKETS rows at most), then inside each bucket.
    per = rows.groupBy("source", "b").agg(F.sum("size").alias("n"))
    targets = source_targets(per.withColumnRenamed("n", "size"), weights, budget, cap)
    before = Window.partitionBy("source").orderBy("b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = per.withColumn("off", F.coalesce(F.sum("n").over(before), F.lit(0)))
    offsets = offsets.join(targets, F.col("source").eqNullSafe(F.col("_src"))).select("_src", F.col("b").alias("_b"), "off", "source_size", "target", "rank")
    rows = rows.join(offsets, F.col("source").eqNullSafe(F.col("_src")) & (F.col("b") == F.col("_b")))
    inside = Window.partitionBy("source", "b").orderBy("_mx_h", F.col("doc_id").asc_nulls_last(), "size").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("end", F.col("off") + F.sum("size").over(inside))
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    taken = F.floor(F.col("end") * rate + 0.5) - F.floor((F.col("end") - F.col("size")) * rate + 0.5)
    taken = F.least(taken.cast("long"), F.floor(F.col("size") * F.lit(float(cap))).cast("long"))
    # Demand: the integral of a + (b - a) t with mean 1 is a t + (b - a) t^2 / 2; its inverse at the middle of the document.
    a = _cycle([2 * s / (s + e) for s, e in schedules], F.col("rank"))
    b = _cycle([2 * e / (s + e) for s, e in schedules], F.col("rank"))
    inverse = lambda x: 2 * x / (a + F.sqrt(F.greatest(a * a + 2 * (b - a) * x, F.lit(0.0))))
    share = F.when(F.col("source_size") > 0, (F.col("end") - F.col("size") / 2) / F.col("source_size")).otherwise(F.lit(0.0))
    # The source is gone through rate times; a document's copies stand where those passes reach it.
    copies = F.when(F.col("size") > 0, F.greatest(F.ceil(rate - share), F.lit(0))).otherwise(F.lit(0))
    positions = F.transform(F.sequence(F.lit(0), copies - 1), lambda i: inverse((i + share) / rate))
    positions = F.when(copies > 0, positions).otherwise(F.array().cast("array<double>"))
    return rows.select("doc_id", "size", "source_size", "target", taken.alias("taken"), inverse(share).alias("position"), positions.alias("positions"), "_mx_h")


def row_hash(seed: int) -> Column:
    return F.xxhash64(F.lit(seed), "doc_id", "text").alias("_mx_h")


def mix(docs: DataFrame, **how) -> DataFrame:
    """assigned(), range-sorted by training position."""
    rows = assigned(docs, **how)
    return rows.repartitionByRange("position", "_mx_h").sortWithinPartitions("position", "_mx_h").drop("_mx_h", "positions")


def mixed_documents(docs: DataFrame, seed: int = SEED, **how) -> DataFrame:
    """The documents of the mix in training order, with the columns of docs (_mx_ prefixes are taken).

    A source is gone through target / source_size times in the order of the
    seeded hash, so a document appears once for each pass that reaches it, each
    copy at its own position, and the words of a source's copies miss its target
    by one document at most. Documents that no pass reaches go, and those
    without words. Rows that repeat both doc_id and text get equally many
    copies, rounded by chance (the seeded hash).
    """
    most = F.max(F.struct(F.size("positions").alias("n"), "positions"))["positions"]
    each = assigned(docs, seed=seed, **how).groupBy("_mx_h").agg(F.sum(F.size("positions")).alias("_mx_c"), F.count(F.lit(1)).alias("_mx_k"), most.alias("_mx_p"))
    u = F.pmod(F.xxhash64("_mx_h", F.lit(seed)), F.lit(1_000_003)) / 1_000_003.0
    copies = F.floor(F.col("_mx_c") / F.col("_mx_k") + u).cast("int")
    each = each.filter(copies > 0).select("_mx_h", F.slice("_mx_p", F.lit(1), copies).alias("_mx_p"))
    rows = docs.withColumn("_mx_h", row_hash(seed)).join(each, "_mx_h")
    rows = rows.select("*", F.posexplode("_mx_p").alias("_mx_i", "_mx_at")).drop("_mx_p").withColumnRenamed("_mx_at", "_mx_p")
    rows = rows.repartitionByRange("_mx_p", "_mx_h", "_mx_i").sortWithinPartitions("_mx_p", "_mx_h", "_mx_i")
    return rows.select(*[F.col(f"`{c}`") for c in docs.columns])

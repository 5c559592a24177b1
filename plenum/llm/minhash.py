"""Near-duplicate detection with MinHash bands and odd sketches.

1. Each text becomes its set of five-word shingles (64-bit hashes), and from
   that a key of the whole set, MinHash bands, and an odd sketch: the MinHash
   samples folded into a parity bitmap. Texts with equal sets share a key and
   are one node from here on, so exact copies cost nothing further.
2. Nodes that share a band are candidates. A bucket emits pairs with one pivot
   at a time and only between nodes that aren't yet connected, so large groups
   of near copies collapse after the first round and no bucket emits all its
   pairs at once; rounds go on until every bucket is connected or exhausted.
   After the first round, nodes that by the shingles which they alone have can
   reach no other node of a bucket leave it.
3. The population count of the XOR of two odd sketches estimates the similarity;
   hopeless pairs go. The others are confirmed on the full sets, streamed
   against their pivot in tasks of bounded size.
4. Links become connected components.

With 40 bands of 4 samples a pair at similarity 0.75 shares no band with a
probability of 3e-7; the sketch's threshold lies about six standard deviations
below that similarity.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, join_counted
from .components import components
from .words import WordHash, hashes, mix, windows

SHINGLE, SIMILARITY = 5, 75
BANDS, ROWS = 40, 4
#: Bits of the odd sketch, and the estimated similarity from which a pair is confirmed.
BITS, SKETCH_LEAST = 512, 0.45
#: Bits of the odd sketch of a whole set.
PARITY = 1024
#: Rounds of one pair per node before the exhaustive ones, and the pivots of a bucket in the first exhaustive one.
MEETINGS, PIVOTS = 1, 256
#: Members that are confirmed against one copy of their pivot, and entries of a bucket that one task gets.
MEMBERS, ENTRIES = 64, 512

_RNG = np.random.default_rng(7)
_A = _RNG.integers(0, 2**32, BANDS * ROWS, dtype=np.uint32) | np.uint32(1)
_B = _RNG.integers(0, 2**32, BANDS * ROWS, dtype=np.uint32)
_SALT = mix(_RNG.integers(0, 2**63, BANDS * ROWS, dtype=np.uint64))
PARITIES = ", ".join(f"w{i} long" for i in range(PARITY // 64))
SKETCH = f"n long, key binary, bands array<long>, odd array<long>, {PARITIES}"


def shingles(text: str | None, cache: WordHash) -> np.ndarray:
    """The sorted distinct shingle hashes of a text."""
    return np.unique(windows(hashes((text or "").encode().lower().split(), cache), SHINGLE))  # bytes lower only A-Z


def minhash(found: np.ndarray) -> np.ndarray:
    low = found.astype(np.uint32)
    out = np.full(len(_A), 0xFFFFFFFF, np.uint32)
    for i in range(0, len(low), 1024):
        np.minimum(out, (low[i : i + 1024, None] * _A + _B).min(axis=0), out=out)
    return out


def bands(samples: np.ndarray) -> np.ndarray:
    """A hash of each band of samples, its place included."""
    with np.errstate(over="ignore"):
        return mix((samples.astype(np.uint64) * _SALT).reshape(BANDS, ROWS).sum(axis=1) + np.arange(BANDS, dtype=np.uint64)).view(np.int64)


def odd_sketch(samples: np.ndarray) -> np.ndarray:
    bit = mix(samples.astype(np.uint64) ^ _SALT) % np.uint64(BITS)
    return np.packbits(np.bincount(bit.astype(np.int64), minlength=BITS) & 1).view(np.int64)


def parity(found: np.ndarray) -> np.ndarray:
    """An odd sketch of the whole set, not of its samples: two sets differ in at least as many elements as their sketches in bits."""
    return np.packbits(np.bincount((found >> np.uint64(20)).astype(np.int64) % PARITY, minlength=PARITY) & 1).view(np.int64)


def _sketch(text: str | None, cache: WordHash) -> tuple:
    found = shingles(text, cache)
    if not len(found):
        return 0, None, None, None, *[0] * (PARITY // 64)
    samples = minhash(found)
    return len(found), xxhash.xxh3_128_digest(found.tobytes()), bands(samples), odd_sketch(samples), *parity(found).tolist()


def _sketches(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    cache, names = WordHash(), [c.split()[0] for c in SKETCH.split(", ")]
    for texts in batches:
        yield pd.DataFrame([_sketch(t, cache) for t in texts], columns=names)


#: Bits in which two odd sketches differ, as expected at SKETCH_LEAST.
MOST_BITS = BITS / 2 * (1 - math.exp(-4 * BANDS * ROWS * (1 - SKETCH_LEAST) / BITS))


def promising(a: str, b: str) -> Column:
    """Whether the sizes and odd sketches of two nodes allow the similarity."""
    bits = F.aggregate(F.zip_with(f"{a}_odd", f"{b}_odd", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x)
    na, nb = F.col(f"{a}_n"), F.col(f"{b}_n")
    return (100 * F.least(na, nb) >= SIMILARITY * F.greatest(na, nb)) & (bits <= MOST_BITS)


def _shingle_lists(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    cache = WordHash()
    for texts in batches:
        yield pd.Series([shingles(t, cache).view(np.int64) for t in texts])


def _confirm(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows of a task by pivot and deal, the pivot's text first: keeps one set and tests what follows against it."""
    cache, pivot, held = WordHash(), None, None
    for batch in batches:
        links = []
        for p, deal, key, text in zip(batch["pivot"], batch["deal"], batch["key"], batch["text"]):
            found = shingles(text, cache)
            if key is None or p == key:
                pivot, held = (p, deal), found
            elif pivot == (p, deal):
                common = len(np.intersect1d(held, found, assume_unique=True))
                if 100 * common >= SIMILARITY * (len(held) + len(found) - common):
                    links.append((p, key))
        yield pd.DataFrame(links, columns=["a", "b"])


def confirmed(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """pairs: pivot, key; texts: key, text (a row per key). The pairs that reach the similarity on their full sets, as a, b.

    A pivot's members are dealt into parts of about MEMBERS, and the pivot's text goes to each part.
    """
    parts = pairs.groupBy("pivot").agg(F.ceil(F.count(F.lit(1)) / MEMBERS).cast("int").alias("parts"))
    member = pairs.join(parts, "pivot").select("pivot", F.pmod(F.xxhash64("key"), F.col("parts")).cast("int").alias("deal"), "key")
    head = parts.select("pivot", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("deal"), F.col("pivot").alias("key"))
    rows = member.union(head).join(texts, "key").select("pivot", "deal", "key", "text")
    rows = rows.repartition("pivot", "deal").sortWithinPartitions("pivot", "deal", F.col("key") != F.col("pivot"))
    return rows.mapInPandas(_confirm, "a binary, b binary")


def _parts(size: str = "size") -> Column:
    """Into how many parts the entries of a bucket are dealt."""
    return F.ceil(F.col(size) / ENTRIES).cast("int")


def _to_parts(buckets: DataFrame) -> DataFrame:
    """Rows of buckets (with their size), once for each part: what a bucket's entries in all parts have to meet."""
    return buckets.withColumn("part", F.explode(F.sequence(F.lit(0), _parts() - 1))).drop("size")


def _labelled(members: DataFrame, labels: DataFrame) -> DataFrame:
    return members.join(labels.withColumnRenamed("node", "key"), "key", "left").withColumn("label", F.coalesce("label", "key"))


def _possible(one: str, other: str) -> Column:
    """Whether two sets can reach the similarity (never false for sets that do).

    What either has alone is in no intersection, and the sets differ in at
    least as many elements as their parity words in bits.
    """
    n, m = F.col(f"{one}n"), F.col(f"{other}n")
    both = F.least(F.col(f"{one}common"), F.col(f"{other}common"), n, m)
    apart = F.lit(0)
    for i in range(PARITY // 64):
        apart = apart + F.bit_count(F.col(f"{one}parity.w{i}").bitwiseXOR(F.col(f"{other}parity.w{i}")))
    # 100 both >= 75 (n + m - both), with both = (n + m - apart) / 2
    return (100 * both >= SIMILARITY * (n + m - both)) & ((100 + SIMILARITY) * (n + m - apart) >= 2 * SIMILARITY * (n + m))


def _open(entries: DataFrame, sizes: DataFrame, texts: DataFrame) -> DataFrame:
    """entries: bucket, part, size, key, ...; sizes: key, n, parity. The entries that can have a link within their bucket, with n, common and parity.

    A shingle that one node alone has can be in no intersection, so common, the
    number of the others, bounds every intersection of the node; the smallest
    set of the bucket (and the similarity itself) bounds its partners' sizes.
    Variants that each went their own way from one text end here, one by one:
    no pairs are made of them.
    """
    nodes = entries.select("key").distinct()
    sets = nodes.join(texts, "key").select(F.xxhash64("key").alias("node"), F.explode(F.pandas_udf(_shingle_lists, "array<long>")("text")).alias("h"))
    alone = sets.groupBy("h").agg(F.count(F.lit(1)).alias("times"), F.min("node").alias("node")).filter("times = 1").groupBy("node").agg(F.count(F.lit(1)).alias("alone"))
    known = nodes.withColumn("node", F.xxhash64("key")).join(alone, "node", "left").join(sizes, "key")
    known = cut(known.select("key", "n", "parity", (F.col("n") - F.coalesce("alone", F.lit(0))).alias("common")))
    rows = cut(entries.join(known, "key"))
    least = _to_parts(rows.groupBy("bucket").agg(F.min("n").alias("least"), F.first("size").alias("size")))
    partner = F.greatest(F.col("least"), F.col("common"), F.ceil(F.col("n") * SIMILARITY / 100))
    return rows.join(least, ["bucket", "part"]).filter(100 * F.col("common") >= SIMILARITY * (F.col("n") + partner - F.col("common")))


def link(docs: DataFrame) -> DataFrame:
    """One row per row of docs: doc_id, n_shingles, component_id, kept, and _th (hash of the text), _keep (one row of each component).

    Null and empty texts, and those without words, have no shingles and are
    linked with nothing; an empty table gives an empty table. Rows may repeat: they share a component, and so do
    their kept flags; _keep holds for the rows of one (doc_id, text) only.
    component_id is the smallest doc_id that can be reached (nulls last); where
    that is null, the rows of one text are kept. Other columns are not read. All
    rounds run while the frame is made; what is returned reads their tables.
    """
    sketched = docs.select("doc_id", F.xxhash64("text").alias("_th"), F.pandas_udf(_sketches, SKETCH)("text").alias("s"))
    rows = cut(sketched.select("doc_id", "_th", "s.n", "s.key", "s.bands", "s.odd", F.struct(*(F.col(f"s.w{i}") for i in range(PARITY // 64))).alias("parity")))
    some = rows.filter("key IS NOT NULL")
    first = F.min_by(F.struct("doc_id", "_th"), F.struct(F.col("doc_id").isNull(), "doc_id", "_th"))
    nodes = cut(some.groupBy("key").agg(first.alias("first"), F.first("n").alias("n"), F.first("odd").alias("odd"), F.first("bands").alias("bands"), F.first("parity").alias("parity")))
    entries = nodes.select("key", F.explode("bands").alias("bucket"))
    shared = cut(entries.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).filter("n > 1"))
    members = cut(join_counted(entries, shared, ["bucket"], "key").withColumnRenamed("n", "size"))
    # A text that many others derive from shares more buckets with more nodes than they do among themselves.
    weights = members.groupBy("key").agg(F.sum("size").alias("weight"))
    members = cut(members.join(weights, "key").withColumn("part", F.pmod(F.xxhash64("key"), _parts()).cast("int")))
    sketch = nodes.select("key", "n", "odd")
    names = members.select("key").distinct().join(nodes.select("key", F.col("first.doc_id").alias("d"), F.col("first._th").alias("t")), "key")
    source = docs.select("doc_id", "text", F.xxhash64("text").alias("_th"))
    texts = cut(names.join(source, F.col("d").eqNullSafe(F.col("doc_id")) & (F.col("t") == F.col("_th"))).dropDuplicates(["key"]).select("key", "text"))

    def tested(pairs: DataFrame) -> DataFrame:
        p = pairs.join(sketch.toDF("pivot", "p_n", "p_odd"), "pivot").join(sketch.toDF("key", "k_n", "k_odd"), "key")
        return cut(confirmed(p.filter(promising("p", "k")).select("pivot", "key"), texts))

    # First round: each node against the most central node that it shares a bucket with.
    central = members.groupBy("bucket").agg(F.max(F.struct("weight", F.col("key").alias("pivot"))).alias("p"), F.first("size").alias("size"))
    pairs = members.join(_to_parts(central), ["bucket", "part"]).groupBy("key").agg(F.max("p").alias("p")).select("p.pivot", "key").filter("pivot <> key")
    pairs = cut(pairs)
    seen = pairs.select(F.least("pivot", "key").alias("pivot"), F.greatest("pivot", "key").alias("key")).distinct()
    links = tested(pairs)
    labels = components(links)
    def split() -> DataFrame:
        """The members of buckets that are in several parts, with the label of the largest."""
        now = cut(_labelled(members, labels))
        sets = now.groupBy("bucket", "label").agg(F.count(F.lit(1)).alias("held"), F.first("size").alias("size"))
        largest = sets.groupBy("bucket").agg(F.max_by("label", F.struct("held", "label")).alias("most"), F.count(F.lit(1)).alias("n_sets"), F.first("size").alias("size")).filter("n_sets > 1")
        return now.join(_to_parts(largest), ["bucket", "part"])

    # Entries whose node can't reach the similarity with anything in the bucket go; what is left of each bucket goes on.
    members = cut(_open(split(), nodes.select("key", "n", "parity"), texts).select("bucket", "part", "size", "key", "weight", "n", "common", "parity"))
    # A few rounds in which each node outside the largest part of a bucket meets one member of it: a pair per node and round.
    for r in range(MEETINGS):
        rest = split()
        chance = -F.ln((F.pmod(F.xxhash64("key", F.lit(r)), F.lit(1_000_003)) + 1) / 1_000_004.0) / F.col("weight")  # central nodes more often
        host = rest.filter("label = most").groupBy("bucket").agg(F.min_by(F.struct("key", "n", "common", "parity"), chance).alias("host"), F.first("size").alias("size"))
        met = rest.filter("label <> most").join(_to_parts(host), ["bucket", "part"]).filter(_possible("", "host."))
        met = met.groupBy("key").agg(F.min_by("host.key", F.xxhash64("host.key", "key", F.lit(r))).alias("pivot")).select("pivot", "key")
        pairs = cut(met.join(seen.union(seen.select("key", "pivot")), ["pivot", "key"], "left_anti"))
        seen = seen.union(pairs.select(F.least("pivot", "key"), F.greatest("pivot", "key"))).distinct()
        more = tested(pairs)
        if not more.isEmpty():
            links = links.union(more)
            labels = components(links)
    # Then, so that no link is lost, pivots from all but the largest part of each bucket, more of them each round.
    done, step = None, PIVOTS
    while True:
        rest = split()
        pivots = rest.filter("label <> most").select("bucket", "size", F.col("key").alias("pivot"), F.col("label").alias("pivot_label"), *(F.col(c).alias(f"pivot_{c}") for c in ("n", "common", "parity")))
        if done is not None:
            pivots = pivots.join(done, ["bucket", "pivot"], "left_anti")
        rank = F.row_number().over(Window.partitionBy("bucket").orderBy("pivot"))
        pivots = cut(pivots.withColumn("rank", rank).filter(F.col("rank") <= step))
        deepest = pivots.agg(F.max("rank")).head()[0]
        if deepest is None:
            break
        pairs = rest.join(_to_parts(pivots.drop("rank")), ["bucket", "part"]).filter((F.col("label") != F.col("pivot_label")) & _possible("", "pivot_")).select("pivot", "key").distinct()
        ordered = pairs.select(F.least("pivot", "key").alias("pivot"), F.greatest("pivot", "key").alias("key")).distinct()
        pairs = cut(ordered.join(seen, ["pivot", "key"], "left_anti"))
        more = tested(pairs)
        if not more.isEmpty():
            links = links.union(more)
            labels = components(links)
        if deepest < step:
            break
        seen = seen.union(pairs)
        done = pivots.select("bucket", "pivot") if done is None else done.union(pivots.select("bucket", "pivot"))
        step *= 16
    # Components by their smallest document.
    at = nodes.select("key", "first").join(labels.withColumnRenamed("node", "key"), "key", "left").withColumn("label", F.coalesce("label", "key"))
    smallest = at.groupBy("label").agg(F.min_by("first", F.struct(F.col("first.doc_id").isNull(), "first")).alias("c"))
    where = at.join(smallest, "label").select("key", "c")
    out = rows.drop("bands", "odd", "parity").join(where, "key", "left")
    alone = F.col("key").isNull()
    component = F.when(alone, F.col("doc_id")).otherwise(F.col("c.doc_id"))
    keep = alone | (component.eqNullSafe(F.col("doc_id")) & (F.col("c._th") == F.col("_th")))
    kept = component.eqNullSafe(F.col("doc_id")) & (F.col("doc_id").isNotNull() | keep)  # a null names no row
    return out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), kept.alias("kept"), "_th", keep.alias("_keep"))


def digest(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id, kept."""
    return link(docs.select("doc_id", "text")).select("doc_id", "n_shingles", "component_id", "kept")


def keep_one(docs: DataFrame) -> DataFrame:
    """One document of each component, with the columns of docs (_mh_ prefixes are taken)."""
    kept = link(docs.select("doc_id", "text")).filter("_keep").select(F.col("doc_id").alias("_mh_d"), F.col("_th").alias("_mh_t")).distinct()
    rows = docs.withColumn("_mh_th", F.xxhash64("text"))
    return rows.join(kept, rows.doc_id.eqNullSafe(kept._mh_d) & (rows._mh_th == kept._mh_t), "left_semi").drop("_mh_th")

"""Merkle manifest of a dataset: a store of hash nodes on disk, one Parquet partition per level.

Every row is a leaf. The leaves of a group ascend by key; every two consecutive
nodes become one of the next level until one is left, the group's subroot.
Subroots in the order of their groups are the leaves of one last tree.

Leaves are sorted into runs on disk, so a leaf gets its coordinate (group,
position) without a window over a group. A node's parent is at half its
position, so aligned blocks of 2**BITS nodes climb BITS levels on their own:
each band of BITS levels is read from the level below it, written by level, and
is the input of the next band. Proofs go down the same way: per block, one scan
of the band's levels finds each node's siblings by coordinate, and the path of
the block's top is appended. Only paths of block tops are ever shuffled, and no
task holds more than a block at once, whatever the size of a group.

All work is DataFrame functions. H is the lower-case hex SHA-256 of its inputs one after the other.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, join_counted, let, own, scratch

#: Levels in a band; a block has 2**BITS nodes.
BITS = 10
#: The columns of documents that a leaf covers, in order.
COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")
_ROW_BITS = 33  # of monotonically_increasing_id, for the row inside of its partition
_NODES = "tree string, n long, pos long, digest string, level int"
_PATH = "array<struct<left:string,right:string>>"


def joined(*parts: Column) -> Column:
    """H of the parts."""
    return F.sha2(F.concat(*parts).cast("binary"), 256)


def field(value: Column) -> Column:
    """A value as a leaf holds it: '-' for null, else its length in UTF-8 bytes, ':' and the value."""
    text = value.cast("string")
    return F.when(value.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf(*values: Column) -> Column:
    return joined(*map(field, values))


def tree_key(group: Column) -> Column:
    """The group as text that is never null and sorts like the group: null first, then by bytes."""
    return F.coalesce(F.concat(F.lit("="), group.cast("string")), F.lit("-"))


def placed(rows: DataFrame, *keys: str) -> DataFrame:
    """rows with _mk_place, their position from 0 in the order of keys (nulls first); rows that tie in all keys in any order. Runs at once.

    The runs are range-partitioned by sampled splitters and sorted externally;
    a last random key splits ties. Positions follow from one count per run.
    """
    order = [*[F.col(k).asc_nulls_first() for k in keys], F.col("_mk_tie").asc()]
    ranged = rows.withColumn("_mk_tie", F.xxhash64(F.monotonically_increasing_id())).repartitionByRange(*order).sortWithinPartitions(*order)
    inside = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << _ROW_BITS) - 1))
    runs = cut(ranged.drop("_mk_tie").withColumns({"_mk_run": F.spark_partition_id(), "_mk_in": inside}))
    before = Window.orderBy("_mk_run").rowsBetween(Window.unboundedPreceding, -1)  # one row per partition of the sort
    starts = runs.groupBy("_mk_run").agg(F.count(F.lit(1)).alias("n")).select("_mk_run", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_mk_start"))
    return runs.join(F.broadcast(starts), "_mk_run").withColumn("_mk_place", F.col("_mk_start") + F.col("_mk_in")).drop("_mk_run", "_mk_in", "_mk_start")


def height(n: Column) -> Column:
    """Levels above n leaves: how often they halve, rounded up, until one is left."""
    return F.when(n > 1, F.length(F.bin(n - 1))).otherwise(F.lit(0))


def nodes_at(n: Column, level: int) -> Column:
    """How many nodes a tree of n leaves has at a level, if it gets there."""
    return F.shiftright(n + F.lit((1 << level) - 1), level)


def climbs(n: Column, low: int) -> Column:
    """How many levels of the band that starts at low a tree of n leaves climbs."""
    return F.least(F.lit(BITS), height(nodes_at(n, low)))


def _first(count: Column) -> Column:
    """0 to count - 1, for at most BITS."""
    return F.slice(F.array(*[F.lit(i) for i in range(BITS)]), F.lit(1), count)


def _halved(digests: Column) -> Column:
    pairs = F.sequence(F.lit(0), F.floor((F.size(digests) - 1) / 2).cast("int"))
    return F.transform(pairs, lambda i: joined(F.get(digests, i * 2), F.coalesce(F.get(digests, i * 2 + 1), F.lit(""))))


def _levels(digests: Column, count: Column) -> Column:
    """The given nodes of a block and those of each level that it climbs."""
    return F.aggregate(_first(count), F.array(digests), lambda done, _: F.concat(done, F.array(_halved(F.element_at(done, -1)))))


@dataclass(frozen=True)
class Store:
    """The nodes of some trees. Columns: tree, n (leaves of the tree), pos (from 0 on each level), digest, level (partition)."""

    nodes: DataFrame
    path: str
    most: int  # leaves of the largest tree

    def bands(self) -> range:
        """The lowest level of each band."""
        return range(0, max(1, (self.most - 1).bit_length()), BITS)

    def tops(self) -> DataFrame:
        """tree, n, digest: the node that is left of each tree."""
        return self.nodes.filter(F.col("level") == height(F.col("n"))).select("tree", "n", "digest")


def build(leaves: DataFrame, most: int) -> Store:
    """Writes the nodes of some trees. leaves: tree, n, pos (0 to n - 1 in each tree), digest. most: the largest n. Runs at once."""
    path = f"{scratch(leaves.sparkSession)}/{uuid.uuid4().hex}"
    store = Store(leaves.sparkSession.createDataFrame([], _NODES), path, most)
    below = leaves
    own(path)
    for low in store.bands():
        blocks = below.groupBy("tree", "n", F.shiftright("pos", BITS).alias("block")).agg(F.array_sort(F.collect_list(F.struct("pos", "digest"))).alias("nodes"))
        rows = blocks.select("tree", "n", "block", F.posexplode(_levels(F.col("nodes.digest"), climbs(F.col("n"), low))).alias("up", "digests"))
        rows = rows.filter("up > 0") if low else rows  # the band below has written this one's first level
        rows = rows.select("tree", "n", "block", "up", F.posexplode("digests").alias("i", "digest"))
        rows = rows.selectExpr("tree", "n", f"shiftright(shiftleft(block, {BITS}), up) + i AS pos", "digest", f"up + {low} AS level")
        rows.write.mode("append").partitionBy("level").parquet(path)
        store = Store(leaves.sparkSession.read.schema(_NODES).parquet(path), path, most)
        below = store.nodes.filter((F.col("level") == low + BITS) & (nodes_at(F.col("n"), low + BITS) > 1))
    return store


def _beside(levels: Column, i: Column, count: Column) -> Column:
    """The sibling of the block's node i, and of each node above it in the block, with its side; nulls where a node is alone."""

    def one(up: Column) -> Column:
        at = F.call_function("shiftright", i, up)
        odd, nodes = F.pmod(at, F.lit(2)) == 1, F.get(levels, up)
        return F.struct(F.when(odd, F.get(nodes, at - 1)).alias("left"), F.when(~odd, F.get(nodes, at + 1)).alias("right"))

    return F.transform(_first(count), one)


def paths(store: Store, above: DataFrame) -> Iterator[tuple[int, DataFrame]]:
    """For each band from the top: its lowest level, and per block of that level (tree, block, top, paths: one per node).

    above: tree, n, top, path: what follows a tree's own path, and what is to be known at each leaf (top).
    """
    parents = None
    for low in reversed(store.bands()):
        band = F.floor((F.greatest(height(F.col("n")), F.lit(1)) - 1) / BITS) * BITS
        entering = above.filter(band == low).select("tree", F.lit(0).cast("long").alias("block"), "top", "path")
        parents = entering if parents is None else entering.unionByName(parents)
        inside = F.col("level").between(low, low + BITS - 1)
        nodes = store.nodes.filter(inside & (nodes_at(F.col("n"), low) > 1) if low else inside)
        block = F.expr(f"shiftright(pos, {low + BITS} - level)")
        blocks = nodes.groupBy("tree", "n", block.alias("block")).agg(F.array_sort(F.collect_list(F.struct((F.col("level") - low).alias("up"), "pos", "digest"))).alias("nodes"))
        by_level = F.transform(F.array(*[F.lit(i) for i in range(BITS)]), lambda up: F.transform(F.filter("nodes", lambda x: x.up == up), lambda x: x.digest))
        all_paths = let(by_level, lambda levels: F.transform(F.get(levels, F.lit(0)), lambda _, i: F.concat(_beside(levels, i, climbs(F.col("n"), low)), F.col("path"))))
        found = blocks.join(parents, ["tree", "block"]).select("tree", "block", "top", all_paths.alias("paths"))
        yield low, found
        parents = found.select("tree", "top", "block", F.posexplode("paths").alias("i", "path")).selectExpr("tree", f"shiftleft(block, {BITS}) + i AS block", "top", "path")


def proof(path: Column) -> Column:
    """H of all siblings on a path."""
    return F.sha2(F.array_join(F.transform(path, lambda x: F.coalesce(x.left, x.right, F.lit(""))), "").cast("binary"), 256)


def fold(start: Column, path: Column) -> Column:
    """The root that follows from a leaf and its path."""
    return F.aggregate(path, start, lambda h, x: joined(F.coalesce(x.left, F.lit("")), h, F.coalesce(x.right, F.lit(""))))


@dataclass(frozen=True)
class Manifest:
    """leaves: tree, n, pos, the given columns and leaf; store: nodes of the groups' trees; groups: nodes over the subroots; root: None without rows."""

    leaves: DataFrame
    store: Store
    groups: Store
    subroots: DataFrame  # tree, n, digest, pos
    root: str | None


def manifest(docs: DataFrame, columns=COLUMNS, group: str = "lang", key: str = "doc_id", carried: dict[str, Column] | None = None) -> Manifest:
    """Writes the manifest of docs: a leaf of ``columns`` per row, groups ascending by key (nulls first), rows of one key by leaf. Runs at once.

    carried: further columns to keep beside each leaf. Columns that are not
    named are left out, so names can't clash. Null, empty and very long values
    have defined leaves (``field``); repeated rows are leaves of their own; an
    empty table has no nodes and no root.
    """
    rows = cut(docs.select(F.col(f"`{key}`").alias("_mk_key"), tree_key(F.col(f"`{group}`")).alias("tree"), leaf(*[F.col(f"`{c}`") for c in columns]).alias("leaf"), *[c.alias(f"_mk_x_{k}") for k, c in (carried or {}).items()]))
    ordered = placed(rows, "tree", "_mk_key", "leaf")
    trees = cut(ordered.groupBy("tree").agg(F.count(F.lit(1)).alias("n"), F.min("_mk_place").alias("start")))
    leaves = cut(join_counted(ordered, trees, ["tree"], "_mk_place").withColumn("pos", F.col("_mk_place") - F.col("start")).drop("_mk_place", "start"))
    seen = trees.agg(F.max("n"), F.count(F.lit(1))).head()
    store = build(leaves.withColumnRenamed("leaf", "digest").select("tree", "n", "pos", "digest"), seen[0] or 0)
    subroots = cut(placed(store.tops(), "tree").withColumnRenamed("_mk_place", "pos"))
    groups = build(subroots.select(F.lit("").alias("tree"), F.lit(seen[1]).cast("long").alias("n"), "pos", "digest"), seen[1])
    root = groups.tops().head()
    return Manifest(leaves, store, groups, subroots, root and root.digest)


def proofs(m: Manifest) -> DataFrame:
    """The leaves of m with subroot and path: siblings from the leaf up to the root, each with its side (both null where a node is alone)."""
    start = m.groups.tops().select("tree", "n", F.lit(None).cast("string").alias("top"), F.array().cast(_PATH).alias("path"))
    *_, (_, blocks) = paths(m.groups, start)
    over = blocks.select("block", F.posexplode("paths").alias("i", "path")).selectExpr(f"shiftleft(block, {BITS}) + i AS pos", "path")
    above = m.subroots.join(over, "pos").select("tree", "n", F.col("digest").alias("top"), "path")
    *_, (_, blocks) = paths(m.store, above)
    own = [c for c in m.leaves.columns if c not in ("tree", "n", "pos")]
    held = m.leaves.groupBy("tree", F.shiftright("pos", BITS).alias("block")).agg(F.array_sort(F.collect_list(F.struct("pos", *own))).alias("held"))
    rows = held.join(blocks, ["tree", "block"]).select("tree", F.col("top").alias("subroot"), F.explode(F.arrays_zip("held", "paths")).alias("x"))
    return rows.select("tree", "subroot", "x.held.*", F.col("x.paths").alias("path"))


def digest(docs: DataFrame) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root, verified: one row per row of docs.

    Where 7 divides the CRC-32 of doc_id, the proof is checked for a leaf whose
    n_chars is one larger; a null doc_id or n_chars is never tampered with.
    """
    changed = {"n_chars": F.col("n_chars") + 1}
    tampered = F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0, leaf(*[changed.get(c, F.col(c)) for c in COLUMNS]))
    m = manifest(docs, carried={"tampered": tampered})
    rows = proofs(m).withColumn("folded_root", fold(F.coalesce("_mk_x_tampered", "leaf"), F.col("path")))
    root = F.lit(m.root).cast("string")
    return rows.select(F.col("_mk_key").alias("doc_id"), "leaf", "subroot", root.alias("root"), proof(F.col("path")).alias("proof_sha256"), "folded_root", (F.col("folded_root") == root).alias("verified"))


def _sql_leaf(n_chars: str) -> str:
    values = [n_chars if c == "n_chars" else c for c in COLUMNS]
    return "sha256(" + " || ".join(f"coalesce(strlen(CAST({v} AS VARCHAR)) || ':' || CAST({v} AS VARCHAR), '-')" for v in values) + ")"


_SQL_UP = "SELECT {by} level + 1 AS level, (n + 1) // 2 AS n, pos // 2 AS pos, sha256(string_agg(h, '' ORDER BY pos)) AS h FROM {table} WHERE n > 1 GROUP BY ALL"

#: digest() for DuckDB. CRC-32 is spelled out: one table step per byte.
SQL = f"""
WITH RECURSIVE step AS (
  SELECT list_transform(range(256), lambda b: list_reduce(list_concat([b], range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t
), leaf AS (
  SELECT row_number() OVER () AS r, doc_id, lang, {_sql_leaf("n_chars")} AS h, {_sql_leaf("n_chars + 1")} AS bad,
         coalesce(xor(4294967295, list_reduce(list_concat([4294967295], list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: ascii(c))), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1]))) % 7 = 0, false) AS tampered
  FROM documents, step
), ranked AS (
  SELECT *, count(*) OVER (PARTITION BY lang) AS n, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, h) - 1 AS pos FROM leaf
), node AS (
  SELECT lang, 0 AS level, n, pos, h FROM ranked
  UNION ALL
  {_SQL_UP.format(by="lang,", table="node")}
), subroot AS (
  SELECT lang, h, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS pos, count(*) OVER () AS n FROM node WHERE n = 1
), top AS (
  SELECT 0 AS level, n, pos, h FROM subroot
  UNION ALL
  {_SQL_UP.format(by="", table="top")}
), lone AS (
  SELECT DISTINCT lang, level, n FROM node WHERE n > 1
), up AS (
  SELECT DISTINCT level, n FROM top WHERE n > 1
), beside AS (
  SELECT r, 0 AS part, lone.level, x.h, x.pos < a.pos >> lone.level AS before
  FROM ranked a JOIN lone ON lone.lang IS NOT DISTINCT FROM a.lang
  LEFT JOIN node x ON x.lang IS NOT DISTINCT FROM a.lang AND x.level = lone.level AND x.pos = xor(a.pos >> lone.level, 1)
  UNION ALL
  SELECT r, 1, up.level, x.h, x.pos < s.pos >> up.level
  FROM ranked a JOIN subroot s ON s.lang IS NOT DISTINCT FROM a.lang CROSS JOIN up
  LEFT JOIN top x ON x.level = up.level AND x.pos = xor(s.pos >> up.level, 1)
), path AS (
  SELECT r, string_agg(h, '' ORDER BY part, level) AS siblings,
         list(CASE WHEN h IS NULL THEN '-' WHEN before THEN 'L' || h ELSE 'R' || h END ORDER BY part, level) AS steps
  FROM beside GROUP BY r
), folded AS (
  SELECT a.*, s.h AS subroot, (SELECT h FROM top WHERE n = 1) AS root, sha256(coalesce(siblings, '')) AS proof_sha256,
         list_reduce(list_concat([CASE WHEN tampered AND bad IS NOT NULL THEN bad ELSE a.h END], coalesce(steps, [])), lambda h, x:
           CASE x[1] WHEN 'L' THEN sha256(x[2:] || h) WHEN 'R' THEN sha256(h || x[2:]) ELSE sha256(h) END) AS folded_root
  FROM ranked a JOIN subroot s ON s.lang IS NOT DISTINCT FROM a.lang LEFT JOIN path USING (r)
)
SELECT doc_id, h AS leaf, subroot, root, proof_sha256, folded_root, folded_root = root AS verified FROM folded
"""

"""Nearest vectors by inner product, from randomly rotated one-bit codes.

Each vector x is padded, rotated at random and kept as the signs of its
coordinates, packed to bits, beside two scalars: its length and how well the
signs point its way (fit). With q' a query's rotated direction, held as four bit
planes, counts of common bits give <signs, q'>, and <signs, q'> / fit estimates
<x, q> / (|x| |q|) without bias. The error is about a normal one of variance
(1 / fit**2 - 1) / (bits - 1), which bounds the inner product from above: only
vectors whose bound reaches a query's k-th best score so far are reranked with
the vectors themselves.

Every vector is compared with every query by its code, so what is lost is lost
to the error bound alone. Vectors come in rounds, each GROWTH times as many as
all before, in the order of a hash: the k-th best score of a round is the next
one's threshold, so that about k * GROWTH vectors a query pass in each round,
however many there are. In a round, queries are dealt into blocks and vectors
into slabs; a task gets one block and one slab, both of bounded size.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut

#: Bits of a code: this many, or the dimension if that is more, in whole words of 64.
LEAST_BITS = 256
#: Standard errors between an estimate and its bound; 3 lose about one neighbour in 1,000 of those at the very threshold.
EPSILON = 3.0
#: Vectors of the first round, and how many times as many have been seen after each further one.
FIRST, GROWTH = 4096, 16
#: Most queries in a block and most vectors in a slab; a small round is cut into up to TASKS slabs of LEAST_SLAB vectors or more, then into blocks.
BLOCK, SLAB, LEAST_SLAB, TASKS = 4096, 65_536, 2048, 48
PLANES = 4
_STEP = 1 << 21  # pairs of a query and a code at a time


@lru_cache(maxsize=2)
def rotation(dim: int) -> np.ndarray:
    """dim orthonormal rows: what a random rotation of the padded space does to the first dim axes. The same in every process."""
    bits = -(-max(LEAST_BITS, dim) // 64) * 64
    q, r = np.linalg.qr(np.random.default_rng(20_24).standard_normal((bits, bits)))
    return (q * np.sign(np.diag(r)))[:dim].copy()


def encode(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Codes (rows of uint64), lengths and fits of the rows of x, none of them zero."""
    length = np.sqrt((x * x).sum(axis=1))
    turned = (x / length[:, None]) @ rotation(x.shape[1])
    return np.packbits(turned > 0, axis=1, bitorder="little").view(np.uint64), length, np.abs(turned).sum(axis=1) / np.sqrt(turned.shape[1])


class Queries:
    """Some queries, ready to be compared with codes."""

    def __init__(self, q: np.ndarray):
        self.vectors = q
        self.length = np.sqrt((q * q).sum(axis=1))
        turned = (q / self.length[:, None]) @ rotation(q.shape[1])
        self.bits = turned.shape[1]
        self.low = turned.min(axis=1)
        self.step = np.maximum((turned.max(axis=1) - self.low) / (2**PLANES - 1), 1e-12)
        level = np.rint((turned - self.low[:, None]) / self.step[:, None]).astype(np.uint8)
        self.planes = [np.packbits(level >> j & 1, axis=1, bitorder="little").view(np.uint64) for j in range(PLANES)]
        self.total = turned.sum(axis=1)

    def estimates(self, codes: np.ndarray, fit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Estimated cosines (queries by codes), and their standard errors."""
        common = np.zeros((len(self.low), len(codes)), np.uint16)
        for j, plane in enumerate(self.planes):
            for w in range(codes.shape[1]):
                common += np.bitwise_count(plane[:, w, None] & codes[None, :, w]).astype(np.uint16) << np.uint16(j)
        ones = np.bitwise_count(codes).sum(axis=1, dtype=np.int64)
        dot = (2 * (self.low[:, None] * ones + self.step[:, None] * common) - self.total[:, None]) / np.sqrt(self.bits)
        error = np.sqrt(np.maximum(1 / fit**2 - 1, 0)[None, :] / (self.bits - 1) + (self.step[:, None] / fit) ** 2 / 12)
        return dot / fit, error


def exact(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Inner products of rows, each added up in the order of the components."""
    total = np.zeros(len(q))
    for d in range(q.shape[1]):
        total += q[:, d] * x[:, d]
    return total


def nearest(query_ids: np.ndarray, q: np.ndarray, ids: np.ndarray, x: np.ndarray, codes: np.ndarray, length: np.ndarray, fit: np.ndarray, worst: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row of the query, id and score of the k best vectors per query, as far as they reach its worst score that counts; by query, score (descending) and id."""
    queries = Queries(q)
    row, near, score = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)
    worst = worst.copy()  # from here on, the k-th best score so far if that is more

    def rerank(qi: np.ndarray, xi: np.ndarray) -> None:
        nonlocal row, near, score
        for a in range(0, len(qi), 16_384):  # most of what the bounds let through fails by a clear margin
            part = slice(a, a + 16_384)
            rough = np.einsum("ij,ij->i", q[qi[part]], x[xi[part]])
            some = np.flatnonzero(rough >= worst[qi[part]] - 1e-9 * (1 + np.abs(rough)))
            i, j = qi[part][some], xi[part][some]
            row, near, score = np.append(row, i), np.append(near, ids[j]), np.append(score, exact(q[i], x[j]))
        order = np.lexsort((near, -score, row))
        row, near, score = row[order], near[order], score[order]
        place = np.arange(len(row)) - np.searchsorted(row, row)
        last = place == k - 1
        worst[row[last]] = np.maximum(worst[row[last]], score[last])
        row, near, score = row[place < k], near[place < k], score[place < k]

    width = max(k, _STEP // max(1, len(q)))
    for a in range(0, len(ids), width):
        part = slice(a, a + width)
        guess, error = queries.estimates(codes[part], fit[part])
        scale = queries.length[:, None] * length[None, part]
        other = query_ids[:, None] != ids[None, part]
        if a == 0 and len(ids) > k and np.isinf(worst).any():  # the best guesses give a first threshold
            best = np.argpartition(np.where(other, -guess * scale, np.inf), k - 1, axis=1)[:, :k]
            seed = np.zeros_like(other)
            np.put_along_axis(seed, best, True, axis=1)
            seed &= other
            rerank(*np.nonzero(seed))
            other &= ~seed
        qi, xi = np.nonzero(other & ((guess + EPSILON * error) * scale >= worst[:, None]))
        rerank(qi, xi + a)
    return row, near, score


def valid(vector: Column) -> Column:
    """Neither null nor zero, and every component finite."""
    finite = F.forall(vector, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf")))
    return F.coalesce(finite & F.exists(vector, lambda v: v != 0), F.lit(False))


def index(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """Writes the codes of all vectors that take part: id, raw (the components' bytes in double precision), code, length, fit.

    Rows without an id or with an invalid vector take no part, nor do those of
    another dimension than the commonest (of equally common ones, the largest).
    No part is learnt from the data: the rotation is drawn from a fixed seed.
    """
    rows = vectors.select(F.col(f"`{key}`").cast("long").alias("id"), F.col(f"`{vector}`").cast("array<double>").alias("v")).filter(valid(F.col("v")) & F.col("id").isNotNull())
    dim = rows.groupBy(F.size("v").alias("dim")).count().orderBy(F.desc("count"), F.desc("dim")).select("dim").head()

    @F.pandas_udf("raw binary, code binary, length double, fit double")
    def coded(v: pd.Series) -> pd.DataFrame:
        x = np.stack(v.to_list()) if len(v) else np.empty((0, dim[0]))
        codes, length, fit = encode(x)
        return pd.DataFrame({"raw": [r.tobytes() for r in x], "code": [c.tobytes() for c in codes], "length": length, "fit": fit})

    same = rows.filter(F.size("v") == (dim[0] if dim else 0))
    return cut(same.select("id", coded("v").alias("c")).select("id", "c.*"))


def _round(queries: DataFrame, codes: DataFrame, n_queries: int, n: int, k: int) -> DataFrame:
    """query_id, vec_id, score: of about n codes, those that may be among the k best of a query, given the worst score that counts (queries: id, raw, worst)."""
    slabs = max(1, -(-n // SLAB), min(TASKS, n // LEAST_SLAB))
    blocks = max(1, -(-n_queries // BLOCK), min(n_queries // 64, TASKS // slabs))
    dealt = lambda parts: F.pmod(F.xxhash64("raw", "id"), F.lit(parts)).cast("int")
    every = lambda parts: F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))
    asked = queries.withColumn("block", dealt(blocks)).withColumn("slab", every(slabs))
    held = codes.withColumn("slab", dealt(slabs)).withColumn("block", every(blocks))

    def one(q: pd.DataFrame, x: pd.DataFrame) -> pd.DataFrame:
        if not len(q) or not len(x):
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []})
        matrix = lambda c, kind: np.frombuffer(b"".join(c), kind).reshape(len(c), -1)
        ids = q["id"].to_numpy()
        row, near, score = nearest(ids, matrix(q["raw"], np.float64), x["id"].to_numpy(), matrix(x["raw"], np.float64), matrix(x["code"], np.uint64), x["length"].to_numpy(), x["fit"].to_numpy(), q["worst"].to_numpy(), k)
        return pd.DataFrame({"query_id": ids[row], "vec_id": near, "score": score})

    return asked.groupBy("block", "slab").cogroup(held.groupBy("block", "slab")).applyInPandas(one, "query_id long, vec_id long, score double")


def search(codes: DataFrame, is_query: Column, k: int = 20) -> DataFrame:
    """query_id, rank (int, from 1), vec_id, score: for each row of codes that is_query holds for, the k nearest of all rows. Runs at once, but for the last round.

    Rows with the query's id are its own and no candidates; of query rows with
    one id and different vectors one counts (the least in bytes). Repeated rows
    are candidates each. Scores tie to the smaller vec_id; with fewer
    candidates all are given; without any there is no row for the query.
    """
    queries = cut(codes.filter(is_query).groupBy("id").agg(F.min("raw").alias("raw")))
    n_queries, n = queries.count(), codes.count()
    turn = F.pmod(F.xxhash64("id", "raw"), F.lit(1 << 40)) / float(1 << 40)  # spreads rows evenly over 0 to 1, whatever their vectors
    best_first = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    best, seen = None, 0
    while best is None or seen < n:
        upto = min(n, seen * GROWTH or FIRST)
        part = codes.filter((turn >= seen / max(n, 1)) & (turn < upto / n) if upto < n else turn >= seen / max(n, 1))
        if best is None:
            asked = queries.withColumn("worst", F.lit(float("-inf")))
        else:
            best = cut(best)
            worst = best.filter(F.col("rank") == k).select(F.col("query_id").alias("id"), F.col("score").alias("worst"))
            asked = queries.join(worst, "id", "left").withColumn("worst", F.coalesce("worst", F.lit(float("-inf"))))
        found = _round(asked, part, n_queries, upto - seen, k)
        found = found if best is None else best.select("query_id", "vec_id", "score").unionByName(found)
        best = found.withColumn("rank", F.row_number().over(best_first)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
        seen = upto
    return best


def digest(vectors: DataFrame) -> DataFrame:
    """query_id, rank, vec_id, score: the 20 nearest of every vector whose vec_id is divisible by 20."""
    return search(index(vectors), F.col("id") % 20 == 0)


#: Brute force, for tables on which the bounds lose nothing.
SQL = """
WITH v AS (
  SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda c: c IS NULL OR isnan(c) OR isinf(c))) = 0 AND len(list_filter(embedding, lambda c: c <> 0)) > 0
), scored AS (
  SELECT q.vec_id AS query_id, x.vec_id, list_inner_product(q.v, x.v) AS score
  FROM v q JOIN v x ON q.vec_id <> x.vec_id WHERE q.vec_id % 20 = 0
), ranked AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM scored
)
SELECT * FROM ranked WHERE rank <= 20
"""

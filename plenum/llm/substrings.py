"""Removal of repeated substrings, by suffix sorting of the places where it is undecided.

Every string of WIDTH bytes has an anchor: the 32-byte gram with the least hash
in it. Equal strings have equal anchors, so strings whose anchor's gram occurs
once in the corpus can't repeat. The strings of one anchor are a segment.

1. Grams of anchors are counted over the corpus; segments with unique ones go.
2. Segments that are equal as a whole are decided by their digests (64 bits of
   the bytes beside the 64 of the gram): all their strings repeat. Only segments that share a gram but differ are undecided.
3. These are cut out of the texts and brought together by gram; tasks suffix-sort
   them in two stages and compare adjacent suffixes. Grams with very many
   different segments are split first: into pieces of PIECE starts, which meet
   only if the bytes common to all strings of the piece agree, and, where that
   leaves a large group, into single strings, which are equal or not.
4. The repeated strings of a text are joined back to it and removed.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, join_counted
from .suffixes import repeated
from .words import mix

WIDTH, GRAM = 200, 32
#: Segments of one gram that one task sorts together; starts of a piece of larger groups.
GROUP, PIECE = 512, 16
#: Bytes that are suffix-sorted at once.
SORTED = 1 << 20

_POS = np.uint64((1 << 28) - 1)
_RNG = np.random.default_rng(11)
_BYTE = mix(_RNG.integers(0, 2**63, 256, dtype=np.uint64))
_MUL = [int(x) | 1 for x in mix(_RNG.integers(0, 2**63, 5, dtype=np.uint64))]


def anchors(raw: bytes) -> tuple[np.ndarray, ...] | None:
    """gram hash, first start, last start, and the anchor's place, of each segment."""
    n = len(raw)
    if n < WIDTH:
        return None
    if n > _POS:
        raise ValueError("a text of 256 MB or more has to be split")
    t = _BYTE[np.frombuffer(raw, np.uint8)]
    h, w = t, 1
    for m in _MUL:
        h = h[:-w] * np.uint64(m) + h[w:]
        w *= 2
    h = mix(h)
    least, w, grams = (h & ~_POS) | np.arange(len(h), dtype=np.uint64), 1, WIDTH - GRAM + 1
    while 2 * w <= grams:
        least = np.minimum(least[:-w], least[w:])
        w *= 2
    if w < grams:
        least = np.minimum(least[: len(least) - (grams - w)], least[grams - w :])
    at = (least & _POS).astype(np.int64)
    edge = np.flatnonzero(at[1:] != at[:-1]) + 1
    first = np.concatenate(([0], edge))
    return h[at[first]].view(np.int64), first, np.concatenate((edge - 1, [n - WIDTH])), at[first]


def segments(raw: bytes) -> tuple[np.ndarray, ...] | None:
    """gram hash, digest, first start, starts less one, and the anchor's distance from the first start, of each segment."""
    found = anchors(raw)
    if found is None:
        return None
    h, first, last, anchor = found
    digest = np.fromiter((xxhash.xxh3_64_intdigest(raw[a:b]) for a, b in zip(first.tolist(), (last + WIDTH).tolist(), strict=True)), np.uint64, len(first))
    return h, digest.view(np.int64), first, last - first, anchor - first


def _grams(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    """The grams of anchors with their numbers in the batch."""
    for batch in batches:
        found = [x[0] for text in batch["text"] if (x := anchors((text or "").encode())) is not None]
        if found:
            h, n = np.unique(np.concatenate(found), return_counts=True)
            yield pd.DataFrame({"h": h, "n": n})


def _segments(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        found = [(rk, s) for rk, text in zip(batch["rk"], batch["text"]) if (s := segments((text or "").encode())) is not None]
        if found:
            columns = [np.concatenate([s[k] for _, s in found]) for k in range(5)]
            rk = np.repeat(np.array([rk for rk, _ in found], np.int64), [len(s[0]) for _, s in found])
            yield pd.DataFrame(dict(zip(("rk", "h", "d", "first", "more", "at"), [rk, *columns[:2], *(c.astype(np.int32) for c in columns[2:])])))


ASKED = "struct<h:bigint,first:int,more:int,at:int,single:boolean,hot:boolean>"
PIECES = "h long, core long, rk long, first int, single boolean, bytes binary"


def _cut_out(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The bytes of the segments that are asked for; those of hot grams in pieces of PIECE starts, with the digest of the bytes that all their strings share."""
    for batch in batches:
        rows = []
        for rk, text, asked in zip(batch["rk"], batch["text"], batch["asked"]):
            raw = (text or "").encode()
            for a in asked:
                first, last, single = a["first"], a["first"] + a["more"], bool(a["single"])
                if not a["hot"]:
                    rows.append((a["h"], 0, rk, first, single, raw[first : last + WIDTH]))
                    continue
                anchor = first + a["at"]
                for part in range((anchor - last) // PIECE, (anchor - first) // PIECE + 1):  # by the distance to the anchor
                    lo, hi = max(first, anchor - part * PIECE - PIECE + 1), min(last, anchor - part * PIECE)
                    core = raw[anchor - part * PIECE : anchor - part * PIECE - PIECE + 1 + WIDTH]
                    rows.append((a["h"], xxhash.xxh3_64_intdigest(core, part) - 2**63 or 1, rk, lo, single, raw[lo : hi + WIDTH]))
        yield pd.DataFrame(rows, columns=[c.split()[0] for c in PIECES.split(", ")])


REPEATS = "rk long, s int, e int"


def _runs(rk: int, first: int, twice: np.ndarray) -> list[tuple[int, int, int]]:
    edge = np.flatnonzero(np.diff(np.concatenate(([0], twice.view(np.int8), [0]))))
    return [(rk, first + s, first + e - 1 + WIDTH) for s, e in zip(edge[::2].tolist(), edge[1::2].tolist())]


def _sorted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows of a task by (h, core): suffix-sorts whole groups, about SORTED bytes at a time. Groups are of GROUP pieces at most."""
    group, held, size = [], [], 0

    def flush():
        nonlocal held, size
        rows = []
        if held:
            for (rk, first, single, _), twice in zip(held, repeated([x[3] for x in held], WIDTH)):
                if single and twice.any():
                    rows += _runs(rk, first, twice)
        held, size = [], 0
        return pd.DataFrame(rows, columns=["rk", "s", "e"])

    key = None
    for batch in batches:
        for h, core, rk, first, single, raw in zip(batch["h"], batch["core"], batch["rk"], batch["first"], batch["single"], batch["bytes"]):
            if key != (h, core):
                if len(group) > 1:
                    held += group
                    size += sum(len(x[3]) for x in group)
                group, key = [], (h, core)
                if size >= SORTED:
                    yield flush()
            group.append((rk, first, single, bytes(raw)))
    if len(group) > 1:
        held += group
    yield flush()


def _strings(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Each string of a piece by its digest (two hashes)."""
    for batch in batches:
        rows = []
        for h, rk, first, single, raw in zip(batch["h"], batch["rk"], batch["first"], batch["single"], batch["bytes"]):
            raw = bytes(raw)
            for i in range(len(raw) - WIDTH + 1):
                one = xxhash.xxh3_128_intdigest(raw[i : i + WIDTH])
                rows.append((h, (one >> 64) - 2**63, (one & 2**64 - 1) - 2**63, rk, first + i, single))
        yield pd.DataFrame(rows, columns=["h", "u", "v", "rk", "s", "single"])


REMOVED = "n_bytes long, n_removed long, n_spans long, kept_sha256 string"


def _removed(pairs: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
    for texts, all_repeats in pairs:
        rows = []
        for text, repeats in zip(texts, all_repeats, strict=True):
            raw = (text or "").encode()
            edge = np.zeros(len(raw) + 1, np.int64)
            for r in repeats if repeats is not None else ():
                edge[r["s"]] += 1
                edge[r["e"]] -= 1
            gone = np.cumsum(edge)[:-1] > 0
            spans = int(gone[:1].sum() + (gone[1:] & ~gone[:-1]).sum())
            kept = np.frombuffer(raw, np.uint8)[~gone].tobytes()
            rows.append((len(raw), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
        yield pd.DataFrame(rows, columns=["n_bytes", "n_removed", "n_spans", "kept_sha256"])


def repeats(docs: DataFrame, keyed: DataFrame) -> DataFrame:
    """rk, s, e: byte ranges (end exclusive) of repeated strings, of texts keyed by rk."""
    found = keyed.select("rk", "doc.text").mapInPandas(_segments, "rk long, h long, d long, first int, more int, at int")
    grams = keyed.select("doc.text").mapInPandas(_grams, "h long, n long")
    often = cut(grams.groupBy("h").agg(F.sum("n").alias("n")).filter("n > 1"))
    found = cut(join_counted(found, often, ["h"], "rk", "first").drop("n"))
    kinds = cut(found.groupBy("h", "d").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("rk", "first", "more", "at")).alias("one")))
    whole = join_counted(found, kinds.filter("n > 1").select("h", "d", "n"), ["h", "d"], "rk", "first").select("rk", F.col("first").alias("s"), (F.col("first") + F.col("more") + WIDTH).alias("e"))
    differ = cut(kinds.groupBy("h").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("n") == 1).alias("singles")).filter("n > 1 AND singles > 0").select("h", "n"))
    each = kinds.select("h", "d", "one", (F.col("n") == 1).alias("single"))
    asked = join_counted(each, differ, ["h"], "d").select("one.rk", F.struct("h", "one.first", "one.more", "one.at", "single", (F.col("n") > GROUP).alias("hot")).alias("a"))
    asked = cut(asked.groupBy("rk").agg(F.collect_list("a").alias("asked")))  # of one text each: no more than its length
    pieces = cut(keyed.join(asked, "rk").select("rk", "doc.text", "asked").mapInPandas(_cut_out, PIECES))
    hot = pieces.filter("core <> 0")
    sizes = cut(hot.groupBy("h", "core").agg(F.count(F.lit(1)).alias("n")).filter("n > 1"))
    hot = join_counted(hot, sizes, ["h", "core"], "rk", "first")
    names = ["h", "core", "rk", "first", "single", "bytes"]
    small = pieces.filter("core = 0").select(names).union(hot.filter(F.col("n") <= GROUP).select(names))
    small = small.repartition("h", "core").sortWithinPartitions("h", "core").mapInPandas(_sorted, REPEATS)
    large = hot.filter(F.col("n") > GROUP).select(names).mapInPandas(_strings, "h long, u long, v long, rk long, s int, single boolean")
    twice = cut(large.groupBy("h", "u", "v").agg(F.count(F.lit(1)).alias("n")).filter("n > 1"))
    large = join_counted(large, twice, ["h", "u", "v"], "rk", "s").filter("single").select("rk", "s", (F.col("s") + WIDTH).alias("e"))
    return whole.union(small).union(large)


def remove(docs: DataFrame) -> DataFrame:
    """doc_id (of any type), n_bytes, n_removed, n_spans, kept_sha256, one row per row of docs.

    Null counts as empty; texts below WIDTH bytes keep all; one of 2**28 bytes or more raises an error. Rows that repeat
    doc_id and text are copies of each other like any others. Other columns are
    not read.
    """
    keyed = docs.select(F.xxhash64("doc_id", "text").alias("rk"), F.struct("doc_id", "text").alias("doc"))
    gone = repeats(docs, keyed).groupBy("rk").agg(F.collect_list(F.struct("s", "e")).alias("repeats"))
    rows = keyed.join(gone, "rk", "left").select("doc.doc_id", F.pandas_udf(_removed, REMOVED)("doc.text", "repeats").alias("r"))
    return rows.select("doc_id", "r.*")

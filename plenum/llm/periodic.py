"""Periodic runs of words, found on a harmonic grid.

A run of period p and at least 2p words crosses a grid point 0, p, 2p, ... at
which the words p apart are equal. All (period, grid point) pairs, n log n of
them, are laid out in numpy at once (in bounded pieces). Where the words
around a point agree, prefix hashes and a binary search give how far they agree
to both sides, for all pairs together. Hashes can only make a stretch too long,
so each one is verified on the words, and compared word by word where that fails.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .words import mix

#: A run has at least this many words.
LEAST = 12
#: Pairs of period and grid point that are looked at together.
PAIRS = 1 << 18
_BASE = np.uint64(0x9E3779B97F4A7C15)


def intern(words: list[bytes]) -> np.ndarray:
    """A number per word, equal for equal words only."""
    numbers: dict[bytes, int] = defaultdict()
    numbers.default_factory = numbers.__len__
    return np.fromiter(map(numbers.__getitem__, words), np.int64, len(words))


def _grids(n: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Periods and grid points with a word one period on, by ascending period, about PAIRS at a time."""
    upto = np.cumsum((n - 1) // np.arange(1, n // 2 + 1))
    first = 0
    while first < len(upto):
        done = upto[first - 1] if first else 0
        last = max(first + 1, int(np.searchsorted(upto, done + PAIRS, "right")))
        periods = np.arange(first + 1, last + 1)
        counts = (n - 1) // periods
        period = np.repeat(periods, counts)
        at = (np.arange(len(period)) - np.repeat(np.cumsum(counts) - counts, counts)) * period
        yield period, at
        first = last


def _agree(ids: np.ndarray, at: np.ndarray, period: np.ndarray) -> np.ndarray:
    """Whether words one period apart are equal; not beyond either end."""
    inside = (at >= 0) & (at + period < len(ids))
    at = np.where(inside, at, 0)
    return inside & (ids[at] == ids[np.where(inside, at + period, 0)])


def _search(least: np.ndarray, most: np.ndarray, holds) -> np.ndarray:
    """Per pair the largest length of least..most for which holds(length), by a binary search for all at once."""
    while (least < most).any():
        middle = (least + most + 1) >> 1
        yes = holds(middle)
        least, most = np.where(yes, middle, least), np.where(yes, most, middle - 1)
    return least


def _exact(ids: np.ndarray, at: int, period: int) -> tuple[int, int, int]:
    """The stretch of a period around one point, word by word."""
    start, end = at, at + period
    while start > 0 and ids[start - 1] == ids[start - 1 + period]:
        start -= 1
    while end < len(ids) and ids[end] == ids[end - period]:
        end += 1
    return start, end, period


def find_runs(ids: np.ndarray, least: int = LEAST, hashed: np.ndarray | None = None) -> np.ndarray:
    """Rows start, length, period (the smallest) of every maximal run of max(least, 2 * period) words, by start and period.

    hashed: the 64-bit number that stands for each word in the prefix hashes.
    """
    n = len(ids)
    if n < max(2, least):
        return np.empty((0, 3), np.int64)
    hashed = mix(ids.astype(np.uint64) + np.uint64(1)) if hashed is None else hashed
    power = np.full(n + 1, _BASE)
    power[0] = 1
    power = np.multiply.accumulate(power)
    prefix = np.zeros(n + 1, np.uint64)
    np.cumsum(hashed * power[:n], out=prefix[1:])
    known: dict[tuple[int, int], int] = {}
    inside_of = np.full((2, n), -1)  # by word: end and period of a run around it

    def add(start: int, end: int, period: int) -> None:
        if end - start >= max(least, 2 * period):
            known[start, end] = period = min(period, known.get((start, end), period))
            inside_of[:, start:end] = [[end], [period]]

    for period, at in _grids(n):
        same = np.flatnonzero(ids[at] == ids[at + period])
        period, at = period[same], at[same]
        if known:  # a multiple of a known run's period describes the same run
            end, q = inside_of[:, at]
            new = np.flatnonzero((at + period >= end) | (period % np.abs(q) != 0))
            period, at = period[new], at[new]
        if least >= 6:  # at least three words in a row agree, this one among them
            l1, r1 = _agree(ids, at - 1, period), _agree(ids, at + 1, period)
            some = np.flatnonzero(l1 | r1)
            period, at, l1, r1 = period[some], at[some], l1[some], r1[some]
            some = np.flatnonzero((l1 & r1) | (l1 & _agree(ids, at - 2, period)) | (r1 & _agree(ids, at + 2, period)))
            period, at = period[some], at[some]
        if not len(at):
            continue
        shift = power[period]
        ahead = _search(np.ones_like(at), n - period - at, lambda k: (prefix[at + k] - prefix[at]) * shift == prefix[at + period + k] - prefix[at + period])  # noqa: B023
        behind = _search(np.zeros_like(at), at, lambda k: (prefix[at] - prefix[at - k]) * shift == prefix[at + period] - prefix[at + period - k])  # noqa: B023
        long = np.flatnonzero(ahead + behind >= np.maximum(least - period, period))
        found = np.stack((at[long] - behind[long], at[long] + ahead[long] + period[long], period[long]), axis=1)
        stretches, which = np.unique(found, axis=0, return_inverse=True)
        for k, (start, end, p) in enumerate(stretches.tolist()):
            q = known.get((start, end))
            if q is not None and p % q == 0:
                continue  # the same run by a multiple of its period
            if np.array_equal(ids[start : end - p], ids[start + p : end]):
                add(start, end, p)
            else:
                for point in at[long][which.ravel() == k].tolist():
                    add(*_exact(ids, point, p))
    return np.array(sorted((s, e - s, p) for (s, e), p in known.items()), np.int64).reshape(-1, 3)


def collapsed(n: int, runs: np.ndarray) -> np.ndarray:
    """Which of n words stay if each run keeps its first period only."""
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, runs[:, 0] + runs[:, 2], 1)
    np.add.at(edge, runs[:, 0] + runs[:, 1], -1)
    return np.cumsum(edge)[:n] == 0


_FOUND = "starts array<long>, lengths array<long>, periods array<long>, collapsed string"


def _found(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    for batch in texts:
        rows = []
        for text in batch:
            words = (text or "").encode().split()  # bytes split at ASCII white space only
            runs = find_runs(intern(words))
            if len(runs):
                words = [words[i] for i in np.flatnonzero(collapsed(len(words), runs)).tolist()]
            rows.append((*runs.T, b" ".join(words).decode()))
        yield pd.DataFrame(rows, columns=["starts", "lengths", "periods", "collapsed"])


def detect(docs: DataFrame, text: Column | None = None) -> DataFrame:
    """Adds _pr_runs (array of start, length, period; by start, then period) and _pr_collapsed to every row of docs.

    text: the text to search (default: the column text). Words are what ASCII
    white space separates; words are numbered from 0. _pr_collapsed: the words
    that are left when every run keeps its first period only, joined by one
    space. Null and empty texts have no words and no runs; of stretches that a
    period and its multiple describe, the smallest period counts; rows may
    repeat; an empty table gives an empty one. Other columns are carried along,
    whatever their names (names with the prefix _pr_ are taken).
    """
    rows = docs.withColumn("_pr_found", F.pandas_udf(_found, _FOUND)(F.col("text") if text is None else text))
    runs = F.arrays_zip("_pr_found.starts", "_pr_found.lengths", "_pr_found.periods").cast("array<struct<start:long,length:long,period:long>>")
    return rows.withColumns({"_pr_runs": runs, "_pr_collapsed": F.col("_pr_found.collapsed")}).drop("_pr_found")


def _plant(pairs: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    for texts, crcs in pairs:
        out = []
        for text, crc in zip(texts, crcs, strict=True):
            words = (text or "").encode().split() if crc is not None and crc % 10 == 0 else []
            if words:
                n, g = len(words), int(crc) // 10
                a = g % n
                p = 1 + (n - a) // (3 + g % 8)
                text = b" ".join(words[:a] + [words[a + i % p] for i in range(n - a)]).decode()
            out.append(text)
        yield pd.Series(out, dtype=object)


def with_planted_run(doc_id: Column, text: Column) -> Column:
    """text; of documents whose CRC-32 of the id ends in 0, the words from some place on repeat a period instead.

    With h the CRC-32, g = h div 10 and n words: from a = g mod n on, with period 1 + (n - a) div (3 + g mod 8). A null id plants nothing.
    """
    crc = F.coalesce(F.crc32(doc_id.cast("string").cast("binary")), F.lit(1))
    return F.pandas_udf(_plant, "string")(text, crc)


def digest(docs: DataFrame) -> DataFrame:
    """doc_id, n_runs, start, length, period, exponent_milli (of the longest run), runs_sha256, collapsed_sha256: one row per row of docs."""
    rows = detect(docs.select("doc_id", with_planted_run(F.col("doc_id"), F.col("text")).alias("text")))
    best = F.array_min(F.transform("_pr_runs", lambda r: F.struct((-r.length).alias("less"), r.start.alias("start"), r.length.alias("length"), r.period.alias("period"))))
    lines = F.array_join(F.transform("_pr_runs", lambda r: F.concat(r.start.cast("string"), F.lit(","), r.length.cast("string"), F.lit(","), r.period.cast("string"), F.lit("\n"))), "")
    rows = rows.select("doc_id", F.size("_pr_runs").cast("long").alias("n_runs"), best.alias("best"), F.sha2(lines.cast("binary"), 256).alias("runs_sha256"), F.sha2(F.col("_pr_collapsed").cast("binary"), 256).alias("collapsed_sha256"))
    return rows.select("doc_id", "n_runs", "best.start", "best.length", "best.period", F.floor(1000 * F.col("best.length") / F.col("best.period")).cast("long").alias("exponent_milli"), "runs_sha256", "collapsed_sha256")

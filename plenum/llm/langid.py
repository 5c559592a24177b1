"""Language identification by cross-parsing entropy.

A suffix automaton of labelled text per language gives the longest matches. The
letters of a text, with single spaces between the words, are parsed from left
to right into the fewest phrases that occur in a language's sample, across
words; the number of phrases, normalised by the lengths of sample and text,
estimates the cross entropy, and the language with the least wins.

The automata are flat tables over the bytes of UTF-8: the entry of a state and
a byte is the next state, or, marked by the sign, the state in which the next
phrase starts. Many texts are parsed side by side, a byte of each at a time.
"""

from __future__ import annotations

import math
import re
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Bounds of the labelled sample: rows and bytes per language; characters of all languages that come to the driver; bytes of all tables.
SAMPLE_ROWS, SAMPLE_BYTES, DRIVER_CHARS, TABLE_BYTES = 64, 32_000, 8_000_000, 64 << 20
#: Bytes of text that are parsed side by side, and the number of texts from which that pays.
TOGETHER, SIDE_BY_SIDE = 4 << 20, 24
#: A language doesn't explain a text that takes so many times the bits of letters drawn at random: texts in other alphabets do, names and numbers between words don't.
UNEXPLAINED = 1.5

_NEW = -(1 << 31)
_OTHER = re.compile(r"[\W\d_]+")


def automaton(text: bytes, size: int, steps: array) -> int:
    """Suffix automaton of a text over the symbols 0 to size - 1: appends a row of next states (-1: none) per state to steps, and returns the number of states."""
    base, link, length, last, empty = len(steps), [-1], [0], 0, array("i", [-1]) * size
    steps.extend(empty)
    for c in text:
        new, p, at = len(link), last, base + c
        steps.extend(empty)
        link.append(0)
        length.append(length[last] + 1)
        while p >= 0 and steps[p * size + at] < 0:
            steps[p * size + at] = new
            p = link[p]
        if p >= 0:
            q = steps[p * size + at]
            if length[q] == length[p] + 1:
                link[new] = q
            else:
                copy = len(link)
                steps.extend(steps[base + q * size : base + (q + 1) * size])
                link.append(link[q])
                length.append(length[p] + 1)
                while p >= 0 and steps[p * size + at] == q:
                    steps[p * size + at] = copy
                    p = link[p]
                link[q] = link[new] = copy
        last = new
    return len(link)


def normal(text: str | None) -> bytes:
    """The letters of a text in lower case, a space before, between and after the words; nothing without letters."""
    if not text or not any(map(str.isalpha, text)):
        return b""
    return f" {_OTHER.sub(' ', text.lower()).strip()} ".encode()


class Parser:
    """Counts the phrases of texts in each language of the samples (language -> normal text)."""

    def __init__(self, samples: dict[str, bytes], most: int = TABLE_BYTES):
        self.langs = sorted(samples)
        seen = sorted(set(b"".join(samples.values())))
        size = len(seen) + 1  # the last symbol is any other byte
        self.symbol = np.full(256, size - 1, np.uint8)
        self.symbol[seen] = np.arange(size - 1)
        self.symbols = size - 1
        bound = most // (8 * size * max(1, len(samples)))  # at most two states per byte
        steps, start, ends, self.bits = array("i"), [], [], []
        for lang in self.langs:
            text = self.symbol[np.frombuffer(samples[lang], np.uint8)[:bound]].tobytes()
            start.append(len(steps))
            automaton(text, size, steps)
            ends.append(len(steps))
            self.bits.append(math.log2(len(text) + 1))
        self.table = np.frombuffer(steps, np.int32)
        for at, end in zip(start, ends, strict=True):  # in place, as these tables are most of a worker's memory
            table = self.table[at:end].reshape(-1, size)
            none = table < 0
            table *= size
            table += at
            first = np.where(none[0], at, table[0]) | np.int32(_NEW)
            np.copyto(table, first, where=none)
            table[0] = first
        self.start = np.array(start, np.int64)

    def phrases(self, texts: list[bytes]) -> np.ndarray:
        """languages x texts: the number of phrases of each greedy parse; a byte that never occurs is a phrase."""
        order = sorted(range(len(texts)), key=lambda i: -len(texts[i]))
        lengths = np.array([len(texts[i]) for i in order], np.int64)
        codes = self.symbol[np.frombuffer(b"".join(texts[i] for i in order), np.uint8)]
        begin = np.cumsum(lengths) - lengths
        state = np.repeat(self.start[:, None], len(texts), axis=1)
        count = np.zeros(state.shape, np.int64)
        # Texts stand by length, so those that go on are the first k.
        steps = int(lengths[SIDE_BY_SIDE - 1]) if len(texts) >= SIDE_BY_SIDE else 0
        going = np.searchsorted(-lengths, -np.arange(steps), side="left").tolist()  # longer than the step
        for step, k in enumerate(going):
            to = self.table.take(state[:, :k] + codes.take(begin[:k] + step))
            count[:, :k] += to < 0
            state[:, :k] = to & 0x7FFFFFFF
        table = memoryview(self.table)
        for i in np.flatnonzero(lengths > steps).tolist():
            rest = codes[begin[i] + steps : begin[i] + lengths[i]].tobytes()
            for lang in range(len(self.langs)):
                at, n = int(state[lang, i]), 0
                for c in rest:
                    at = table[at + c]
                    if at < 0:
                        n += 1
                        at &= 0x7FFFFFFF
                count[lang, i] += n
        out = np.empty_like(count)
        out[:, order] = count
        return out

    def predict(self, texts: list[str | None]) -> list[tuple[str, float, bool]]:
        """Language, score, and whether the language explains the text, for each text."""
        out, group, held = [], [], 0
        for text in texts:
            group.append(normal(text))
            held += len(group[-1])
            if held >= TOGETHER:
                out += self._predict(group)
                group, held = [], 0
        return out + self._predict(group)

    def _predict(self, texts: list[bytes]) -> list[tuple[str, float, bool]]:
        if not self.langs:
            return [("und", 0.0, bool(t)) for t in texts]
        if not texts:
            return []
        found = []
        for text, counts in zip(texts, self.phrases(texts).T.tolist(), strict=True):
            if not text:
                found.append(("und", 0.0, False))
                continue
            cost = sorted((n * b / len(text), lang, (n - 1) * b) for n, b, lang in zip(counts, self.bits, self.langs, strict=True))
            score = 1 - cost[0][0] / cost[1][0] if len(cost) > 1 and cost[1][0] > 0 else 1.0
            found.append((cost[0][1], max(0.0, score), cost[0][2] <= UNEXPLAINED * len(text) * math.log2(self.symbols + 1)))
        return found


@lru_cache(maxsize=1)  # a worker keeps one set of tables, whatever it was asked for before
def parser(samples: tuple) -> Parser:
    return Parser(dict(samples))


def held_out(doc_id: str = "doc_id") -> Column:
    return F.coalesce(F.pmod(F.crc32(F.col(doc_id).cast("string")), F.lit(4)) == 2, F.lit(False))


def learn(docs: DataFrame, rows: int = SAMPLE_ROWS, most: int = SAMPLE_BYTES) -> dict[str, bytes]:
    """lang -> normal text of at most ``most`` bytes, from rows with a label and letters that aren't held out.

    The rows of a language are those with the smallest hash of doc_id, until
    their characters suffice; ranks are cut before the shuffle. At most 2 *
    ``most`` characters per language come to the driver, fewer if there are so
    many languages that DRIVER_CHARS would be exceeded. Runs at once.
    """
    labelled = docs.filter(~held_out() & F.col("lang").isNotNull() & F.col("doc_id").isNotNull())
    langs = labelled.select(F.count_distinct("lang")).head()[0]
    most = max(1, min(most, DRIVER_CHARS // max(1, 2 * langs)))
    some = labelled.filter(F.regexp_like("text", F.lit(r"\p{L}"))).select("doc_id", "lang", F.least(F.length("text"), F.lit(most)).alias("n"))
    by = Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id")
    ids = some.withColumn("r", F.row_number().over(by)).filter(F.col("r") <= rows)
    before = by.rowsBetween(Window.unboundedPreceding, -1)
    ids = ids.withColumn("held", F.coalesce(F.sum("n").over(before), F.lit(0))).filter(F.col("held") < most).select("doc_id", "lang").distinct()
    texts = labelled.select("doc_id", "lang", F.substring("text", 1, most).alias("t")).join(F.broadcast(ids), ["doc_id", "lang"], "left_semi")
    found: dict[str, list[tuple]] = {}
    for r in texts.dropDuplicates(["doc_id", "lang"]).collect():
        found.setdefault(r["lang"], []).append((r["doc_id"], r["t"]))
    return {lang: normal("\n".join(t or "" for _, t in sorted(ts)))[:most] for lang, ts in found.items()}


def predictor(spark, samples: dict[str, bytes]):
    """A column function text -> struct(lang_pred, score, fits). The samples are bounded, so they are broadcast."""
    sent = spark.sparkContext.broadcast(tuple(sorted(samples.items())))

    @F.pandas_udf("lang_pred string, score double, fits boolean")
    def predict(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        tables = parser(sent.value)
        for texts in batches:
            yield pd.DataFrame(tables.predict(texts.tolist()), columns=["lang_pred", "score", "fits"])

    return predict.asNondeterministic()  # so that the optimizer doesn't copy it where its fields are used


def identify(docs: DataFrame, samples: dict[str, bytes] | None = None) -> DataFrame:
    """doc_id, held_out, lang_pred, score, one row per row of docs.

    Only the text decides. ``und`` (score 0) if it is null or without letters,
    or if nothing could be learnt; ties go to the first language by code point.
    Score: 1 minus the best over the second-best entropy; 1 with one language.
    Rows may repeat; an empty table gives an empty table; other columns are not
    read. Without samples, learn() runs at once.
    """
    predict = predictor(docs.sparkSession, learn(docs) if samples is None else samples)
    rows = docs.select("doc_id", held_out().alias("held_out"), predict("text").alias("p"))
    return rows.select("doc_id", "held_out", "p.lang_pred", "p.score")


def keep_identified(docs: DataFrame) -> DataFrame:
    """The rows of docs in one of the languages, with the columns of docs (the name _li_p is taken); where lang is null it becomes the prediction.

    Null texts and those without letters go, and those that the best language
    takes UNEXPLAINED times the bits for that letters drawn at random would (one
    phrase is free, so that short texts stay). If nothing can be learnt, all rows with
    letters stay. Repeated rows are treated alike; an empty table gives an empty one.
    """
    samples = learn(docs)
    if not samples:
        return docs.filter(F.regexp_like("text", F.lit(r"\p{L}")))
    rows = docs.withColumn("_li_p", predictor(docs.sparkSession, samples)("text")).filter("_li_p.fits")
    return rows.withColumn("lang", F.coalesce("lang", "_li_p.lang_pred")).drop("_li_p")

"""Quality rules as a bitmask ledger.

Each rule is evaluated once per document; the ledger keeps the measurements and
one failure bit per rule. A policy is a versioned mask over the rules, so that
other policies and ablations are bitwise work on the ledger, without the texts.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .words import WordHash, hashes, windows

_SYMBOLS, _SPACE = b"#*$%&|<>", b" \t\n\x0b\x0c\r"
MEASURES = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_lines long, n_stutter long"


def _measure(text: str | None, cache: WordHash) -> tuple[int, ...]:
    raw = (text or "").encode()
    words = raw.split()  # bytes split at ASCII white space only
    n = len(words)
    lines = [line for line in raw.split(b"\n") if line.strip()]
    h = hashes(words, cache)
    repeated = 0
    if n > 8:
        _, at, count = np.unique(windows(h, 8), return_inverse=True, return_counts=True)
        twice = count[at] > 1
        if twice.any():  # equal hashes are confirmed on the words
            where = np.flatnonzero(twice).tolist()
            runs = [tuple(words[i : i + 8]) for i in where]
            seen = Counter(runs)
            twice[where] = [seen[r] > 1 for r in runs]
            edge = np.zeros(n + 1, np.int64)
            edge[: n - 7] += twice
            edge[8 : n + 1] -= twice
            repeated = int((np.cumsum(edge) > 0).sum())
    continued = len(raw) - len(text or "")
    return (n, len(raw) - continued - (len(raw) - len(raw.translate(None, _SPACE))), len(raw) - len(raw.translate(None, _SYMBOLS)), len(lines) - len(set(lines)), repeated, len(lines), int((h[1:] == h[:-1]).sum()))


def _measures(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    cache = WordHash()
    names = [x.split()[0] for x in MEASURES.split(", ")]
    for texts in batches:
        yield pd.DataFrame([_measure(t, cache) for t in texts], columns=names)


def rules(m: str = "_ql_m") -> list[tuple[str, Column]]:
    """Name and failure condition of each rule, in the order of the bits. New rules go to the end."""
    c = lambda name: F.col(f"{m}.{name}")
    return [
        ("few_words", c("n_words") < 20),
        ("repeated_words", 100 * c("n_repeat_words") > 30 * c("n_words")),
        ("symbols", 10 * c("n_symbols") > c("n_words")),
        ("word_length", (c("word_chars") < 2 * c("n_words")) | (c("word_chars") > 15 * c("n_words"))),
        ("repeated_lines", 2 * c("n_dup_lines") > c("n_lines")),
        ("stutter", 10 * c("n_stutter") > 3 * c("n_words")),
    ]


RULES = tuple(("few_words", "repeated_words", "symbols", "word_length", "repeated_lines", "stutter"))
#: Versions of the policy: the rules that a document must not fail.
POLICIES = {"base": RULES[:2], "v1": RULES}


def mask(names) -> int:
    return sum(1 << RULES.index(n) for n in names)


def ledger(docs: DataFrame) -> DataFrame:
    """docs without text, with the measurements (struct _ql_m) and _ql_failed (long, bit i for rule i); one row per row of docs.

    Null text has no words and so fails the first rule; rows may repeat; an
    empty table gives an empty one. Other columns are carried along, whatever
    their names (names with the prefix _ql_ are taken).
    """
    kept = [F.col(f"`{c}`") for c in docs.columns if c != "text"]
    rows = docs.select(*kept, F.pandas_udf(_measures, MEASURES)("text").alias("_ql_m"))
    bits = sum((F.when(fails, F.lit(1 << i)).otherwise(F.lit(0)) for i, (_, fails) in enumerate(rules())), F.lit(0))
    return rows.withColumn("_ql_failed", bits.cast("long"))


def verdict(policy: str) -> Column:
    return F.col("_ql_failed").bitwiseAND(F.lit(mask(POLICIES[policy]))) == 0


def ablation(rows: DataFrame, policy: str = "v1") -> DataFrame:
    """rule, n_failed, n_only: how many documents fail each rule, and how many the policy would keep without it.

    Documents are counted per distinct mask first (2 to the number of rules at most), then the masks per rule.
    """
    whole = mask(POLICIES[policy])
    masks = rows.groupBy(F.col("_ql_failed").bitwiseAND(F.lit(whole)).alias("bits")).agg(F.count(F.lit(1)).alias("n"))
    each = masks.withColumn("rule", F.explode(F.array(*[F.lit(RULES.index(r)) for r in POLICIES[policy]])))
    bit = F.expr("shiftleft(1L, rule)")
    name = F.element_at(F.array(*[F.lit(r) for r in RULES]), F.col("rule") + 1)
    hit = F.col("bits").bitwiseAND(bit) != 0
    return each.groupBy(name.alias("rule")).agg(F.coalesce(F.sum(F.when(hit, F.col("n"))), F.lit(0)).alias("n_failed"), F.coalesce(F.sum(F.when(F.col("bits") == bit, F.col("n"))), F.lit(0)).alias("n_only"))


def digest(docs: DataFrame, policy: str = "v1") -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, failed."""
    rows = ledger(docs.select("doc_id", "text"))
    return rows.select("doc_id", "_ql_m.n_words", "_ql_m.word_chars", "_ql_m.n_symbols", "_ql_m.n_dup_lines", "_ql_m.n_repeat_words", (~verdict("base")).alias("base_failed"), verdict(policy).alias("kept"), F.col("_ql_failed").alias("failed"))

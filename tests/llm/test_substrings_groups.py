"""Removal of repeated strings against brute force where one gram is in very many texts, and with very long texts."""

import hashlib
import random
from collections import Counter

import pytest

from plenum.llm import common, substrings


def expected(raws: list[bytes]) -> list[tuple]:
    seen = Counter(b[i : i + 200] for b in raws for i in range(len(b) - 199))
    out = []
    for b in raws:
        gone = sorted({j for i in range(len(b) - 199) if seen[b[i : i + 200]] > 1 for j in range(i, i + 200)})
        runs = sum(1 for k, j in enumerate(gone) if k == 0 or gone[k - 1] != j - 1)
        out.append((len(b), len(gone), runs, hashlib.sha256(bytes(x for i, x in enumerate(b) if i not in set(gone))).hexdigest()))
    return out


def texts(seed: int) -> list[str]:
    rng = random.Random(seed)
    letters = lambda n: "".join(rng.choices("abcdefghij é", k=n))
    line, passage = letters(70), letters(260)
    out = []
    for i in range(60):
        parts = [letters(rng.randrange(0, 240)), line, letters(rng.randrange(60, 200))]
        if i % 3 == 0:
            parts.insert(rng.randrange(4), passage)
        if i % 7 == 0:
            parts.insert(rng.randrange(4), passage[:199])
        out.append("".join(parts))
    return out + out[:5] + ["ab" * 300, passage, passage[1:], line * 6, "", "é" * 150]


@pytest.mark.parametrize("group,hot", [(512, 1000), (4, 3), (1, 1)])
def test_one_gram_in_many_texts(spark, monkeypatch, group, hot):
    monkeypatch.setattr(substrings, "GROUP", group)
    monkeypatch.setattr(common, "HOT_ROWS", hot)
    rows = list(enumerate(texts(9)))
    want = expected([t.encode() for _, t in rows])
    found = substrings.remove(spark.createDataFrame([*rows, (-1, None)], "doc_id long, text string")).collect()
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in found}
    assert got.pop(-1) == (0, 0, 0, hashlib.sha256(b"").hexdigest())
    assert got == dict(enumerate(want))
    assert sum(w[1] > 0 for w in want) > 15 and max(w[2] for w in want) > 1


def test_very_long_texts(spark):
    rng = random.Random(1)
    long = "".join(rng.choices("abcdefghijklmnop", k=400_000))
    rows = [(1, long), (2, long[1000:1300]), (3, long[:199]), (3, long[:199])]
    found = {r.doc_id: (r.n_removed, r.n_spans) for r in substrings.remove(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert found == {1: (300, 1), 2: (300, 1), 3: (0, 0)}


def test_ids_of_any_type(spark):
    """Text and null ids, with repeats; the same as with numbers."""
    text = " ".join(f"word{i}" for i in range(90))
    rows = [("a", text), ("b", "x" + text), (None, text[100:]), ("a", None), ("c", "short")]
    found = {(r.doc_id, r.n_bytes): (r.n_removed, r.n_spans) for r in substrings.remove(spark.createDataFrame(rows, "doc_id string, text string")).collect()}
    assert found == {("a", len(text)): (len(text), 1), ("b", len(text) + 1): (len(text), 1), (None, len(text) - 100): (len(text) - 100, 1), ("a", 0): (0, 0), ("c", 5): (0, 0)}

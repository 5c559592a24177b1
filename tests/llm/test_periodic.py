"""Runs against a plain search, with hashes that collide, long texts and the planted runs of the query."""

import hashlib
import random
import time
import zlib

import numpy as np
import pytest

from plenum.llm import periodic


def brute(words, least=12):
    n, found = len(words), {}
    for p in range(1, n // 2 + 1):
        i = 0
        while i + p < n:
            j = i
            while j + p < n and words[j] == words[j + p]:
                j += 1
            if j > i and j + p - i >= max(least, 2 * p):
                found.setdefault((i, j + p), p)
            i = j + 1
    return sorted((s, e - s, p) for (s, e), p in found.items())


def samples(count):
    rng = random.Random(7)
    for k in range(count):
        n, letters = rng.randrange(0, 100), "ab" if k % 3 else "abcde"
        w = [rng.choice(letters) for _ in range(n)]
        if n > 30 and k % 2:
            s, p = rng.randrange(n - 12), rng.randrange(1, 9)
            for i in range(s + p, min(n, s + p * rng.randrange(2, 6) + rng.randrange(3))):
                w[i] = w[i - p]
        yield w
    a, b = ["0"], ["1"]
    for _ in range(8):  # the sequence on which hashes modulo a power of two collide
        a, b = a + b, b + a
    yield a


@pytest.mark.parametrize("hashed", [None, lambda ids: np.zeros(len(ids), np.uint64), lambda ids: (ids % 2).astype(np.uint64)])
def test_runs(hashed):
    for w in samples(600 if hashed is None else 150):
        ids = periodic.intern([x.encode() for x in w])
        found = periodic.find_runs(ids, hashed=hashed and hashed(ids))
        assert [tuple(r) for r in found.tolist()] == brute(w)


def test_pieces_of_the_grid(monkeypatch):
    monkeypatch.setattr(periodic, "PAIRS", 7)
    for w in samples(100):
        assert [tuple(r) for r in periodic.find_runs(periodic.intern([x.encode() for x in w])).tolist()] == brute(w)


def test_long_texts_take_little_more_than_linear_time():
    took = []
    for n in (50_000, 200_000):
        began = time.process_time()
        assert periodic.find_runs(np.zeros(n, np.int64)).tolist() == [[0, n, 1]]
        assert periodic.find_runs(np.arange(n) % 977).tolist() == [[0, n, 977]]
        assert len(periodic.find_runs(np.arange(n))) == 0
        took.append(time.process_time() - began)
    assert took[1] < 10 * max(took[0], 0.3)


def planted(doc_id, words):
    h, n = zlib.crc32(str(doc_id).encode()), len(words)
    if doc_id is None or h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]


def test_digest(spark):
    rng = random.Random(3)
    texts = [None, "", " \t\n", "x " * 15, "a b " * 6, "a b " * 5 + "a", "é ü\x0b" * 9, "one two three four five six " * 3 + "tail"] + [" ".join(rng.choice(("s", "t", "u")) for _ in range(rng.randrange(60))) for _ in range(200)]
    rows = [(i, t) for i, t in enumerate(texts)] + [(3, texts[3]), (None, texts[3])]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS start", "2 AS n_runs", "'x' AS period")
    want = []
    for d, t in rows:
        words = planted(d, (t or "").encode().split())
        runs = brute(words)
        gone = {i for s, n, p in runs for i in range(s + p, s + n)}
        best = min(runs, key=lambda r: (-r[1], r[0], r[2])) if runs else (None, None, None)
        sha = lambda b: hashlib.sha256(b).hexdigest()
        want.append((d, len(runs), *best, 1000 * best[1] // best[2] if runs else None, sha("".join("%d,%d,%d\n" % r for r in runs).encode()), sha(b" ".join(w for i, w in enumerate(words) if i not in gone))))
    assert sorted(map(str, want)) == sorted(str(tuple(r)) for r in periodic.digest(docs).collect())
    assert periodic.digest(docs.limit(0)).count() == 0
    found = periodic.detect(docs.filter("doc_id = 4")).first()
    assert found.n_runs == 2 and found["_pr_collapsed"] == "a b" and [tuple(r) for r in found["_pr_runs"]] == [(0, 12, 2)]

"""Nearest vectors against brute force, with invalid vectors, ties, copies and repeated rows."""

import numpy as np
import pytest

from plenum.llm import ann


def brute(rows, k=20, every=20):
    found, at = [], [(i, np.array(v, float)) for i, v in rows if usable(i, v)]
    for q, v in {i: min((x for j, x in at if j == i), key=lambda x: x.tobytes()) for i, _ in at if i % every == 0}.items():
        near = sorted(((-float(sum(a * b for a, b in zip(v, x, strict=True))), i) for i, x in at if i != q))[:k]
        found += [(q, rank, i, -s) for rank, (s, i) in enumerate(near, 1)]
    return sorted(found)


def usable(i, v):
    return i is not None and v is not None and all(c is not None and np.isfinite(c) for c in v) and any(v)


def frame(spark, rows):
    rows = [(i, v and [c if c is None else float(c) for c in v]) for i, v in rows]
    return spark.createDataFrame(rows, "vec_id long, embedding array<double>").selectExpr("*", "1 AS rank", "2 AS score", "'x' AS id", "0 AS code")


def test_invalid_vectors_ties_and_repeats(spark):
    rng = np.random.default_rng(1)
    rows = [(i, rng.standard_normal(6).round(1).tolist()) for i in range(120)]
    rows += [(200 + i, rows[3][1]) for i in range(60)] + [rows[7]] * 2 + [(500, None), (520, [0.0] * 6), (540, [1.0, None, 1, 1, 1, 1]), (560, [float("nan")] * 6), (580, [float("inf")] * 6), (600, []), (620, [1.0, 2.0]), (None, [1.0] * 6)]
    found = sorted(tuple(r) for r in ann.digest(frame(spark, rows)).collect())
    assert found == brute([r for r in rows if not r[1] or len(r[1]) == 6])


def test_fewer_candidates_and_empty_tables(spark):
    assert ann.digest(frame(spark, [])).count() == 0
    assert ann.digest(frame(spark, [(20, [1.0, 2.0])])).count() == 0
    assert [tuple(r) for r in ann.digest(frame(spark, [(20, [1.0, 2.0]), (3, [2.0, 0.0])])).collect()] == [(20, 1, 3, 2.0)]


@pytest.mark.parametrize("dim", [3, 64, 300])
def test_recall_and_lengths(spark, dim, monkeypatch):
    """Vectors of very different lengths, in several rounds, blocks and slabs: nearly all true neighbours, with exact scores."""
    monkeypatch.setattr(ann, "LEAST_SLAB", 100)
    monkeypatch.setattr(ann, "FIRST", 150)
    monkeypatch.setattr(ann, "GROWTH", 3)
    rng = np.random.default_rng(dim)
    rows = [(i, (rng.standard_normal(dim) * rng.choice([0.01, 1.0, 30.0])).tolist()) for i in range(1500)]
    found, want = {tuple(r) for r in ann.digest(frame(spark, rows)).collect()}, brute(rows)
    assert len(found) == len(want)
    near = {(q, i): s for q, _, i, s in found}
    assert sum(near.get((q, i)) == s for q, _, i, s in want) >= 0.98 * len(want)


def test_error_bound_holds():
    rng = np.random.default_rng(5)
    x, q = rng.standard_normal((3000, 64)), rng.standard_normal((40, 64))
    x[:40] = q + 0.2 * x[:40]  # some near ones
    codes, length, fit = ann.encode(x)
    guess, error = ann.Queries(q).estimates(codes, fit)
    true = q @ x.T / np.sqrt((q * q).sum(1))[:, None] / length
    assert abs((guess - true).mean()) < 2e-3
    assert (np.abs(guess - true) > ann.EPSILON * error).mean() < 0.004
    assert np.abs(guess - true).std() / error.mean() < 1.1

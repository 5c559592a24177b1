"""Components of large groups of near copies against all pairs."""

import random

import numpy as np
import pytest

from plenum.llm import common, minhash


def near_copies(seed: int, groups: int, size: int, words: int = 64) -> list[tuple[int, str]]:
    """Copies with one to four changed words, so that similarities lie around 0.75."""
    rng, texts = random.Random(seed), []
    for g in range(groups):
        base = [f"g{g}w{i}" for i in range(words)]
        for v in range(size):
            copy = list(base)
            for at in rng.sample(range(words), rng.choice((1, 2, 2, 3, 4))):
                copy[at] = f"v{v}x{rng.randrange(3)}"
            texts.append(" ".join(copy))
    ids = rng.sample(range(10 * len(texts)), len(texts))
    return list(zip(ids, texts, strict=True))


def components(rows: list[tuple[int, str]]) -> tuple[dict[int, int], int]:
    """doc_id -> smallest doc_id of its component, from all pairs; and the number of links."""
    sets = {d: {tuple(w[i : i + 5]) for i in range(len(w) - 4)} for d, t in rows for w in [t.split()]}
    ids, up, links = sorted(sets), {d: d for d in sets}, 0

    def root(d: int) -> int:
        while up[d] != d:
            d = up[d]
        return d

    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            both = len(sets[a] & sets[b])
            if 100 * both >= 75 * (len(sets[a]) + len(sets[b]) - both):
                links += 1
                x, y = sorted((root(a), root(b)))
                up[y] = x
    return {d: root(d) for d in ids}, links


@pytest.mark.parametrize("pivots,entries,hot", [(2, 16, 8), (256, 512, 1000)])
def test_large_groups(spark, monkeypatch, pivots, entries, hot):
    monkeypatch.setattr(minhash, "PIVOTS", pivots)
    monkeypatch.setattr(minhash, "MEMBERS", 16)
    monkeypatch.setattr(minhash, "ENTRIES", entries)
    monkeypatch.setattr(common, "HOT_ROWS", hot)
    rows = near_copies(3, groups=3, size=190)
    want, links = components(rows)
    sizes = sorted(list(want.values()).count(c) for c in set(want.values()))
    assert links > 500 and sizes[-1] > 40 and sizes.count(1) > 20, "the fixture has groups and single rows"
    found = minhash.digest(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.doc_id: r.component_id for r in found} == want
    assert all(r.kept == (r.doc_id == want[r.doc_id]) and r.n_shingles == 60 for r in found)


def test_bands_and_sketches_miss_no_pair():
    """Pairs at a similarity of exactly 0.75, of sets of several sizes."""
    rng, n = np.random.default_rng(5), 0
    for part in (1, 2, 10, 100):
        for _ in range(400):
            both, a, b = (rng.integers(0, 2**63, k * part, dtype=np.uint64) for k in (6, 1, 1))
            x, y = (minhash.minhash(np.unique(np.concatenate((both, own)))) for own in (a, b))
            apart = np.unpackbits((minhash.odd_sketch(x) ^ minhash.odd_sketch(y)).view(np.uint8)).sum()
            n += bool((minhash.bands(x) == minhash.bands(y)).any() and apart <= minhash.MOST_BITS)
    assert n == 1600


def test_edges(spark):
    long = " ".join(f"w{i}" for i in range(60_000))
    rows = [(1, long, "a"), (2, long + " more", "b"), (3, "a B c", "c"), (4, "A b\tC", "d"), (4, "A b\tC", "d"), (5, "a b", "e"), (6, " \n", "f"), (7, None, "g")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, key string").selectExpr("*", "'x' AS bucket", "1 AS n")
    found = sorted((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in minhash.digest(docs).collect())
    assert found == [(1, 59_996, 1, True), (2, 59_997, 1, False), (3, 1, 3, True), (4, 1, 3, False), (4, 1, 3, False), (5, 1, 5, True), (6, 0, 6, True), (7, 0, 7, True)]
    assert minhash.digest(docs.limit(0)).collect() == [] and minhash.keep_one(docs).columns == docs.columns

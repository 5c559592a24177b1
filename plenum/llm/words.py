"""Hashes of words and of runs of words, in numpy."""

from __future__ import annotations

import numpy as np
import xxhash

#: Odd multipliers for the positions in a run of words.
_MUL = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB], dtype=np.uint64)


class Recent(dict):
    """A memo of make(key) in two generations of ``kept`` short keys: when the younger is full, the older is forgotten."""

    kept = 60_000

    def __init__(self):
        super().__init__()
        self.older: dict = {}

    def make(self, key):
        raise NotImplementedError

    def __missing__(self, key):
        found = self.older.get(key)
        if found is None:
            found = self.make(key)
        if len(key) <= 64:
            if len(self) >= self.kept:
                self.older = dict(self)
                self.clear()
            self[key] = found
        return found


class WordHash(Recent):
    """word (bytes) -> 64-bit hash."""

    def make(self, key: bytes) -> int:
        return xxhash.xxh64_intdigest(key)


def hashes(words: list[bytes], cache: WordHash) -> np.ndarray:
    return np.fromiter(map(cache.__getitem__, words), np.uint64, len(words))


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads all bits."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h = h ^ (h >> np.uint64(29))
    h = h * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(32))


def windows(h: np.ndarray, k: int) -> np.ndarray:
    """Hash of every run of k words; with fewer words (but some), of the whole sequence."""
    n = len(h)
    if n == 0:
        return h
    k = min(k, n)
    out = h[: n - k + 1] * _MUL[0]
    for j in range(1, k):
        out = out + h[j : n - k + 1 + j] * _MUL[j]
    return mix(out + np.uint64(k))

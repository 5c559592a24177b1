"""Two-stage suffix sorting of a few segments, inside a task."""

from __future__ import annotations

import numpy as np


def suffix_array(buf: bytes, most: int, wanted: np.ndarray | None = None) -> list[int]:
    """buf: segments, each followed by a zero byte and free of others. Starts in the order of the suffixes up to their zero.

    Only the suffixes that are smaller than their successors are sorted
    directly (their first ``most`` bytes reach the zero). One scan over the
    buckets then induces the rest: a suffix greater than its successor goes to
    the next free place at the head of its bucket once its successor is passed.

    wanted: which starts are asked for (default: all). With them come those that
    they are induced from, so the others, such as starts near the end of a
    segment, are neither sorted nor scanned.
    """
    t = np.frombuffer(buf, np.uint8)
    n = len(t)
    step = np.zeros(n, np.int8)
    step[:-1] = np.sign(t[1:].astype(np.int16) - t[:-1].astype(np.int16))
    step[t == 0] = 1  # the zeros are the smallest bucket and placed directly
    places = np.arange(n)
    known = np.where(step != 0, places, n)
    known = np.minimum.accumulate(known[::-1])[::-1]
    smaller = step[np.minimum(known, n - 1)] > 0
    there = np.ones(n, bool)
    if wanted is not None:
        # A suffix is induced from its successors, as far as the first that is smaller than its own.
        sure = np.minimum.accumulate(np.where(smaller, places, n)[::-1])[::-1]
        ended = np.bincount(sure[wanted] + 1, minlength=n + 2)[:n]
        there = np.cumsum(wanted - ended) > 0
    counts = np.bincount(t[there], minlength=256)
    ends = np.cumsum(counts)
    heads = (ends - counts).tolist()
    direct = sorted(np.flatnonzero(smaller & (t > 0) & there).tolist(), key=lambda i: buf[i : i + most])
    order = np.full(int(ends[-1]), -1, np.int64)
    order[: counts[0]] = np.flatnonzero((t == 0) & there)
    if direct:
        first = t[direct]
        per = np.bincount(first, minlength=256)
        tails = (ends - per)[first] + np.arange(len(direct)) - (np.cumsum(per) - per)[first]
        order[tails] = direct
    out, larger = order.tolist(), (~smaller & there).tolist()
    for k in range(len(out)):
        j = out[k] - 1
        if j >= 0 and larger[j]:
            c = buf[j]
            out[heads[c]] = j
            heads[c] += 1
    return out


def repeated(segments: list[bytes], width: int) -> list[np.ndarray]:
    """For each segment, which of its starts have a string of ``width`` bytes that also starts elsewhere in the segments.

    Bytes must be below 255. Starts with less than ``width`` bytes behind them are left out.
    """
    shift = bytes(min(255, i + 1) for i in range(256))
    buf = b"".join(s.translate(shift) + b"\0" for s in segments)
    lengths = np.array([len(s) for s in segments])
    begin = np.cumsum(lengths + 1) - (lengths + 1)
    whole = np.zeros(len(buf), bool)
    for b, n in zip(begin.tolist(), lengths.tolist()):
        whole[b : b + max(0, n - width + 1)] = True
    order = np.array(suffix_array(buf, int(lengths.max()) + 1, whole), np.int64)
    order = order[whole[order]].tolist()  # suffixes with a common prefix of that width stand together
    twice = np.zeros(len(buf), bool)
    before, text = -1, b""
    for i in order:
        now = buf[i : i + width]
        if now == text:
            twice[i] = twice[before] = True
        before, text = i, now
    return [twice[b : b + max(0, n - width + 1)] for b, n in zip(begin.tolist(), lengths.tolist())]

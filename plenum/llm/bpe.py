"""Byte-level BPE by monoid tree reduction.

The encoding of a text is a list of pieces (the matches of the pattern), each
with its token ids. Halves are encoded recursively; two neighbours are joined by
re-encoding a window that starts before the seam, at the last piece that the
seam can't have changed, and grows to the right until it reaches a boundary of
the right half: a match depends only on the text from its start to at most
LOOKAHEAD characters behind its end, so everything outside the window stays.
Long pieces are halved in the same way, down to their bytes: tokens are joined
by merging the bytes of a window around the seam, which grows until its first
and last token stand with their neighbours as the two alone would be encoded.
Tokens of which each adjacent pair does so are the encoding, so all outside of
the window stays. Decoding concatenates the bytes of halves.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .words import Recent

#: Characters of a leaf, and the most that the pattern looks at behind a piece that it could have made longer.
LEAF, LOOKAHEAD = 4096, 2


def merge(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The ids of one piece: the adjacent pair of least rank is merged until no pair has a rank."""
    if piece in ranks:
        return [ranks[piece]]
    return merged(piece, ranks)


def merged(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The ids that merging alone gives."""
    if len(piece) > 256:
        return _merge_long(piece, ranks)
    n, get, never = len(piece), ranks.get, len(ranks) + 1
    ends = list(range(n + 1))  # where tokens start and end
    of_pair = [get(piece[i : i + 2], never) for i in range(n - 1)]
    while of_pair and (least := min(of_pair)) < never:
        i = of_pair.index(least)
        del ends[i + 1], of_pair[i]
        if i:
            of_pair[i - 1] = get(piece[ends[i - 1] : ends[i + 1]], never)
        if i < len(of_pair):
            of_pair[i] = get(piece[ends[i] : ends[i + 2]], never)
    return [ranks[piece[a:b]] for a, b in zip(ends, ends[1:], strict=False)]


def _merge_long(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """merged() with a heap and a linked list, for bytes of any length."""
    from heapq import heapify, heappop, heappush

    n = len(piece)
    end, before, alive = [*range(1, n + 1)], [*range(-1, n - 1)], [True] * n
    heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(piece[i : i + 2])) is not None]
    heapify(heap)
    while heap:
        _, i, stop = heappop(heap)
        if not alive[i] or (j := end[i]) >= n or end[j] != stop:
            continue
        alive[j], end[i] = False, stop
        if stop < n:
            before[stop] = i
            if (r := ranks.get(piece[i : end[stop]])) is not None:
                heappush(heap, (r, i, end[stop]))
        if (p := before[i]) >= 0 and (r := ranks.get(piece[p:stop])) is not None:
            heappush(heap, (r, p, stop))
    return [ranks[piece[i : end[i]]] for i in range(n) if alive[i]]


class Codec(Recent):
    """piece -> ids."""

    #: Prose has very many different words; a generation takes about 50 MB.
    kept = 200_000

    def __init__(self, rank_file: bytes, pattern: str):
        super().__init__()
        self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, rank_file.splitlines()) if a}
        self.bytes_of = {i: b for b, i in self.ranks.items()}
        self.spelled = {i: str(i) for i in self.bytes_of}
        self.pattern = regex.compile(pattern)

    def make(self, key: str) -> tuple[int, ...]:
        return tuple(merge(key.encode(), self.ranks))

    def pieces(self, text: str, start: int = 0, stop: int | None = None, leaf: int = LEAF) -> list[str]:
        stop = len(text) if stop is None else stop
        if stop - start <= leaf:
            return self.pattern.findall(text[start:stop])
        middle = (start + stop) // 2
        return self.join(text, self.pieces(text, start, middle, leaf), middle, stop, self.pieces(text, middle, stop, leaf))

    def join(self, text: str, left: list[str], seam: int, stop: int, right: list[str]) -> list[str]:
        """The pieces of text[..stop] from those of the parts before and from the seam."""
        at = seam
        while left and at + LOOKAHEAD > seam:
            at -= len(left.pop())
        match, boundary, i = self.pattern.match, seam, 0
        while at < stop:
            to = match(text, at, stop).end()
            left.append(text[at:to])
            at = to
            while boundary < at:
                boundary += len(right[i])
                i += 1
            if boundary == at:
                left += right[i:]
                break
        return left

    def stands(self, a: int, b: int) -> bool:
        """Whether two tokens side by side are what their bytes are encoded as."""
        return merged(self.bytes_of[a] + self.bytes_of[b], self.ranks) == [a, b]

    def halved(self, piece: bytes, leaf: int) -> list[int]:
        """The ids of the bytes of a long piece."""
        if len(piece) <= max(1, leaf):
            return merged(piece, self.ranks)
        middle = len(piece) // 2
        left, right = self.halved(piece[:middle], leaf), self.halved(piece[middle:], leaf)
        i = j = 1  # tokens of either side that the window takes
        while True:
            window = merged(self.decode(left[-i:] + right[:j]), self.ranks)
            first = i >= len(left) or self.stands(left[-i - 1], window[0])
            last = j >= len(right) or self.stands(window[-1], right[j])
            if first and last:
                return left[: max(0, len(left) - i)] + window + right[j:]
            i, j = i if first else 2 * i, j if last else 2 * j

    def encode(self, text: str, leaf: int = LEAF) -> list[int]:
        pieces = self.pieces(text, leaf=leaf)
        if max(map(len, pieces), default=0) <= leaf:
            return list(chain.from_iterable(map(self.__getitem__, pieces)))
        ids: list[int] = []
        for p in pieces:
            whole = p.encode()
            ids += self[p] if len(p) <= leaf or whole in self.ranks else self.halved(whole, leaf)
        return ids

    def decode(self, ids: list[int], most: int = 1 << 16) -> bytes:
        if len(ids) <= most:
            return b"".join(map(self.bytes_of.__getitem__, ids))
        middle = len(ids) // 2
        return self.decode(ids[:middle], most) + self.decode(ids[middle:], most)

    def digest(self, text: str | None) -> tuple[int, str, str]:
        ids = self.encode(text or "")
        spelled = " ".join(map(self.spelled.__getitem__, ids))
        return len(ids), hashlib.sha256(spelled.encode()).hexdigest(), hashlib.sha256(self.decode(ids)).hexdigest()


@lru_cache(maxsize=1)
def _codec(rank_file: bytes, pattern: str) -> Codec:
    return Codec(rank_file, pattern)


def vocabulary() -> tuple[bytes, str]:
    """The rank file and the pattern of the public 50k vocabulary, read on the driver."""
    import public_tokenizers

    with open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as f:
        return f.read(), public_tokenizers.PATTERN


def _sent(docs: DataFrame, vocab):
    """The vocabulary has a fixed size (under 1 MB), so it is broadcast."""
    return docs.sparkSession.sparkContext.broadcast(vocab or vocabulary())


def digest(docs: DataFrame, vocab: tuple[bytes, str] | None = None) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256, one row per row of docs.

    Null counts as empty: no tokens, digests of nothing. Other columns are not read.
    """
    sent = _sent(docs, vocab)

    @F.pandas_udf("n_tokens long, ids_sha256 string, decoded_sha256 string")
    def encoded(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        codec = _codec(*sent.value)
        for texts in batches:
            yield pd.DataFrame([codec.digest(t) for t in texts], columns=["n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select("doc_id", encoded("text").alias("e")).select("doc_id", "e.*")


def encode(docs: DataFrame, vocab: tuple[bytes, str] | None = None) -> DataFrame:
    """The columns of docs and ids, an array of int (null text: empty; the name ids is taken)."""
    sent = _sent(docs, vocab)

    @F.pandas_udf("array<int>")
    def ids(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        codec = _codec(*sent.value)
        for texts in batches:
            yield pd.Series([codec.encode(t or "") for t in texts])

    return docs.withColumn("ids", ids("text"))


def decode(rows: DataFrame, vocab: tuple[bytes, str] | None = None) -> DataFrame:
    """The columns of rows and decoded, the bytes of ids (null: empty)."""
    sent = _sent(rows, vocab)

    @F.pandas_udf("binary")
    def text(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        codec = _codec(*sent.value)
        for arrays in batches:
            yield pd.Series([codec.decode([] if a is None else [int(i) for i in a]) for a in arrays])

    return rows.withColumn("decoded", text("ids"))

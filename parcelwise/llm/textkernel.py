"""Vectorised word and n-gram hashing over Arrow batches of text (numpy, inside tasks)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Texts are hashed in chunks of about so many bytes; a longer text is a chunk of its own. A chunk takes some 60 times its bytes while it is hashed.
CHUNK_BYTES = 256 << 10
_BASE = 0x9E3779B97F4A7C15 | 1
_MASK = (1 << 64) - 1
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 9, 10, 11, 12, 13]] = True
#: ASCII bytes other than digits and small letters: what parts words in the alphanumeric sense, in lower-cased text.
PUNCTUATION = np.zeros(256, bool)
PUNCTUATION[:0x80] = True
PUNCTUATION[[*range(0x30, 0x3A), *range(0x61, 0x7B)]] = False
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BYTE = np.random.default_rng(20240607).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values, so that their order looks random."""
    h = h.astype(np.uint64, copy=True)
    h ^= h >> np.uint64(30)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


_powers = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers 0..n of the base and of its inverse, modulo 2**64; kept for usual chunk sizes."""
    if n > _powers.get("n", -1):
        inverse = pow(_BASE, -1, 1 << 64)
        table = []
        for base in (_BASE, inverse):
            out = np.ones(1, np.uint64)
            while len(out) <= n:
                out = np.concatenate([out, out * np.uint64(pow(base, len(out), 1 << 64))])
            table.append(out[: n + 1].copy())
        if n > 4 * CHUNK_BYTES:
            return table[0], table[1]
        _powers.update(n=n, table=tuple(table))
    return _powers["table"]


class Chunk:
    """Words of a run of texts.

    start, end: byte range of each word in ``data``; doc: the text it belongs to;
    hash: its 64-bit hash. Words are maximal runs of bytes that ``apart`` doesn't mark
    (ASCII white space unless stated). hashed: False leaves the hashes out.
    """

    def __init__(self, data: np.ndarray, offsets: np.ndarray, lower: bool, apart: np.ndarray = _SPACE, hashed: bool = True):
        self.data = _LOWER[data] if lower else data
        self.offsets = offsets
        self.n = len(offsets) - 1
        size = len(data)
        self.space = apart[self.data]
        inside = np.ones(size + 2, bool)
        inside[1:-1] = self.space
        first = np.zeros(size + 1, bool)
        first[offsets] = True  # a new text begins a new word
        word = ~inside
        starts = word[1:-1] & (inside[:-2] | first[:-1])
        ends = word[1:-1] & (inside[2:] | first[1:])
        self.start = np.flatnonzero(starts)
        self.end = np.flatnonzero(ends) + 1
        self.doc = np.searchsorted(offsets, self.start, side="right") - 1
        if not hashed:
            return
        self.power, self.inverse = powers(size)
        self.prefix = np.zeros(size + 1, np.uint64)
        np.cumsum(_BYTE[self.data] * self.power[:size], out=self.prefix[1:])
        self.hash = self.span(self.start, self.end)

    def span(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Hashes of byte ranges; equal ranges have equal hashes wherever they stand."""
        h = (self.prefix[end] - self.prefix[start]) * self.inverse[start]
        return mix(h + (end - start).astype(np.uint64))

    def grams(self, n: int, h: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(index of first word, hash) of each run of n words inside one text."""
        m = len(self.hash) - n + 1
        if m <= 0:
            return np.zeros(0, np.int64), np.zeros(0, np.uint64)
        at = np.flatnonzero(self.doc[:m] == self.doc[n - 1 :])
        total = np.zeros(len(at), np.uint64)
        for j in range(n):
            total = total * np.uint64(_BASE) + self.hash[at + j]
        return at, mix(total + np.uint64(n))

    def words_of(self) -> tuple[np.ndarray, np.ndarray]:
        """First word and number of words of each text."""
        count = np.bincount(self.doc, minlength=self.n)
        return np.concatenate([[0], np.cumsum(count)[:-1]]).astype(np.int64), count


def utf8(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of an Arrow string array; null counts as empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    if not len(texts):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = texts.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def chunks(texts: pa.Array, lower: bool, apart: np.ndarray = _SPACE, hashed: bool = True) -> Iterator[tuple[int, int, Chunk]]:
    """(from, to, Chunk) over rows of ``texts``, each of about CHUNK_BYTES."""
    data, offsets = utf8(texts)
    at, n = 0, len(offsets) - 1
    while at < n:
        to = int(np.searchsorted(offsets, offsets[at] + CHUNK_BYTES, side="right")) - 1
        to = min(max(to, at + 1), n)
        yield at, to, Chunk(data[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at], lower, apart, hashed)
        at = to

"""Hashes of words and word shingles of many texts at once, in numpy.

Texts are laid end to end as bytes. A word is a run of bytes that are no separator; its hash is a
polynomial over its lower-cased bytes, taken modulo 2^64 and mixed, so equal words get equal hashes
wherever they stand.
"""

from __future__ import annotations

import numpy as np

from .common import slices

BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
MIX = (np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every bit (the splitmix64 finaliser)."""
    x = (x ^ (x >> np.uint64(30))) * MIX[0]
    x = (x ^ (x >> np.uint64(27))) * MIX[1]
    return x ^ (x >> np.uint64(31))


def lower_table() -> np.ndarray:
    t = np.arange(256, dtype=np.uint8)
    t[65:91] += 32
    return t


def separators(ranges: list[tuple[int, int]]) -> np.ndarray:
    """A table of bytes, true for those in the ranges (both ends included)."""
    t = np.zeros(256, bool)
    for a, b in ranges:
        t[a : b + 1] = True
    return t


WHITE = separators([(0x20, 0x20), (0x09, 0x0D)])
LOWER = lower_table()
_powers = np.ones(1, np.uint64)


def powers(n: int) -> np.ndarray:
    global _powers
    if len(_powers) < n:
        with np.errstate(over="ignore"):
            _powers = np.cumprod(np.concatenate([[np.uint64(1)], np.full(max(n, 2 * len(_powers)), BASE, np.uint64)]))
    return _powers[:n]


class Words:
    """The words of a batch of texts.

    hashes: one of each word; doc: the text it is in; first[d], first[d + 1]: the words of text d.
    """

    def __init__(self, texts: list[bytes], separator: np.ndarray):
        lengths = np.array([len(t) + 1 for t in texts], np.int64)
        raw = np.frombuffer(b" ".join(texts) + b" ", np.uint8)
        inside = ~separator[raw]
        edge = np.diff(inside.view(np.int8), prepend=np.int8(0))
        self.start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        size = end - self.start
        ends = np.cumsum(lengths)
        self.first = np.searchsorted(self.start, np.concatenate([[0], ends])).astype(np.int64)
        self.counts = np.diff(self.first)
        self.doc = np.repeat(np.arange(len(texts)), self.counts)
        self.hashes = self._hash(LOWER[raw], self.start, size)

    @staticmethod
    def _hash(low: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
        """sum of (byte + 1) * BASE^place over each word, by places, long words in the end by themselves."""
        out = np.zeros(len(start), np.uint64)
        if not len(start):
            return out
        place, live = powers(64), np.arange(len(start))
        longest = int(size.max())
        for k in range(min(longest, 64)):
            if k:
                live = live[size[live] > k]
            out[live] += (low[start[live] + k].astype(np.uint64) + np.uint64(1)) * place[k]
        if longest > 64:
            for i in np.flatnonzero(size > 64).tolist():
                part = low[start[i] : start[i] + size[i]].astype(np.uint64) + np.uint64(1)
                out[i] = (part * powers(len(part))).sum(dtype=np.uint64)
        return mix(out + size.astype(np.uint64))

    def grams(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(place of the first word, hash) of every run of k words within a text."""
        n = len(self.hashes) - k + 1
        if n <= 0:
            return np.zeros(0, np.int64), np.zeros(0, np.uint64)
        whole = np.flatnonzero(self.doc[:n] == self.doc[k - 1 : k - 1 + n])
        h = np.zeros(len(whole), np.uint64)
        for j in range(k):
            h = mix(h * np.uint64(3) + self.hashes[whole + j])
        return whole, h

    def shingles(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(text, hash) of all shingles: runs of k words, and the whole of a text with fewer words."""
        at, h = self.grams(k)
        doc = self.doc[at]
        short = np.flatnonzero((self.counts > 0) & (self.counts < k))
        if len(short):
            more = np.zeros(len(short), np.uint64)
            for j in range(k - 1):
                has = self.counts[short] > j
                more[has] = mix(more[has] * np.uint64(3) + self.hashes[self.first[short[has]] + j])
            doc, h = np.concatenate([doc, short]), np.concatenate([h, mix(more + self.counts[short].astype(np.uint64))])
        return doc, h


def text_batches(column, most: int = 4 << 20):
    """Slices (from, to, list of bytes) of an Arrow string column, each of few bytes or a single text."""
    for a, b in slices(column, most):
        yield a, b, column.slice(a, b - a).cast("binary").to_pylist()

"""Hashes of all words and word n-grams of many texts at once, without a loop over words.

A word is a run of bytes other than space and 0x09-0x0D. Its hash is a polynomial over random
64-bit values of its bytes modulo 2**64, read off a running sum, then mixed.
"""

from __future__ import annotations

import numpy as np

SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
_BASE = 0x9E3779B97F4A7C15
_VALUES = np.random.Generator(np.random.PCG64(20)).integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_FOLDED = _VALUES.copy()
_FOLDED[0x41:0x5B] = _VALUES[0x61:0x7B]
_powers: list[np.ndarray] = []


def _tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _powers or len(_powers[0]) < n:
        size = -(-n // (1 << 19)) << 19
        out = []
        for b in (_BASE, pow(_BASE, -1, 1 << 64)):
            p = np.full(size, b, np.uint64)
            p[0] = 1
            out.append(np.cumprod(p))
        _powers[:] = out
    return _powers[0], _powers[1]


def mix(h: np.ndarray) -> np.ndarray:
    """Spreads every bit over all bits."""
    h = h ^ (h >> np.uint64(33))
    h *= np.uint64(0xFF51AFD7ED558CCD)
    h ^= h >> np.uint64(33)
    h *= np.uint64(0xC4CEB9FE1A85EC53)
    h ^= h >> np.uint64(33)
    return h


class Words:
    """Words of a run of texts: byte places, hashes, and for each text the index of its first word."""

    def __init__(self, raw: np.ndarray, offsets: np.ndarray, fold: bool = False, hashes: bool = True):
        full = ~SPACE[raw]
        first = np.zeros(len(raw) + 1, bool)
        first[offsets] = True
        begins = full.copy()
        begins[1:] &= ~full[:-1] | first[1:-1]
        ends = full.copy()
        ends[:-1] &= ~full[1:] | first[1:-1]
        self.raw, self.offsets = raw, offsets
        self.starts = np.flatnonzero(begins)
        self.stops = np.flatnonzero(ends) + 1
        self.bounds = np.searchsorted(self.starts, offsets)  # text i has words bounds[i]..bounds[i+1]
        self.counts = np.diff(self.bounds)
        if hashes:
            power, inverse = _tables(len(raw) + 1)
            sums = np.zeros(len(raw) + 1, np.uint64)
            np.cumsum((_FOLDED if fold else _VALUES)[raw] * power[: len(raw)], out=sums[1:])
            self.hash = mix((sums[self.stops] - sums[self.starts]) * inverse[self.starts])

    def __len__(self) -> int:
        return len(self.starts)

    def of_text(self) -> np.ndarray:
        """For each word, its text."""
        return np.repeat(np.arange(len(self.counts)), self.counts)

    def grams(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of the n-grams that start at each word, and which of them stay inside a text."""
        size = len(self.hash)
        out = np.zeros(size, np.uint64)
        for j in range(n):
            out[: max(0, size - j)] += self.hash[j:] * np.uint64(pow(_BASE, 2 * j + 1, 1 << 64))
        last = np.repeat(self.bounds[1:], self.counts)
        return mix(out), np.arange(size) + n <= last


def shingle_hashes(words: Words, k: int, at: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the k-word shingles that start at each word, and which words start one.

    A text of fewer words has one, of all its words. With ``at`` (byte places) only the shingles that
    start there are returned.
    """
    h, inside = words.grams(k)
    short = np.flatnonzero((words.counts < k) & (words.counts > 0))
    if len(short):
        # the gram of a short text must not reach into the next text
        for t in short:
            lo, n = words.bounds[t], int(words.counts[t])
            alone = Words.__new__(Words)
            alone.hash, alone.bounds, alone.counts = words.hash[lo : lo + n], np.array([0, n]), np.array([n])
            h[lo] = alone.grams(k)[0][0]
            inside[lo] = True
    if at is not None:
        where = np.searchsorted(words.starts, at)
        return h[where], inside[where]
    return h, inside

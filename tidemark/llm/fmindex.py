"""A compressed full-text index over integer sequences: Burrows-Wheeler transform, entropy-shaped wavelet tree, backward search."""

from __future__ import annotations

import numpy as np

#: The bits before each place of a word.
_BEFORE = (np.uint64(1) << np.arange(64, dtype=np.uint64)) - np.uint64(1)


class Bits:
    """A bit vector with counts for every 64 bits: ``ones(i)`` is the number of 1s before place i."""

    def __init__(self, bits: np.ndarray):
        padded = np.zeros((len(bits) // 64 + 1) * 8, np.uint8)
        packed = np.packbits(bits, bitorder="little")
        padded[: len(packed)] = packed
        self.words = padded.view(np.uint64)
        self.before = np.zeros(len(self.words), np.int32)
        np.cumsum(np.bitwise_count(self.words[:-1]), out=self.before[1:])

    def ones(self, i: np.ndarray) -> np.ndarray:
        word = i >> 6
        return self.before[word] + np.bitwise_count(self.words[word] & _BEFORE[i & 63])


class WaveletTree:
    """How often symbol c stands before place i, for arrays of c and i.

    The tree is compressed to about the entropy of the symbols: one that makes up 2**-b of all has a code of b bits,
    rounded up (Shannon), so frequent symbols are short to store and to look up. A level holds the next code bit of
    all symbols with a code that long, in the order of the bits before; a symbol's place in it is known beforehand.
    """

    def __init__(self, symbols: np.ndarray, sigma: int):
        count = np.bincount(symbols, minlength=sigma).astype(np.int64)
        there = np.flatnonzero(count)
        size = np.ones(sigma, np.int64)
        if len(there):
            size[there] = np.maximum(1, np.ceil(np.log2(len(symbols) / count[there]) - 1e-9).astype(np.int64))
        # canonical codes: shorter ones first, each left-aligned in `top` bits
        order = there[np.argsort(size[there], kind="stable")]
        top = int(size[order].max()) if len(order) else 1
        weight = np.int64(1) << (top - size[order])
        aligned = np.zeros(sigma, np.int64)
        aligned[order] = np.cumsum(weight) - weight
        self.size, self.code, self.top = size.astype(np.uint8), aligned, top
        self.levels: list[tuple[Bits, np.ndarray, np.ndarray]] = []
        for level in range(top):
            longer = size[order] > level
            prefix = aligned[order] >> (top - level)
            held = np.where(longer, count[order], 0)
            ends = np.cumsum(held)
            fresh = np.ones(len(order), bool)
            fresh[1:] = prefix[1:] != prefix[:-1]
            first = (ends - held)[np.flatnonzero(fresh)]
            start = np.zeros(sigma, np.int32)
            start[order] = np.repeat(first, np.diff(np.append(np.flatnonzero(fresh), len(order))))
            bit = ((aligned >> (top - 1 - level)) & 1).astype(bool)
            bits = bit[symbols]
            vector = Bits(bits)
            self.levels.append((vector, start, vector.ones(start.astype(np.int64)).astype(np.int32)))
            if level + 1 < top:
                # the next level has the same symbols but those that end here, each node's zeros before its ones
                stay = size[symbols] > level + 1
                symbols, bits = symbols[stay], bits[stay]
                nodes = (aligned >> (top - level - 1))[symbols]
                symbols = symbols[_by_node(nodes)]

    def ranks(self, c: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """How often each of ``c``, symbols that occur, stands before each of ``lo`` and of ``hi``."""
        order = np.argsort(self.size[c], kind="stable")  # so that those with a code that goes on are a slice
        s = c[order]
        size, code = self.size[s], self.code[s]
        x = np.stack([lo[order], hi[order]]).astype(np.int32)
        for level, (bits, start, ones) in enumerate(self.levels):
            k = int(np.searchsorted(size, level, "right"))
            if k == len(s):
                break
            at = x[:, k:]
            t = s[k:]
            one = bits.ones(at + start[t]) - ones[t]
            np.copyto(at, np.where((code[k:] >> (self.top - 1 - level)) & 1, one, at - one))
        out = np.empty((2, len(s)), np.int64)
        out[:, order] = x
        return out[0], out[1]


def _by_node(nodes: np.ndarray) -> np.ndarray:
    """A stable order by node; nodes come in runs already, so a level only parts its runs."""
    if len(nodes) and int(nodes.max()) < 1 << 16:
        return np.argsort(nodes.astype(np.uint16), kind="stable")
    return np.argsort(nodes, kind="stable")


def bounded_suffix_array(text: np.ndarray, depth: int) -> tuple[np.ndarray, tuple[int, np.ndarray, np.ndarray]]:
    """Places of ``text`` sorted by their first ``depth`` symbols or more; and the seeds of the first sort.

    The first sort takes as many symbols as fit in 63 bits; after that only places that are still equal to another are
    sorted again, by the ranks of what follows, so each round doubles what is compared. Seeds are the number of
    symbols of the first sort, and for each place the interval of the so many symbols that begin there.
    """
    n = len(text)
    if not n:
        return np.zeros(0, np.int64), (1, np.zeros(0, np.int32), np.zeros(0, np.int32))
    width = max(1, int(text.max()).bit_length() + 1)
    length = min(depth, max(1, 63 // width))
    key = np.zeros(n, np.int64)
    for j in range(length):
        key <<= width
        key[: n - j] += text[j:].astype(np.int64) + 1
    order = np.argsort(key, kind="stable")
    fresh = np.ones(n, bool)
    fresh[1:] = key[order[1:]] != key[order[:-1]]
    rank = np.empty(n, np.int64)
    groups = np.flatnonzero(fresh)
    sizes = np.diff(np.append(groups, n))
    lo, hi = np.empty(n, np.int32), np.empty(n, np.int32)
    lo[order] = np.repeat(groups, sizes)
    hi[order] = np.repeat(groups + sizes, sizes)
    seeds = (length, lo, hi)
    while True:
        # a place's rank is that of the first of its equals
        first = np.maximum.accumulate(np.where(fresh, np.arange(n), 0))
        rank[order] = first + 1
        tied = ~fresh
        tied[:-1] |= ~fresh[1:]
        if length >= depth or not tied.any():
            return order, seeds
        at = np.flatnonzero(tied)
        places = order[at]
        after = np.where(places + length < n, rank[np.minimum(places + length, n - 1)], 0)
        again = np.lexsort((after, first[at]))
        order[at] = places[again]
        a, g = after[again], first[at][again]
        new = np.ones(len(at), bool)
        new[1:] = (a[1:] != a[:-1]) | (g[1:] != g[:-1])
        fresh[at] = new
        length *= 2


class FMIndex:
    """Finds patterns of up to ``depth`` symbols in ``text`` (symbols from 0 to sigma - 1).

    Suffixes are sorted by their first ``depth`` symbols only. The interval of a pattern P is extended
    to cP by counting c before its ends in the transform; that count needs the order of suffixes by
    their first |P| symbols and no more, so the intervals of such patterns are exact. The suffix array is dropped when
    the transform is made: an interval's size says how often a pattern occurs, and its start names the pattern.
    ``seeds`` are the intervals of the few symbols from each place of the text, as the first sort finds them.
    """

    def __init__(self, text: np.ndarray, sigma: int, depth: int):
        places, self.seeds = bounded_suffix_array(text, depth)
        self.before = np.zeros(sigma + 1, np.int64)
        np.cumsum(np.bincount(text, minlength=sigma), out=self.before[1:])
        # the transform takes the text as a ring; patterns never hold the separator at the seam
        self.tree = WaveletTree(text[places - 1], sigma)
        self.size = len(text)

    def extend(self, c: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Intervals of cP from those of P."""
        a, b = self.tree.ranks(c, lo, hi)
        return self.before[c] + a, self.before[c] + b


def matching_statistics(index: FMIndex, stream: np.ndarray, ends: np.ndarray, most: int, often: np.ndarray, seeded: bool = False, block: int = 1 << 17) -> tuple[np.ndarray, np.ndarray]:
    """For each of ``ends``: the length of the longest run of symbols of ``stream`` that ends there (inclusive) and occurs
    ``often`` times or more in the index, up to ``most``; and a name for the run of those that reach ``most``.

    A run is extended to the left by backward search as long as its interval is large enough. The same runs have the
    same name, the start of their interval. ``seeded``: the stream is the index's own text, ``most`` symbols stand before
    each end, and runs begin with the index's seeds; a length below these is given as 0. A run that need only occur once
    reaches ``most`` when it is the only one, and its name then also says how long it was.
    """
    sizes, los = np.zeros(len(ends), np.int32), np.zeros(len(ends), np.int64)
    size, seed_lo, seed_hi = index.seeds if seeded else (0, None, None)
    for first in range(0, len(ends), block):
        at = np.arange(first, min(first + block, len(ends)))
        if seeded:
            begin = ends[at] - size + 1
            lo, hi = seed_lo[begin].astype(np.int64), seed_hi[begin].astype(np.int64)
        else:
            lo, hi = np.zeros(len(at), np.int64), np.full(len(at), index.size, np.int64)
        for j in range(size, most + 1):
            on = hi - lo >= often[at]
            if not on.all():
                at, lo, hi = at[on], lo[on], hi[on]
            sizes[at] = j
            if j == most or not len(at):
                break
            if seeded:
                alone = hi - lo == 1
                if alone.any():
                    sizes[at[alone]], los[at[alone]] = most, lo[alone] + (most - j) * (index.size + 1)
                    at, lo, hi = at[~alone], lo[~alone], hi[~alone]
            lo, hi = index.extend(stream[ends[at] - j], lo, hi)
        los[at] = lo
    return sizes, los

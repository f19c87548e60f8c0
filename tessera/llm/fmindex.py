"""A compressed full-text index (FM-index) over sequences of word numbers.

The Burrows-Wheeler transform is kept in a wavelet matrix: one bit vector per
bit of the alphabet, packed 64 to a word with a running count per word, so rank
is a table look-up and a population count.  Suffixes are ordered by their first
``ORDER`` symbols only; for patterns of at most that length, backward search on
this transform gives the interval it gives on the full one.  All queries of a
batch are stepped together.
"""

from __future__ import annotations

import numpy as np

#: symbols by which suffixes are ordered; the longest pattern
ORDER = 16


class BitVector:
    """Packed bits with constant-time rank."""

    def __init__(self, bits: np.ndarray):
        padded = np.zeros(-(-(len(bits) + 1) // 64) * 64, np.uint8)
        padded[:len(bits)] = bits
        self.words = np.packbits(padded, bitorder="little").view(np.uint64)
        count = np.bitwise_count(self.words).astype(np.int64)
        self.before = (np.cumsum(count) - count).astype(np.int32)

    def rank(self, i: np.ndarray) -> np.ndarray:
        """Ones among the first ``i`` bits."""
        word, rest = i >> 6, (i & 63).astype(np.uint64)
        mask = (np.uint64(1) << rest) - np.uint64(1)
        return self.before[word] + np.bitwise_count(self.words[word] & mask)


class WaveletMatrix:
    """Rank of any symbol in a sequence of numbers below ``size``."""

    def __init__(self, seq: np.ndarray, size: int):
        self.levels, self.zeros = [], []
        self.bits = max(1, int(size - 1).bit_length())
        for level in range(self.bits - 1, -1, -1):
            bit = ((seq >> level) & 1).astype(np.uint8)
            self.levels.append(BitVector(bit))
            self.zeros.append(len(seq) - int(bit.sum()))
            seq = np.concatenate([seq[bit == 0], seq[bit == 1]])

    def counts(self, symbol: np.ndarray, low: np.ndarray, high: np.ndarray):
        """Occurrences of ``symbol`` before ``low`` and before ``high``, per query."""
        n = len(symbol)
        at = np.concatenate([np.zeros(n, np.int64), low, high])
        for k, (bits, zeros) in enumerate(zip(self.levels, self.zeros, strict=True)):
            one = np.tile(((symbol >> (self.bits - 1 - k)) & 1).astype(bool), 3)
            r = bits.rank(at).astype(np.int64)
            at = np.where(one, r + zeros, at - r)
        return at[n:2 * n] - at[:n], at[2 * n:] - at[:n]


def suffix_order(seq: np.ndarray, order: int = ORDER) -> np.ndarray:
    """Places of ``seq`` in the order of the ``order`` symbols that start there
    (prefix doubling; ``order`` is a power of two).  Ties stay in text order."""
    rank = seq.astype(np.int64)
    length = 1
    while True:
        after = np.zeros_like(rank)
        after[:-length or None] = rank[length:] + 1 if length < len(rank) else 0
        key = rank * (int(rank.max(initial=0)) + 2) + after
        places = np.argsort(key, kind="stable")
        length *= 2
        if length >= order:
            return places
        ordered = key[places]
        rank = np.empty_like(rank)
        rank[places] = np.cumsum(np.r_[0, ordered[1:] != ordered[:-1]])


class FmIndex:
    """Index of a sequence of numbers; 0 is kept for separators."""

    def __init__(self, seq: np.ndarray, size: int):
        self.places = suffix_order(seq)
        before = self.places - 1
        self.matrix = WaveletMatrix(seq[before], size)  # place -1 is the last symbol
        self.first = np.concatenate([[0], np.cumsum(np.bincount(seq, minlength=size))])

    def search(self, patterns: np.ndarray, cut: int = 0) -> tuple[np.ndarray, np.ndarray]:
        """Interval of suffixes that start with each row of ``patterns``, by
        backward search.  Queries whose interval has shrunk to ``cut`` or fewer
        suffixes leave early and get that interval."""
        n, length = patterns.shape
        low = self.first[patterns[:, -1]].copy()
        high = self.first[patterns[:, -1] + 1].copy()
        live = np.flatnonzero(high - low > cut)
        for j in range(length - 2, -1, -1):
            if not len(live):
                break
            c = patterns[live, j]
            lo, hi = self.matrix.counts(c, low[live], high[live])
            low[live], high[live] = self.first[c] + lo, self.first[c] + hi
            live = live[hi - lo > cut]
        return low, high

    def matching_lengths(self, pattern: np.ndarray, longest: int = ORDER) -> np.ndarray:
        """Matching statistics: for each place of ``pattern``, the length of the
        longest match (up to ``longest``) of the text that starts there."""
        out = np.zeros(len(pattern), np.int64)
        for length in range(1, longest + 1):
            at = np.arange(len(pattern) - length + 1)
            at = at[out[at] == length - 1]
            if not len(at):
                break
            low, high = self.search(pattern[at[:, None] + np.arange(length)])
            out[at[high > low]] = length
        return out

"""Word hashes of Arrow text columns, computed on the bytes.

A word is a run of bytes other than 0x20 and 0x09 to 0x0D.  Its hash is a
polynomial in random 64-bit byte values, mixed with a finaliser; runs of words
are hashed as sums of word hashes times odd constants.  Nothing is done per
word or per row in Python.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa

#: bytes hashed at a time (cut between words); the tables of powers, which a
#: worker keeps, and the products are 8 bytes for each
PIECE = 1 << 18


@lru_cache(maxsize=1)
def _tables():
    rng = np.random.default_rng(20240229)
    value = rng.integers(1, 1 << 63, 256, np.uint64) * np.uint64(2) + np.uint64(1)
    space = np.zeros(256, bool)
    space[[0x20, *range(0x09, 0x0E)]] = True
    value[space] = 0
    lower = np.arange(256, dtype=np.uint8)
    lower[0x41:0x5B] += 0x20
    return value, space, lower


@lru_cache(maxsize=1)
def constants(n: int = 64) -> np.ndarray:
    """Odd multipliers for the places of a run."""
    return np.random.default_rng(20240301).integers(0, 1 << 63, n, np.uint64) * np.uint64(2) + np.uint64(1)


def mixed(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (bijective)."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


@lru_cache(maxsize=4)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    base = 0x9E3779B97F4A7C15 | 1
    inverse = pow(base, -1, 1 << 64)
    out = []
    for b in (base, inverse):
        p = np.full(n, b, np.uint64)
        p[0] = 1
        out.append(np.cumprod(p, dtype=np.uint64))
    return tuple(out)


class Words:
    """The words of a text column: ``start`` and ``end`` (places in ``data``),
    ``hash``, and ``first`` (the place in these arrays of each row's first
    word, plus the total)."""

    def __init__(self, column, lower: bool = False):
        if isinstance(column, pa.ChunkedArray):
            column = column.combine_chunks()
        column = column.cast(pa.large_string()).fill_null("")
        value, space, lowered = _tables()
        offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset:column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
        raw = column.buffers()[2] if len(column) else None
        data = np.frombuffer(raw, np.uint8)[offsets[0]:offsets[-1]] if raw is not None and offsets[-1] > offsets[0] else np.zeros(0, np.uint8)
        offsets = offsets - offsets[0]
        #: bytes of all rows, and where each row begins (and the last ends)
        self.data, self.offsets = data, offsets
        inside = ~space[data]
        edge = np.zeros(len(data) + 1, bool)
        edge[offsets] = True
        begins = inside.copy()
        begins[1:] &= ~inside[:-1] | edge[1:-1]
        self.start = np.flatnonzero(begins)
        ends = inside
        ends[:-1] &= ~inside[1:] | edge[1:-1]
        self.end = np.flatnonzero(ends) + 1
        self.first = np.searchsorted(self.start, offsets)
        self.rows = len(column)
        h = np.empty(len(self.start), np.uint64)
        i = 0
        while i < len(self.start):
            j = max(i + 1, int(np.searchsorted(self.end, self.start[i] + PIECE, "right")))
            a, b = int(self.start[i]), int(self.end[j - 1])
            size = 1 << max(10, (b - a - 1).bit_length())
            power, inverse = _powers(size)
            piece = lowered[data[a:b]] if lower else data[a:b]
            at = self.start[i:j] - a
            h[i:j] = np.add.reduceat(value[piece] * power[:b - a], at) * inverse[at]
            i = j
        self.hash = mixed(h + (self.end - self.start).astype(np.uint64))

    def row_of(self) -> np.ndarray:
        """Row of each word."""
        return np.repeat(np.arange(self.rows), np.diff(self.first))

    def joined(self, keep: np.ndarray) -> list[bytes]:
        """The kept words of each row, joined by one space."""
        out = np.zeros(len(self.data) + 1, np.int8)
        np.add.at(out, self.start[keep], 1)
        np.add.at(out, self.end[keep], -1)
        use = np.cumsum(out[:-1], dtype=np.int8).astype(bool)
        data = self.data.copy()
        kept = np.flatnonzero(keep)
        row = np.searchsorted(self.first, kept, "right") - 1
        more = kept[:-1][row[1:] == row[:-1]]  # another kept word follows in the row
        data[self.end[more]] = 0x20
        use[self.end[more]] = True
        at = np.r_[0, np.cumsum(use)][self.offsets]
        flat = data[use].tobytes()
        return [flat[a:b] for a, b in zip(at[:-1], at[1:], strict=True)]

    def runs(self, n: int) -> np.ndarray:
        """Hash of the run of ``n`` words from each place (as far as the array
        goes; which runs lie in one row is for the caller to say)."""
        c, h = constants(), self.hash
        size = max(0, len(h) - n + 1)
        out = np.zeros(size, np.uint64)
        for j in range(n):
            out += h[j:j + size] * c[j]
        return mixed(out)

    def shingles(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """(hash, row) of each row's runs of ``n`` words; a row with fewer words
        has one run of all of them."""
        runs, count = self.runs(n), np.diff(self.first)
        row = self.row_of()
        if len(runs):
            inside = row[:len(runs)] == row[n - 1:]
            hashes, rows = runs[inside], row[:len(runs)][inside]
        else:
            hashes, rows = runs, row[:0]
        short = np.flatnonzero((count > 0) & (count < n))
        if len(short):
            c = constants()
            place = np.arange(len(self.hash)) - self.first[row]
            few = np.isin(row, short)
            part = np.zeros(self.rows, np.uint64)
            np.add.at(part, row[few], self.hash[few] * c[place[few]])
            own = mixed(part[short] + count[short].astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
            hashes, rows = np.r_[hashes, own], np.r_[rows, short]
            order = np.argsort(rows, kind="stable")
            hashes, rows = hashes[order], rows[order]
        return hashes, rows

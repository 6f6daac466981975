"""Sorting many short byte strings by hashed comparisons.

The strings of a batch are suffixes cut at a fixed length, in groups that are sorted apart.  Prefix
polynomial hashes modulo 2**61 - 1 are kept for every prefix; the common extension of two strings is
found by binary search over them, so a comparison takes a logarithm of the length.  A merge sort places
each string of a run by binary search in the run beside it, all runs of all groups at once.  Afterwards
the common extensions of neighbours, and the bytes that decide their order, are verified on the bytes
themselves; a hash collision shows there, and the sort is done again with another base.
"""

from __future__ import annotations

import numpy as np

PRIME = np.uint64((1 << 61) - 1)
_LOW31, _LOW30 = np.uint64((1 << 31) - 1), np.uint64((1 << 30) - 1)
#: Bases of the hash, tried one after another.
BASES = [0x15A1B2C3D4E5F607, 0x0F1E2D3C4B5A6978, 0x1B2E4D8C6A9F7351, 0x091A3B5C7D9EBF24]


def fold(x: np.ndarray) -> np.ndarray:
    """x modulo 2**61 - 1."""
    x = (x & PRIME) + (x >> np.uint64(61))
    return np.where(x >= PRIME, x - PRIME, x)


def times(a: np.ndarray, b: np.ndarray | np.uint64) -> np.ndarray:
    """a * b modulo 2**61 - 1, by halves of 30 and 31 bits."""
    a1, a0 = a >> np.uint64(31), a & _LOW31
    b1, b0 = b >> np.uint64(31), b & _LOW31
    middle = a1 * b0 + a0 * b1
    total = fold(a0 * b0) + ((a1 * b1) << np.uint64(1)) + (middle >> np.uint64(30)) + ((middle & _LOW30) << np.uint64(31))
    return fold(total)


def prefix_hashes(rows: np.ndarray, base: int) -> np.ndarray:
    """Hashes of all prefixes of zero-padded byte rows; column j is that of the first j bytes."""
    out = np.zeros((rows.shape[1] + 1, len(rows)), dtype=np.uint64)
    b = np.uint64(base)
    for j in range(rows.shape[1]):
        out[j + 1] = fold(times(out[j], b) + rows[:, j] + np.uint64(1))
    return np.ascontiguousarray(out.T)


class Sorted:
    """Strings (zero-padded rows with lengths) sorted inside their groups: order, and each one's common extension with the one before (-1 at a group's first)."""

    def __init__(self, rows: np.ndarray, lengths: np.ndarray, group: np.ndarray, bases: list[int] = BASES):
        self.rows, self.lengths = rows, lengths.astype(np.int64)
        for base in bases:
            self.hashes = prefix_hashes(rows, base)
            if self._sort(group) and self._verified():
                del self.hashes
                return
        raise ArithmeticError("hash collisions with every base")

    def common(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        low, high = np.zeros(len(a), dtype=np.int64), np.minimum(self.lengths[a], self.lengths[b])
        while (low < high).any():
            middle = (low + high + 1) >> 1
            same = self.hashes[a, middle] == self.hashes[b, middle]
            low, high = np.where(same, middle, low), np.where(same, high, middle - 1)
        return low

    def before(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether string a sorts before b, strictly."""
        n, last = self.common(a, b), self.rows.shape[1] - 1
        at = np.minimum(n, last)
        return (n < self.lengths[b]) & ((n == self.lengths[a]) | (self.rows[a, at] < self.rows[b, at]))

    def _sort(self, group: np.ndarray) -> bool:
        """False if comparisons contradict one another."""
        order = np.argsort(group, kind="stable")
        g = group[order]
        first = np.flatnonzero(np.r_[True, g[1:] != g[:-1]]) if len(g) else np.zeros(0, np.int64)
        size = np.diff(np.r_[first, len(g)])
        begin, many = np.repeat(first, size), np.repeat(size, size)
        inside = np.arange(len(g)) - begin
        width = 1
        while width < size.max(initial=0):
            run = inside // (2 * width) * (2 * width)  # the pair of runs' begin
            left = inside - run < width
            other = np.where(left, run + width, run)
            other_size = np.clip(np.where(left, many - run - width, width), 0, width)
            at = np.flatnonzero(other_size > 0)
            low, high = np.zeros(len(at), dtype=np.int64), other_size[at].copy()
            item, base, is_left = order[at], begin[at] + other[at], left[at]
            live = np.arange(len(at))
            while len(live):
                middle = (low[live] + high[live]) >> 1
                with_ = order[base[live] + middle]
                mine, theirs = item[live], with_
                # a left string goes behind the right ones before it; a right one behind the left ones not after it
                goes = np.where(is_left[live], self.before(theirs, mine), ~self.before(mine, theirs))
                low[live] = np.where(goes, middle + 1, low[live])
                high[live] = np.where(goes, high[live], middle)
                live = live[low[live] < high[live]]
            place = inside - run - np.where(left, 0, width)
            place = begin + run + place
            place[at] += low
            new = np.full_like(order, -1)
            new[place] = order
            if (new < 0).any():
                return False
            order = new
            width *= 2
        self.order = order
        self.extension = np.full(len(order), -1, dtype=np.int64)
        at = np.flatnonzero(inside > 0)
        self.extension[at] = self.common(order[at - 1], order[at])
        return True

    def _verified(self) -> bool:
        at = np.flatnonzero(self.extension >= 0)
        for k in range(0, len(at), 1 << 15):
            part = at[k : k + (1 << 15)]
            a, b, n = self.order[part - 1], self.order[part], self.extension[part]
            differs = self.rows[a] != self.rows[b]
            real = np.where(differs.any(axis=1), differs.argmax(axis=1), self.rows.shape[1])
            if (np.minimum(real, np.minimum(self.lengths[a], self.lengths[b])) != n).any() or self.before(b, a).any():
                return False
        return True

    def classes(self, least: int) -> np.ndarray:
        """A number for each string, equal for those of a group that share `least` bytes."""
        out = np.empty(len(self.order), dtype=np.int64)
        out[self.order] = np.cumsum(self.extension < least)
        return out

    def nearest(self) -> np.ndarray:
        """The longest common extension of each string with another of its group."""
        out = np.empty(len(self.order), dtype=np.int64)
        out[self.order] = np.maximum(self.extension, np.r_[self.extension[1:], [-1]] if len(self.order) else self.extension)
        return out

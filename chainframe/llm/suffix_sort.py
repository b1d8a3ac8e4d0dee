"""Suffix sorting by hash comparison.

Prefix polynomial hashes give the hash of any substring at once, a binary
search over them the longest common extension of two suffixes, and that a
comparison in logarithmic time.  The mergesort below works on many groups of
suffixes together: every level merges all neighbouring runs by vectorised
binary search.  ``ranked`` then verifies the finished order byte by byte.
"""

from __future__ import annotations

import numpy as np

from .common import Powers

_BASE = 0x2545F4914F6CDD1D
_CODES = np.random.default_rng(20240229).integers(0, 1 << 64, 256, dtype=np.uint64, endpoint=False)
_POWERS = Powers(_BASE)


class HashCollision(Exception):
    """Equal hashes of different bytes; the caller compares bytes instead."""


def byte_codes(text: bytes | np.ndarray) -> np.ndarray:
    """A fixed random number for every byte."""
    return _CODES[np.frombuffer(text, dtype=np.uint8) if isinstance(text, bytes) else text]


class HashedText:
    def __init__(self, text: np.ndarray):
        self.bytes = text
        n = len(self.bytes)
        up, self.down = _POWERS.upto(n + 1)
        with np.errstate(over="ignore"):
            self.prefix = np.zeros(n + 1, dtype=np.uint64)
            np.cumsum(byte_codes(self.bytes) * up[:n], out=self.prefix[1:])

    def hashes(self, starts: np.ndarray, length: np.ndarray | int) -> np.ndarray:
        with np.errstate(over="ignore"):
            return (self.prefix[starts + length] - self.prefix[starts]) * self.down[starts]

    def common(self, a: np.ndarray, b: np.ndarray, limit: np.ndarray) -> np.ndarray:
        """The longest common extension of each pair of suffixes, ``limit`` at most."""
        low, high = np.zeros(len(a), dtype=np.int64), limit.astype(np.int64).copy()
        while (low < high).any():
            mid = (low + high + 1) >> 1
            same = self.hashes(a, mid) == self.hashes(b, mid)
            low, high = np.where(same, mid, low), np.where(same, high, mid - 1)
        return low

    def less(self, a: np.ndarray, b: np.ndarray, size_a: np.ndarray, size_b: np.ndarray) -> np.ndarray:
        """Whether the first ``size_a`` bytes at a come before the first ``size_b`` at b."""
        limit = np.minimum(size_a, size_b)
        n = self.common(a, b, limit)
        last = max(len(self.bytes) - 1, 0)
        return np.where(n >= limit, size_a < size_b, self.bytes[np.minimum(a + n, last)] < self.bytes[np.minimum(b + n, last)])

    def equal(self, a: np.ndarray, b: np.ndarray, length: np.ndarray) -> np.ndarray:
        """Byte by byte, which verifies what the hashes said."""
        out = np.ones(len(a), dtype=bool)
        for s in range(0, len(a), 1024):
            x, y, n = a[s : s + 1024], b[s : s + 1024], length[s : s + 1024]
            step = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            differs = self.bytes[np.repeat(x, n) + step] != self.bytes[np.repeat(y, n) + step]
            out[s : s + 1024] = np.bincount(np.repeat(np.arange(len(n)), n), weights=differs, minlength=len(n)) == 0
        return out


def sort_suffixes(text: HashedText, starts: np.ndarray, sizes: np.ndarray, groups: np.ndarray) -> np.ndarray:
    """The order of suffixes by (group, first ``sizes`` bytes, position); ``groups`` must be ascending."""
    order = np.arange(len(starts))
    if not len(starts):
        return order
    first = np.flatnonzero(np.diff(groups, prepend=groups[0] - 1))
    begin = np.repeat(first, np.diff(np.append(first, len(starts))))
    end = np.repeat(np.append(first[1:], len(starts)), np.diff(np.append(first, len(starts))))
    place = np.arange(len(starts)) - begin
    size, width = int((end - begin).max()), 1
    while width < size:
        run = place // width
        mate = begin + (run ^ 1) * width
        low, high = np.minimum(mate, end), np.minimum(mate + width, end)
        mate_first = low.copy()
        left = (run & 1) == 0
        while True:
            open_ = np.flatnonzero(low < high)
            if not len(open_):
                break
            mid = (low[open_] + high[open_]) >> 1
            mine, other = order[open_], order[mid]
            # of equal suffixes those of the left run come first
            x, y = np.where(left[open_], other, mine), np.where(left[open_], mine, other)
            before = text.less(starts[x], starts[y], sizes[x], sizes[y]) == left[open_]
            low[open_] = np.where(before, mid + 1, low[open_])
            high[open_] = np.where(before, high[open_], mid)
        own = place % width
        target = begin + (run >> 1) * 2 * width + own + (low - mate_first)
        merged = np.empty_like(order)
        merged[target] = order
        order = merged
        width *= 2
    return order


def ranked(text: HashedText, starts: np.ndarray, sizes: np.ndarray, groups: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The sorted order and each suffix's common extension with the one before it, -1 at the start of a group.

    Every extension is compared byte by byte, and the bytes after it must
    ascend; neighbours that pass make the whole order right.
    """
    order = sort_suffixes(text, starts, sizes, groups)
    extension = np.full(len(order), -1, dtype=np.int64)
    near = np.flatnonzero(groups[order[1:]] == groups[order[:-1]]) + 1
    x, y = order[near - 1], order[near]
    limit = np.minimum(sizes[x], sizes[y])
    n = text.common(starts[x], starts[y], limit)
    last = max(len(text.bytes) - 1, 0)
    ascends = np.where(n >= limit, sizes[x] <= sizes[y], text.bytes[np.minimum(starts[x] + n, last)] < text.bytes[np.minimum(starts[y] + n, last)])
    if not (ascends & text.equal(starts[x], starts[y], n)).all():
        raise HashCollision
    extension[near] = n
    return order, extension


class RangeMinimum:
    """Smallest value of any range, by ranges of powers of two."""

    def __init__(self, values: np.ndarray):
        self.levels = [values]
        width = 1
        while 2 * width <= len(values):
            before = self.levels[-1]
            self.levels.append(np.minimum(before[:-width], before[width:]))
            width *= 2

    def over(self, first: np.ndarray, last: np.ndarray) -> np.ndarray:
        """The minimum over [first, last], neither empty."""
        level = np.log2(last - first + 1).astype(np.int64)
        out = np.empty(len(first), dtype=self.levels[0].dtype)
        for k in np.unique(level).tolist():
            at = level == k
            out[at] = np.minimum(self.levels[k][first[at]], self.levels[k][last[at] + 1 - (1 << k)])
        return out


def classes(extension: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The sets of two or more sorted suffixes that agree further than with any other.

    Returns for each its first and last member, how far its members agree, and
    how far they agree with the next larger set (-1 if there is none).
    """
    values = extension.tolist() + [-1]
    found: list[tuple[int, int, int, int]] = []
    open_: list[tuple[int, int]] = []  # (first member, agreement), agreements ascending
    for i, v in enumerate(values):
        first = i - 1
        while open_ and open_[-1][1] > v:
            first, agreed = open_.pop()
            outer = max(v, open_[-1][1] if open_ else -1)
            found.append((first, i - 1, agreed, outer))
        if v >= 0 and (not open_ or open_[-1][1] < v):
            open_.append((first, v))
    return tuple(np.array(c, dtype=np.int64) for c in zip(*found, strict=True)) if found else (np.empty(0, dtype=np.int64),) * 4

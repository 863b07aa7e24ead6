"""Matching ratios of many pairs of short texts at once, in whole numbers of numpy.

The letters of the first text of a pair are the bits of one 64-bit number, so it has at most
64 of them. Pairs stand side by side; a loop goes over the places of the second text.
"""

from __future__ import annotations

import numpy as np

#: Letters of a first text; from 200 letters on a second one has letters that the ratio leaves out.
MOST_FIRST, MOST_SECOND = 64, 199
_GROUPS = 64
_PAIRS = 16_384
_CELLS = 1 << 18
_ONE = np.uint64(1)


def _code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")


def _below(bits: np.ndarray) -> np.ndarray:
    """Numbers with the lowest `bits` bits set, up to all 64."""
    short = (_ONE << np.minimum(bits, 63).astype(np.uint64)) - _ONE
    return np.where(bits >= 64, ~np.uint64(0), short)


def _counts(points: list[np.ndarray]) -> np.ndarray:
    """Letters by group, a row per group."""
    rows = [np.bincount(p % _GROUPS, minlength=_GROUPS) for p in points]
    return np.array(rows, dtype=np.uint8).reshape(-1, _GROUPS).T.copy()


class Pairs:
    """All pairs of `firsts` (of at most MOST_FIRST letters) and `seconds` (of at most MOST_SECOND)."""

    def __init__(self, firsts: list[str], seconds: list[str]):
        a, b = [_code_points(t) for t in firsts], [_code_points(t) for t in seconds]
        self.long_a = np.array([len(p) for p in a], dtype=np.int64)
        self.long_b = np.array([len(p) for p in b], dtype=np.int64)
        self.counts_a, self.counts_b = _counts(a), _counts(b)
        letters = np.unique(np.concatenate([np.empty(0, "<u4"), *a]))
        # Letters that no first text has share the last number, whose bits are never set.
        self.bits = np.zeros((len(a), len(letters) + 1), dtype=np.uint64)
        for row, points in enumerate(a):
            places = _ONE << np.arange(len(points), dtype=np.uint64)
            np.bitwise_or.at(self.bits[row], np.searchsorted(letters, points), places)
        self.codes = np.full((int(self.long_b.max(initial=0)), len(b)), len(letters), dtype=np.int32)
        for row, points in enumerate(b):
            at = np.minimum(np.searchsorted(letters, points), max(len(letters) - 1, 0))
            known = letters[at] == points if len(letters) else np.zeros(len(points), dtype=bool)
            self.codes[: len(points), row] = np.where(known, at, len(letters))

    def reaching(self, floors: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Pairs whose upper bound is no less than the floor of the first text: places and bounds.

        The bound is that of the letters both texts hold, then that of their longest common
        subsequence: the matching blocks of a ratio are one.
        """
        found = [(np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0))]
        step = max(1, _CELLS // max(len(self.long_b), 1))
        for begin in range(0, len(self.long_a), step):
            rows = slice(begin, begin + step)
            shared = np.zeros((len(self.long_a[rows]), len(self.long_b)), dtype=np.uint8)
            for own, other in zip(self.counts_a, self.counts_b):
                shared += np.minimum(own[rows, None], other[None, :])
            total = self.long_a[rows, None] + self.long_b[None, :]
            first, second = np.nonzero(2.0 * shared >= floors[rows, None] * total * (1 - 1e-12))
            for at in range(0, len(first), _PAIRS):
                x, y = first[at : at + _PAIRS] + begin, second[at : at + _PAIRS]
                bound = 2.0 * self._common(x, y) / (self.long_a[x] + self.long_b[y])
                good = bound >= floors[x]
                found.append((x[good], y[good], bound[good]))
        return tuple(np.concatenate(part) for part in zip(*found))

    def _common(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Lengths of the longest common subsequences, one bit per letter of the first text."""
        full = _below(self.long_a[x])
        rest = full.copy()
        for place in range(int(self.long_b[y].max(initial=0))):
            hit = self.bits[x, self.codes[place, y]] & rest
            rest = ((rest + hit) | (rest - hit)) & full
        return self.long_a[x] - np.bitwise_count(rest)

    def ratios(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """`SequenceMatcher(None, first, second).ratio()` of the pairs."""
        parts = [np.empty(0)]
        for at in range(0, len(x), _PAIRS // 4):
            some = x[at : at + _PAIRS // 4], y[at : at + _PAIRS // 4]
            total = self.long_a[some[0]] + self.long_b[some[1]]
            matched = 2.0 * self._matched(*some)
            parts.append(np.divide(matched, total, out=np.ones(len(total)), where=total > 0))
        return np.concatenate(parts)

    def _matched(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Letters in matching blocks: of each stretch the longest block, then the same left and right of it."""
        places = np.arange(int(self.long_b[y].max(initial=0)))[:, None]
        hits = self.bits[x[None, :], self.codes[: len(places), y]]
        total = np.zeros(len(x), dtype=np.int64)
        pair, own = np.arange(len(x)), _below(self.long_a[x])
        low, high = np.zeros(len(x), dtype=np.int64), self.long_b[y]
        while len(pair):
            inside = (places >= low) & (places < high)
            size, i, j = _longest(np.where(inside, hits[:, pair] & own, np.uint64(0)))
            np.add.at(total, pair, size)
            left, right = own & _below(i), own & ~_below(i + size)
            pair, own = np.concatenate([pair, pair]), np.concatenate([left, right])
            low, high = np.concatenate([low, j + size]), np.concatenate([j, high])
            more = (np.concatenate([size, size]) > 0) & (own != 0) & (low < high)
            pair, own, low, high = pair[more], own[more], low[more], high[more]
        return total


def _longest(hits: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Length and places of the longest common block, of equal ones the first in the first text.

    `hits` has a row per place of the second text and a column per pair; the bits are the
    places of the first text that hold the same letter. A bit in `ends` is the end of a block.
    """
    size, i, j = (np.zeros(hits.shape[1], dtype=np.int64) for _ in range(3))
    active, ends, length = np.arange(hits.shape[1]), hits, 0
    while len(active):
        any_end = np.bitwise_or.reduce(ends, axis=0)
        on = any_end != 0
        active, ends, hits, any_end = active[on], ends[:, on], hits[:, on], any_end[on]
        if not len(active):
            break
        length += 1
        lowest = any_end & (~any_end + _ONE)
        size[active] = length
        i[active] = np.bitwise_count(lowest - _ONE).astype(np.int64) - length + 1
        j[active] = ((ends & lowest) != 0).argmax(axis=0) - length + 1
        longer = np.zeros_like(ends)
        longer[1:] = (ends[:-1] << _ONE) & hits[1:]
        ends = longer
    return size, i, j

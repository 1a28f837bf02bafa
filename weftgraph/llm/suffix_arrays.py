"""Suffix arrays in numpy: Larsson-Sadakane refinement, Kasai's common prefixes, search by binary search."""

from __future__ import annotations

import numpy as np

from .blocks import runs

#: Symbols of 9 bits (a byte plus 1, or 0 between strings) in one packed key.
STEP = 7
LANE = 512  # places that one lane of the common-prefix pass walks


class SuffixArray:
    """Of several byte strings, set one after the other with a 0 symbol after each."""

    def __init__(self, strings: list[bytes]):
        size = np.array([len(s) for s in strings], np.int64)
        self.begin = np.cumsum(size + 1) - size - 1
        text = np.zeros(int(size.sum()) + len(strings) + STEP, np.uint64)
        joined = np.frombuffer(b"".join(strings), np.uint8)
        self.where = np.arange(len(joined)) + np.repeat(np.arange(len(strings)), size)
        text[self.where] = joined.astype(np.uint64) + np.uint64(1)
        self.n = len(text) - STEP
        self.size = size
        key = np.zeros(self.n, np.uint64)
        for k in range(STEP):
            key = key << np.uint64(9) | text[k : k + self.n]
        self.key = key.view(np.int64)
        self.symbol = text.astype(np.int16)[: self.n]
        self.array, self.rank = self._sorted()

    def _sorted(self) -> tuple[np.ndarray, np.ndarray]:
        """Sort by STEP symbols; then only groups still together are refined, by the ranks twice as far each time."""
        n = self.n
        array = np.argsort(self.key, kind="stable")
        first = runs(self.key[array])
        rank = np.empty(n, np.int64)
        width = np.diff(np.r_[first, n])
        rank[array] = np.repeat(first, width)
        open_ = np.flatnonzero(np.repeat(width > 1, width))  # places of the array in groups of two or more
        step = STEP
        while len(open_):
            own = array[open_]
            ahead = own + step
            beyond = np.where(ahead < n, rank[np.minimum(ahead, n - 1)] + 1, 0)
            pair = rank[own] * (n + 1) + beyond
            order = np.argsort(pair, kind="stable")
            own, pair = own[order], pair[order]
            array[open_] = own
            first = runs(pair)
            width = np.diff(np.r_[first, len(pair)])
            rank[own] = np.repeat(open_[first], width)
            open_ = open_[np.repeat(width > 1, width)]
            step *= 2
        return array, rank

    def extended(self, a: np.ndarray, other: SuffixArray, b: np.ndarray, have: np.ndarray, cap: int) -> np.ndarray:
        """Common prefixes, up to about ``cap``, of places a here and b there that have ``have`` symbols in common."""
        out = have.copy()
        live = np.arange(len(a))
        for step, mine, theirs in ((STEP, self.key, other.key), (1, self.symbol, other.symbol)):
            todo = live
            while len(todo):
                x, y = a[todo] + out[todo], b[todo] + out[todo]
                inside = (x < self.n) & (y < other.n) & (out[todo] < cap)
                todo, x, y = todo[inside], x[inside], y[inside]
                todo = todo[mine[x] == theirs[y]]
                out[todo] += step
        return out

    def common_prefixes(self, cap: int) -> np.ndarray:
        """Kasai: for each place of the array, what it shares with the one before, up to about ``cap``.

        From one text place to the next that falls by one at most.  Lanes of the
        text are walked side by side.
        """
        out = np.zeros(self.n + 1, np.int64)
        lane = np.arange(0, self.n, LANE)
        have = np.zeros(len(lane), np.int64)
        for step in range(min(LANE, self.n)):
            at = lane + step
            if at[-1] >= self.n:
                at, have, lane = at[:-1], have[:-1], lane[:-1]
            r = self.rank[at]
            have = np.where(r > 0, np.maximum(have - 1, 0), 0)
            sub = np.flatnonzero(r > 0)
            have[sub] = self.extended(at[sub], self, self.array[r[sub] - 1], have[sub], cap)
            out[r] = have
        return out[: self.n]

    def starts(self, width: int) -> np.ndarray:
        """Places where ``width`` symbols of one string begin, string by string."""
        count = np.maximum(self.size - width + 1, 0)
        return np.arange(count.sum()) + np.repeat(self.begin - (np.cumsum(count) - count), count)

    def repeated(self, width: int) -> np.ndarray:
        """For each of ``starts(width)``: do its ``width`` symbols begin anywhere else?"""
        at = self.starts(width)
        same = self.common_prefixes(width) >= width
        return same[self.rank[at]] | np.r_[same[1:], False][self.rank[at]]

    def found_in(self, other: SuffixArray, width: int) -> np.ndarray:
        """For each of ``starts(width)``: do its symbols begin anywhere in the other? By binary search in its array.

        What the window shares with the places just outside the bounds it shares
        with all between, so that each comparison begins there.
        """
        at = self.starts(width)
        low, high = np.zeros(len(at), np.int64), np.full(len(at), other.n)
        below, above = np.zeros(len(at), np.int64), np.zeros(len(at), np.int64)
        live = np.arange(len(at)) if other.n else np.zeros(0, np.int64)
        while len(live):
            middle = (low[live] + high[live]) // 2
            there = other.array[middle]
            same = self.extended(at[live], other, there, np.minimum(below[live], above[live]), width)
            x, y = np.minimum(at[live] + same, self.n - 1), np.minimum(there + same, other.n - 1)
            less = (same < width) & ((there + same >= other.n) | (other.symbol[y] < self.symbol[x]))
            low[live[less]], below[live[less]] = middle[less] + 1, same[less]
            high[live[~less]], above[live[~less]] = middle[~less], same[~less]
            live = live[(low[live] < high[live]) & (above[live] < width)]  # a whole match ends the search
        return above >= width

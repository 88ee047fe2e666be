"""A full-text index over a sequence of word numbers: suffix order, wavelet ranks, sampled places."""

from __future__ import annotations

import numpy as np

#: Every so many places of a run of words is kept; others are found by walking back to one.
SAMPLE = 8


class FMIndex:
    """Index of a sequence of symbols, in which every 0 is a separator that nothing crosses.

    ``words`` are non-negative; the sequence is closed by a separator of its own. Suffixes are
    sorted to the end of their run (separators differ from each other by place), so that walking
    back one place from a suffix is exact.
    """

    def __init__(self, words: np.ndarray):
        text = np.append(words, 0).astype(np.int64)
        self.n = len(text)
        self.top = int(text.max())
        breaks = text == 0
        order = self._suffix_order(text, breaks)
        before = text[order - 1]  # of place 0: the closing separator
        self.first = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=self.top + 1))])
        # Place within the run, for the sample; every run's first place is in it.
        place = np.arange(self.n) - np.maximum.accumulate(np.where(np.r_[True, breaks[:-1]], np.arange(self.n), 0))
        self.sampled = (place % SAMPLE == 0)[order]
        self.places = order[self.sampled]
        self.sample_rank = np.cumsum(self.sampled) - 1
        self._wavelet(before)
        self.before = before

    @staticmethod
    def _suffix_order(text: np.ndarray, breaks: np.ndarray) -> np.ndarray:
        """Places in the order of their suffixes, by prefix doubling."""
        n = len(text)
        rank = np.where(breaks, np.cumsum(breaks) - 1, text + int(breaks.sum()))
        span = 1
        while True:
            follow = np.zeros(n, np.int64)
            follow[: n - span] = rank[span:] + 1
            follow[breaks] = 0
            key = rank * (int(rank.max()) + 2) + follow
            order = np.argsort(key, kind="stable")
            new = np.r_[False, key[order][1:] != key[order][:-1]].cumsum()
            rank = np.empty(n, np.int64)
            rank[order] = new
            if new[-1] == n - 1:
                return order
            span *= 2

    def _wavelet(self, symbols: np.ndarray) -> None:
        """One level per bit, highest first: how many ones stand before each place, and how many
        zeros the level has. Symbols go on to the next level zeros first, otherwise in order."""
        self.levels = []
        for bit in range(max(1, self.top.bit_length()) - 1, -1, -1):
            ones = (symbols >> bit & 1).astype(bool)
            before = np.zeros(self.n + 1, np.int32)
            np.cumsum(ones, out=before[1:])
            self.levels.append((bit, before, self.n - int(before[-1])))
            symbols = np.concatenate([symbols[~ones], symbols[ones]])

    def rank(self, symbol: np.ndarray, place: np.ndarray) -> np.ndarray:
        """How often each symbol stands before each place of the transformed sequence."""
        low, high = np.zeros_like(place), place
        for bit, before, zeros in self.levels:
            one = (symbol >> bit & 1).astype(bool)
            low_ones, high_ones = before[low], before[high]
            low = np.where(one, zeros + low_ones, low - low_ones)
            high = np.where(one, zeros + high_ones, high - high_ones)
        return high - low

    def search(self, phrases: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows ``[low, high)`` of the suffixes each phrase begins; phrases are right-aligned rows."""
        low = np.zeros(len(phrases), np.int64)
        high = np.full(len(phrases), self.n, np.int64)
        known = np.where(phrases <= self.top, phrases, 0)
        width = phrases.shape[1]
        for step in range(width):
            at = np.flatnonzero((lengths > step) & (high > low))
            symbol = known[at, width - 1 - step]
            new = self.first[symbol]
            low[at], high[at] = new + self.rank(symbol, low[at]), new + self.rank(symbol, high[at])
            high[at[symbol == 0]] = 0
        return low, np.maximum(low, high)

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """The places at which the suffixes of these rows begin."""
        rows, steps = rows.copy(), np.zeros(len(rows), np.int64)
        walking = np.flatnonzero(~self.sampled[rows])
        while len(walking):
            symbol = self.before[rows[walking]]
            rows[walking] = self.first[symbol] + self.rank(symbol, rows[walking])
            steps[walking] += 1
            walking = walking[~self.sampled[rows[walking]]]
        return self.places[self.sample_rank[rows]] + steps

"""A compressed full-text index of short runs of symbols, as numpy arrays; searches advance many patterns at once.

The runs stand one after another, each with an end mark of its own that sorts by the run's place. The Burrows-Wheeler
transform is kept as a wavelet matrix: one bit vector for each bit of the symbols, with counts every 64 bits.
"""

from __future__ import annotations

from functools import cached_property

import numpy as np

#: Powers of two whose orders are kept; common prefixes are known up to the sum of these.
STEPS = (1, 2, 4, 8, 16)
DEEPEST = sum(STEPS)
#: For each place in a word, the bits before it.
BELOW = (np.uint64(1) << np.arange(64, dtype=np.uint64)) - np.uint64(1)


class Wavelet:
    """rank() of symbols in a sequence."""

    def __init__(self, sequence: np.ndarray, symbols: int) -> None:
        self.levels = range(max(int(symbols - 1).bit_length(), 1) - 1, -1, -1)
        self.words, self.counts, self.zeros = [], [], []
        for level in self.levels:
            bit = ((sequence >> level) & 1).astype(np.uint8)
            packed = np.packbits(np.concatenate((bit, np.zeros(64 + -len(bit) % 64, np.uint8))), bitorder="little").view("<u8")
            self.words.append(packed)
            self.counts.append(np.concatenate(([0], np.cumsum(np.bitwise_count(packed), dtype=np.int32)))[:-1].astype(np.int32))
            self.zeros.append(len(bit) - int(bit.sum()))
            sequence = np.concatenate((sequence[bit == 0], sequence[bit == 1]))
        self.begin = self._walk(np.arange(symbols, dtype=np.int32), np.zeros(symbols, np.int32))

    def _walk(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        for level, words, counts, zeros in zip(self.levels, self.words, self.counts, self.zeros, strict=True):
            spot = at >> 6
            ones = counts.take(spot) + np.bitwise_count(words.take(spot) & BELOW.take(at & 63))
            at = np.where((symbol & (1 << level)) > 0, zeros + ones, at - ones)
        return at

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often each symbol stands before each place."""
        return self._walk(symbol, at) - self.begin[symbol]


def _ranks(key: np.ndarray) -> tuple[np.ndarray, np.ndarray, bool]:
    order = np.argsort(key)
    new = np.concatenate(([0], np.cumsum(key[order][1:] != key[order][:-1])))
    rank = np.empty(len(key), np.int64)
    rank[order] = new
    return rank, order, int(new[-1]) == len(key) - 1


class FMIndex:
    """runs: symbols from 1 on, ``sizes`` of them in each run, one run after another in ``flat``."""

    def __init__(self, flat: np.ndarray, sizes: np.ndarray, symbols: int) -> None:
        self.begin = np.concatenate(([0], np.cumsum(sizes + 1)[:-1]))
        self.length = n = len(flat) + len(sizes)
        text = np.zeros(n, np.int64)
        ends = self.begin + sizes
        inside = np.ones(n, bool)
        inside[ends] = False
        text[inside] = flat
        rank = text + len(sizes)
        rank[ends] = np.arange(len(sizes))
        self._orders = {1: rank}
        step, done, top = 1, False, symbols + len(sizes) + 2
        while not done or step < STEPS[-1]:
            after = np.zeros(n, np.int64)
            after[: max(n - step, 0)] = rank[step:] + 1
            rank, order, done = _ranks(rank * max(top, n + 1) + after)
            step *= 2
            if step in STEPS:
                self._orders[step] = rank
        self.suffixes = order
        self.wavelet = Wavelet(text[order - 1], symbols + 1)
        self.smaller = np.concatenate(([0], np.cumsum(np.bincount(text, minlength=symbols + 1))))
        self._groups: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    @cached_property
    def common(self) -> np.ndarray:
        """Symbols that each suffix shares with the one before it in order, up to DEEPEST."""
        shared = np.zeros(self.length, np.int64)
        one, two = self.suffixes[1:], self.suffixes[:-1]
        for step in reversed(STEPS):
            rank, have = self._orders[step], shared[1:]
            a, b = one + have, two + have
            inside = np.maximum(a, b) < self.length
            a, b = np.where(inside, a, 0), np.where(inside, b, 0)
            shared[1:] = have + np.where(inside & (rank[a] == rank[b]), step, 0)
        return shared

    def groups(self, depth: int) -> tuple[np.ndarray, np.ndarray]:
        """Places in the order where a new prefix of ``depth`` symbols begins, with the end; and each place's prefix."""
        if depth not in self._groups:
            new = self.common < depth
            self._groups[depth] = np.append(np.flatnonzero(new), self.length), np.cumsum(new, dtype=np.int32) - 1
        return self._groups[depth]

    def widened(self, low: np.ndarray, high: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
        """The intervals of the first ``depth`` symbols of what [low, high) stands for."""
        begins, number = self.groups(depth)
        return begins[number[low]], begins[number[high - 1] + 1]

    def _extended(self, symbol: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        twice = np.concatenate((symbol, symbol)).astype(np.int32)
        both = self.wavelet.rank(twice, np.concatenate((low, high)).astype(np.int32)) + self.smaller[twice]
        return both[: len(low)], both[len(low) :]

    def matching_statistics(self, flat: np.ndarray, sizes: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
        """(length, low) for each place of the patterns: how many symbols from there on occur somewhere in the runs, up to
        ``most`` (DEEPEST or less), and the begin of their interval. A symbol of 0 occurs nowhere.

        A pattern is read from its end. Where its next symbol can't be put before the match, the match loses symbols at its
        end, down to the next length at which its interval grows.
        """
        length, begins = np.zeros(len(flat), np.int64), np.zeros(len(flat), np.int64)
        by = np.argsort(-sizes, kind="stable")
        ends = np.cumsum(sizes)[by]
        low, high, have = np.zeros(len(by), np.int64), np.full(len(by), self.length), np.zeros(len(by), np.int64)
        for step in range(int(sizes.max(initial=0))):
            live = int(np.searchsorted(-sizes[by], -step, "left"))
            place = ends[:live] - 1 - step
            open_ = np.arange(live)
            while len(open_):
                symbol = flat[place[open_]]
                a, b = self._extended(symbol, low[open_], high[open_])
                fits = (a < b) & (symbol > 0)
                on = open_[fits]
                low[on], high[on], have[on] = a[fits], b[fits], have[on] + 1
                open_ = open_[~fits]
                if not len(open_):
                    break
                none = open_[(have[open_] == 0) | (flat[place[open_]] == 0)]
                low[none], high[none], have[none] = 0, self.length, 0
                open_ = np.setdiff1d(open_, none, assume_unique=True)
                edge = np.append(self.common, 0)
                shorter = np.maximum(edge[low[open_]], edge[high[open_]]) if len(open_) else have[:0]
                for depth in np.unique(shorter).tolist():
                    at = open_[shorter == depth]
                    have[at] = depth
                    low[at], high[at] = self.widened(low[at], high[at], depth) if depth else (0, self.length)
            over = np.flatnonzero(have[:live] > most)
            if len(over):
                low[over], high[over] = self.widened(low[over], high[over], most)
                have[over] = most
            length[place], begins[place] = have[:live], low[:live]
        return length, begins

    def earliest(self, low: np.ndarray, depth: int) -> np.ndarray:
        """The first place in the text of the prefix of ``depth`` symbols whose interval begins at ``low``."""
        begins, number = self.groups(depth)
        return np.minimum.reduceat(self.suffixes, begins[:-1])[number[low]]

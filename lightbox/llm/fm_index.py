"""FM-index over a sequence of word numbers: wavelet matrix ranks, backward search, sampled positions."""

from __future__ import annotations

import numpy as np


def suffix_order(symbols: np.ndarray) -> np.ndarray:
    """Start positions of the suffixes in sorted order, by prefix doubling.

    Symbol 0 ends a stretch. Every 0 counts as smaller than all words and
    different from the other zeros, so no comparison runs past a stretch.
    """
    n = len(symbols)
    if n == 0:
        return np.empty(0, np.int64)
    zeros = symbols == 0
    n_zeros = int(zeros.sum())
    rank = np.where(zeros, np.cumsum(zeros) - 1, symbols.astype(np.int64) + n_zeros - 1)
    span = 1
    while True:
        after = np.full(n, -1, np.int64)
        after[:-span or None] = rank[span:] if span < n else after[:0]
        key = rank * (max(n, int(rank.max())) + 2) + after + 1
        order = np.argsort(key, kind="stable")
        sorted_key = key[order]
        rank = np.empty(n, np.int64)
        rank[order] = np.concatenate([[0], np.cumsum(sorted_key[1:] != sorted_key[:-1])])
        if rank[order[-1]] == n - 1:
            return order
        span *= 2
        if span >= n:
            return order


class WaveletMatrix:
    """Rank of any symbol up to any position, for many queries at once."""

    def __init__(self, values: np.ndarray, alphabet: int):
        self.levels = max(1, int(alphabet - 1).bit_length())
        self.ones: list[np.ndarray] = []
        self.zeros: list[int] = []
        current = values
        for level in range(self.levels - 1, -1, -1):
            bit = (current >> level) & 1
            self.ones.append(np.concatenate([[0], np.cumsum(bit)]).astype(np.int32))
            self.zeros.append(int(len(bit) - bit.sum()))
            current = np.concatenate([current[bit == 0], current[bit == 1]])

    def rank(self, symbol: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Occurrences of ``symbol`` before position ``end``."""
        low = np.zeros_like(end)
        for step, (ones, zeros) in enumerate(zip(self.ones, self.zeros)):
            bit = (symbol >> (self.levels - 1 - step)) & 1 == 1
            low_ones, end_ones = ones[low], ones[end]
            low = np.where(bit, zeros + low_ones, low - low_ones)
            end = np.where(bit, zeros + end_ones, end - end_ones)
        return end - low


class FMIndex:
    """Index of stretches of words (numbers from 1) that each end with 0."""

    def __init__(self, symbols: np.ndarray, alphabet: int, sample: int = 16):
        order = suffix_order(symbols)
        before = order - 1
        self.bwt = np.where(order > 0, symbols[before], 0)
        self.first = np.concatenate([[0], np.cumsum(np.bincount(symbols, minlength=alphabet))])
        self.matrix = WaveletMatrix(self.bwt, alphabet)
        # A stretch's first word is always sampled, so no walk crosses a 0.
        opens = np.concatenate([[True], symbols[:-1] == 0])
        place = np.arange(len(symbols))
        origin = np.maximum.accumulate(np.where(opens, place, 0))
        kept = ((place - origin) % sample == 0)[order]
        self.sampled = np.where(kept, order, -1)

    def search(self, patterns: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Row ranges [begin, end) of the patterns (rows of ``patterns``, left-aligned)."""
        begin = np.zeros(len(patterns), np.int64)
        end = np.full(len(patterns), len(self.bwt), np.int64)
        for back in range(int(lengths.max(initial=0))):
            live = np.flatnonzero((back < lengths) & (begin < end))
            if not len(live):
                break
            symbol = patterns[live, lengths[live] - 1 - back]
            begin[live] = self.first[symbol] + self.matrix.rank(symbol, begin[live])
            end[live] = self.first[symbol] + self.matrix.rank(symbol, end[live])
        return begin, np.maximum(begin, end)

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of index rows, by walking back to a sampled position."""
        found = self.sampled[rows]
        steps = 0
        while True:
            open_ = np.flatnonzero(found < 0)
            if not len(open_):
                return found
            if steps == 0:
                here = rows.copy()
            steps += 1
            symbol = self.bwt[here[open_]]
            here[open_] = self.first[symbol] + self.matrix.rank(symbol, here[open_])
            hit = self.sampled[here[open_]]
            found[open_] = np.where(hit >= 0, hit + steps, -1)

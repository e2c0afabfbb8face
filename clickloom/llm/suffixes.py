"""Suffix arrays over word numbers, and searching many suffixes in one of them at once."""

from __future__ import annotations

import numpy as np


def suffix_array(words: np.ndarray) -> np.ndarray:
    """Start positions in the order of their suffixes, by prefix doubling."""
    size = len(words)
    if not size:
        return np.zeros(0, dtype=np.int64)
    rank = np.unique(words, return_inverse=True)[1].astype(np.int64)
    width, kinds = 1, int(rank.max()) + 1
    while kinds < size and width < size:
        after = np.zeros(size, dtype=np.int64)
        after[:-width] = rank[width:] + 1
        rank = np.unique(rank * (size + 1) + after, return_inverse=True)[1].astype(np.int64)
        kinds, width = int(rank.max()) + 1, width * 2
    return np.argsort(rank, kind="stable")


class Shard:
    """Word numbers above zero, with a zero after each run, and their suffix array."""

    def __init__(self, words: np.ndarray):
        self.words = np.append(words, 0).astype(np.int64)
        self.order = suffix_array(self.words)

    def narrow(self, lo: np.ndarray, hi: np.ndarray, depth: int, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of the suffixes lo to hi, which agree in ``depth`` words, those whose next word is ``word``."""
        return self._bound(lo, hi, depth, word), self._bound(lo, hi, depth, word + 1)

    def _bound(self, lo, hi, depth, word):
        lo, hi, last = lo.copy(), hi.copy(), len(self.words) - 1
        while True:
            open_ = lo < hi
            if not open_.any():
                return lo
            mid = (lo + hi) >> 1
            at = np.minimum(self.order[np.minimum(mid, last)] + depth, last)
            less = self.words[at] < word
            lo = np.where(open_ & less, mid + 1, lo)
            hi = np.where(open_ & ~less, mid, hi)


def expand(lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, position) for each position from lo to hi of each row."""
    n = hi - lo
    row = np.repeat(np.arange(len(lo)), n)
    return row, np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n) + lo[row]

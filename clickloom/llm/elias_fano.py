"""Elias-Fano sequences and an n-gram trie of two levels made of them.

A non-decreasing sequence of n numbers below u keeps the low bits of each number packed and the high bits as
a bit vector of n ones and a zero after each bucket. All operations take whole arrays. The buffers of a trie
lie in one anonymous memory map.
"""

from __future__ import annotations

import mmap

import numpy as np

U64 = np.uint64
ONE = U64(1)


def _pack_bits(values: np.ndarray, width: int) -> np.ndarray:
    words = np.zeros((len(values) * width + 63) // 64 + 1, dtype=U64)
    at = np.arange(len(values), dtype=U64) * U64(width)
    word, bit = (at >> U64(6)).astype(np.int64), at & U64(63)
    np.bitwise_or.at(words, word, values << bit)
    over = bit + U64(width) > U64(64)
    np.bitwise_or.at(words, word[over] + 1, values[over] >> (U64(64) - bit[over]))
    return words


def _select_in_word(words: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """Place of the set bit number ``rank`` (from 0) of each word."""
    place, words, rank = np.zeros(len(words), dtype=np.int64), words.copy(), rank.astype(np.int64)
    for width in (32, 16, 8, 4, 2, 1):
        below = np.bitwise_count(words & U64((1 << width) - 1)).astype(np.int64)
        over = rank >= below
        rank -= np.where(over, below, 0)
        place += np.where(over, width, 0)
        words = np.where(over, words >> U64(width), words)
    return place


class EliasFano:
    """A non-decreasing sequence of unsigned 64-bit numbers, at most ``top``."""

    def __init__(self, values: np.ndarray, top: int):
        n = len(values)
        self.size = n
        self.width = max(0, ((top + 1) // max(n, 1)).bit_length() - 1)
        self.mask = U64((1 << self.width) - 1)
        self.low = _pack_bits(values & self.mask, self.width) if self.width else np.zeros(1, U64)
        high = (values >> U64(self.width)).astype(np.int64)
        self.buckets = (top >> self.width) + 1
        at = high + np.arange(n)
        bits = np.zeros((n + self.buckets) // 64 + 1, dtype=U64)
        np.bitwise_or.at(bits, at >> 6, ONE << (at & 63).astype(U64))
        self.bits = bits
        ones = np.cumsum(np.bitwise_count(bits).astype(np.int64))
        self.ones = np.concatenate(([0], ones))
        self.zeros = 64 * np.arange(len(bits) + 1) - self.ones

    def buffers(self) -> list[str]:
        return ["low", "bits", "ones", "zeros"]

    def _low(self, at: np.ndarray) -> np.ndarray:
        if not self.width:
            return np.zeros(len(at), dtype=U64)
        place = at * self.width
        word, bit = place >> 6, (place & 63).astype(U64)
        over = np.where(bit > 0, self.low[np.minimum(word + 1, len(self.low) - 1)] << ((U64(64) - bit) & U64(63)), U64(0))
        return ((self.low[word] >> bit) | over) & self.mask

    def access(self, at: np.ndarray) -> np.ndarray:
        """The numbers at these places."""
        word = np.searchsorted(self.ones, at, "right") - 1
        place = 64 * word + _select_in_word(self.bits[word], at - self.ones[word])
        return ((place - at).astype(U64) << U64(self.width)) | self._low(at)

    def _bucket(self, bucket: np.ndarray) -> np.ndarray:
        """How many numbers lie in buckets before this one."""
        at = np.maximum(bucket - 1, 0)
        word = np.searchsorted(self.zeros, at, "right") - 1
        place = 64 * word + _select_in_word(~self.bits[word], at - self.zeros[word])
        return np.where(bucket > 0, place - at, 0)

    def find(self, values: np.ndarray, first: np.ndarray | None = None, last: np.ndarray | None = None) -> np.ndarray:
        """A place of each number, -1 where it is absent; with bounds, only from ``first`` to before ``last``."""
        if not self.size or not len(values):
            return np.full(len(values), -1, dtype=np.int64)
        bucket = (values >> U64(self.width)).astype(np.int64)
        lo, end = self._bucket(bucket), self._bucket(bucket + 1)
        if first is not None:
            lo, end = np.maximum(lo, first), np.minimum(end, last)
        wanted, hi = values & self.mask, end.copy()
        left = np.flatnonzero(lo < hi)
        while len(left):
            mid = (lo[left] + hi[left]) >> 1
            less = self._low(mid) < wanted[left]
            lo[left] = np.where(less, mid + 1, lo[left])
            hi[left] = np.where(less, hi[left], mid)
            left = left[lo[left] < hi[left]]
        hit = lo < end
        hit[hit] = self._low(lo[hit]) == wanted[hit]
        return np.where(hit, lo, -1)


# A successor is known by 40 bits of its hash within its context.
SUCCESSOR_BITS = 40
# Steps of a probability's quantised logarithm to a power of ten; code 0 is an absent n-gram.
STEPS = 28


def quantised(probability: np.ndarray) -> np.ndarray:
    return np.clip(1 + np.rint(-np.log10(probability) * STEPS), 1, 255).astype(np.uint8)


def restored(code: np.ndarray) -> np.ndarray:
    """The probability of each code, 0 of code 0."""
    table = np.concatenate(([0.0], 10.0 ** (-np.arange(255) / STEPS)))
    return table[code]


class NgramTrie:
    """Contexts, monotone pointers to their successors, and a quantised probability for each successor."""

    def __init__(self, contexts: np.ndarray, counts: np.ndarray, pointers: np.ndarray, successors: np.ndarray, probability: np.ndarray):
        """Sorted context hashes with counts; successors of context i, sorted, from pointer i to pointer i + 1."""
        context = np.repeat(np.arange(len(contexts), dtype=U64), np.diff(pointers))
        self.contexts = EliasFano(contexts, (1 << 64) - 1)
        self.pointers = EliasFano(pointers.astype(U64), int(pointers[-1]))
        self.successors = EliasFano((context << U64(SUCCESSOR_BITS)) | successors, (max(len(contexts), 1) << SUCCESSOR_BITS) - 1)
        self.counts, self.codes = counts, quantised(probability)
        self._into_one_map()

    def _into_one_map(self) -> None:
        parts = [(level, name) for level in (self.contexts, self.pointers, self.successors) for name in level.buffers()]
        parts += [(self, "counts"), (self, "codes")]
        sizes = [-(-getattr(o, n).nbytes // 8) * 8 for o, n in parts]
        memory = mmap.mmap(-1, max(sum(sizes), 8))
        at = 0
        for (owner, name), size in zip(parts, sizes, strict=True):
            values = getattr(owner, name)
            view = np.frombuffer(memory, values.dtype, len(values), at)
            view[:] = values
            setattr(owner, name, view)
            at += size

    def context(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The number of each context, -1 if absent, and its count."""
        at = self.contexts.find(hashes)
        return at, np.where(at >= 0, self.counts[np.maximum(at, 0)], 0) if len(self.counts) else np.zeros(len(at), np.int64)

    def successor(self, context: np.ndarray, first: np.ndarray, last: np.ndarray, hashes: np.ndarray) -> np.ndarray:
        """Codes of successors, searched for between the pointers of their contexts; 0 where absent."""
        value = (np.maximum(context, 0).astype(U64) << U64(SUCCESSOR_BITS)) | hashes
        at = self.successors.find(value, first, np.where(context >= 0, last, first))
        return np.where(at >= 0, self.codes[np.maximum(at, 0)], 0).astype(np.uint8) if len(self.codes) else np.zeros(len(at), np.uint8)

    def ranges(self, context: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.maximum(context, 0)
        return self.pointers.access(at).astype(np.int64), self.pointers.access(at + 1).astype(np.int64)

"""An open-addressing table from 64-bit keys to positions, filled and read whole arrays at a time."""

from __future__ import annotations

import numpy as np

_MIX = np.uint64(0x9E3779B97F4A7C15)


class KeyTable:
    """Positions of distinct non-negative keys below 2^63; a load of a quarter keeps probes short."""

    def __init__(self, keys: np.ndarray):
        bits = max(4, int(4 * max(len(keys), 1) - 1).bit_length())
        self.shift, self.last = np.uint64(64 - bits), (1 << bits) - 1
        self.keys = np.full(1 << bits, -1, dtype=np.int64)
        self.at = np.full(1 << bits, -1, dtype=np.int32)
        left, slot = np.arange(len(keys)), self._slot(keys)
        while len(left):
            free = self.keys[slot] < 0
            takes, first = np.unique(slot[free], return_index=True)
            winners = left[free][first]
            self.keys[takes], self.at[takes] = keys[winners], winners
            lost = np.ones(len(left), dtype=bool)
            lost[np.flatnonzero(free)[first]] = False
            left, slot = left[lost], (slot[lost] + 1) & self.last

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return (keys.view(np.uint64) * _MIX >> self.shift).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The position of each key, -1 where it is absent."""
        slot = self._slot(keys)
        held, found = self.keys[slot], self.at[slot]
        left = np.flatnonzero((held != keys) & (held >= 0))
        while len(left):
            slot[left] = (slot[left] + 1) & self.last
            held = self.keys[slot[left]]
            found[left] = np.where(held == keys[left], self.at[slot[left]], -1)
            left = left[(held != keys[left]) & (held >= 0)]
        found[self.keys[slot] != keys] = -1
        return found

"""Vantage-point trees over 64-bit codes under the Hamming distance.

A node holds a vantage point and a radius: codes within the radius go inside, the others outside. By the
triangle inequality a partner within ``reach`` of a code at distance d from the vantage point lies at a
distance from d - reach to d + reach, so a code visits a side only if that range overlaps it.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np

# Seconds that a compared pair and a row sent to another shard take, roughly; only the shape depends on them.
PAIR_COST, ROW_COST = 1e-9, 2e-6
CANDIDATES, LEAST_SAMPLE = 6, 64
BRUTE_PAIRS, CHUNK_PAIRS = 1 << 18, 1 << 17


def distance(a, b) -> np.ndarray:
    return np.bitwise_count(np.bitwise_xor(a, b))


@dataclass
class VantageTree:
    """Children from 0 on are nodes, those below are shards (-1 is shard 0)."""

    reach: int
    nodes: list[tuple[int, int, int, int]] = field(default_factory=list)  # vantage point, radius, inside, outside
    shards: int = 0
    root: int = -1

    @classmethod
    def build(cls, sample: np.ndarray, total: int, reach: int, seed: int = 7) -> VantageTree:
        """Split as long as the pairs that are saved outweigh the rows that visit a second side.

        ``sample`` stands for ``total`` codes. A dense group that no vantage point divides stays whole.
        """
        tree = cls(reach)
        tree.root = tree._grow(sample, sample[:0], total / max(len(sample), 1), np.random.default_rng(seed))
        return tree

    def _grow(self, homes: np.ndarray, visitors: np.ndarray, scale: float, rng) -> int:
        best = None
        if len(homes) >= 2 * LEAST_SAMPLE:
            stay = _cost(len(homes), len(visitors), scale)
            for vantage in rng.choice(homes, CANDIDATES):
                near, far = distance(homes, vantage), distance(visitors, vantage)
                for radius in np.unique(np.quantile(near, (0.35, 0.5, 0.65)).astype(int)):
                    inside = near <= radius
                    n = int(inside.sum())
                    if min(n, len(homes) - n) < LEAST_SAMPLE:
                        continue
                    in_too = int((far <= radius + self.reach).sum() + ((near <= radius + self.reach) & ~inside).sum())
                    out_too = int((far > radius - self.reach).sum() + ((near > radius - self.reach) & inside).sum())
                    cost = _cost(n, in_too, scale) + _cost(len(homes) - n, out_too, scale)
                    if cost < 0.98 * stay and (best is None or cost < best[0]):
                        best = cost, vantage, int(radius)
        if best is None:
            self.shards += 1
            return -self.shards
        _, vantage, radius = best
        near, far = distance(homes, vantage), distance(visitors, vantage)
        inside = near <= radius
        at = len(self.nodes)
        self.nodes.append((int(vantage), radius, 0, 0))
        into = np.concatenate((visitors[far <= radius + self.reach], homes[~inside & (near <= radius + self.reach)]))
        out = np.concatenate((visitors[far > radius - self.reach], homes[inside & (near > radius - self.reach)]))
        left = self._grow(homes[inside], into, scale, rng)
        right = self._grow(homes[~inside], out, scale, rng)
        self.nodes[at] = (int(vantage), radius, left, right)
        return at

    def place(self, codes: np.ndarray):
        """(row, shard, at home) for each code and each shard that may hold it or a partner of it.

        Of two shards that codes visit from either side only one compares them, in turn by their numbers.
        """
        home = np.zeros(len(codes), dtype=np.int64)
        found: list[tuple[int, np.ndarray]] = []
        stack = [(self.root, np.arange(len(codes)), np.ones(len(codes), dtype=bool))]
        while stack:
            at, rows, own = stack.pop()
            if not len(rows):
                continue
            if at < 0:
                shard = -at - 1
                home[rows[own]] = shard
                found.append((shard, rows))
                continue
            vantage, radius, left, right = self.nodes[at]
            d = distance(codes[rows], np.uint64(vantage)).astype(np.int64)
            into, out = d - self.reach <= radius, d + self.reach > radius
            stack.append((left, rows[into], own[into] & (d[into] <= radius)))
            stack.append((right, rows[out], own[out] & (d[out] > radius)))
        rows = np.concatenate([r for _, r in found]) if found else np.zeros(0, np.int64)
        shard = np.concatenate([np.full(len(r), s, np.int64) for s, r in found]) if found else np.zeros(0, np.int64)
        mine = home[rows]
        keep = (shard == mine) | ((mine < shard) == ((mine + shard) % 2 == 0))
        return rows[keep], shard[keep], (shard == mine)[keep]


def _cost(homes: int, visitors: int, scale: float) -> float:
    n, q = homes * scale, visitors * scale / 2  # half of the visits are made in the other direction
    return PAIR_COST * (n * n / 2 + n * q) + ROW_COST * (n + q)


class Forest:
    """Union-find over positions, joined many pairs at a time."""

    def __init__(self, size: int):
        self.parent = np.arange(size)

    def find(self, at: np.ndarray) -> np.ndarray:
        root = self.parent[at]
        while True:
            above = self.parent[root]
            if np.array_equal(above, root):
                return root
            root = above

    def join(self, a: np.ndarray, b: np.ndarray) -> None:
        while len(a):
            a, b = self.find(a), self.find(b)
            apart = a != b
            a, b = a[apart], b[apart]
            np.minimum.at(self.parent, np.maximum(a, b), np.minimum(a, b))


def join_near(forest: Forest, codes: np.ndarray, a: np.ndarray, b: np.ndarray, reach: int, depth: int = 4) -> None:
    """Join every position of ``a`` with every position of ``b`` whose codes differ in ``reach`` bits or less.

    A search with a vantage point at each level: only distances at most ``reach`` apart can be partners.
    """
    if not len(a) or not len(b):
        return
    if depth == 0 or len(a) * len(b) <= BRUTE_PAIRS:
        step = max(1, CHUNK_PAIRS // len(b))
        for i in range(0, len(a), step):
            x, y = np.nonzero(distance(codes[a[i : i + step], None], codes[None, b]) <= reach)
            forest.join(a[i + x], b[y])
        return
    vantage = codes[a[len(a) // 2]]
    near, far = distance(codes[a], vantage).astype(np.int64), distance(codes[b], vantage).astype(np.int64)
    order = np.argsort(far, kind="stable")
    b, far = b[order], far[order]
    for d in np.unique(near):
        lo, hi = np.searchsorted(far, (d - reach, d + reach + 1))
        join_near(forest, codes, a[near == d], b[lo:hi], reach, depth - 1)

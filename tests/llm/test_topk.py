"""Exact search against brute force: random, repeated, unusable and huge vectors."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from clickloom.llm import topk


def brute(rows, k=5):
    clean = [(i, [math.floor(x * 256) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    queries = {}
    for i, v in sorted(clean):
        if i % 50 == 0:
            queries.setdefault(i, v)
    out, most = [], (1 << 63) - 1
    for q, v in queries.items():
        scores = [(-max(-most, min(most, sum(a * b for a, b in zip(v, w, strict=False)))), i) for i, w in clean if i != q]
        out += [(q, n, i, -s) for n, (s, i) in enumerate(sorted(scores)[:k], 1)]
    return sorted(out)


def search(spark, rows, kind="double"):
    table = spark.createDataFrame([(i, v, 0) for i, v in rows], f"vec_id long, embedding array<{kind}>, score int")
    return sorted(tuple(r) for r in topk.top_k(table, F.col("vec_id") % 50 == 0).collect())


@pytest.mark.parametrize("hot", [0, 400])
def test_random_vectors(spark, monkeypatch, hot):
    monkeypatch.setattr(topk, "LEAST_BLOCK", 40)
    rng = np.random.default_rng(hot)
    centres = rng.normal(size=(6, 8))
    rows = [(i, (centres[i % 6] + rng.normal(size=8) * 0.2).tolist()) for i in range(1200)]
    rows = [(i, rows[0][1] if 100 <= i < 100 + hot else v) for i, v in rows]
    assert search(spark, rows) == brute(rows)


def test_many_more_queries_than_a_part_holds(spark, monkeypatch):
    monkeypatch.setattr(topk, "LEAST_BLOCK", 20)
    monkeypatch.setattr(topk, "MOST_ZONE", 60)
    monkeypatch.setattr(topk, "MOST_QUERIES", 2)
    rng = np.random.default_rng(4)
    rows = [(i, rng.normal(size=5).tolist()) for i in range(1500)]
    assert search(spark, rows) == brute(rows)


def test_separate_groups_are_not_searched(spark, monkeypatch):
    monkeypatch.setattr(topk, "LEAST_BLOCK", 40)
    rng = np.random.default_rng(8)
    centres = np.eye(16) * 4
    rows = [(i, (centres[i % 16] + rng.normal(size=16) * 0.05).tolist()) for i in range(1600)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    found = topk.top_k(table, F.col("vec_id") % 50 == 0, counted=True).collect()
    assert sorted(tuple(r)[:4] for r in found) == brute(rows)
    met = {r["query_id"]: r["n_searched"] for r in found}
    assert len(met) == 32 and sum(met.values()) < 0.4 * 32 * 1600


def test_zones_and_parts_are_bounded():
    rng = np.random.default_rng(6)
    index = topk._fit(rng.normal(size=(50, 3)), 9.0, 4)
    sizes = [(p, r, int(n)) for p in range(4) for r, n in enumerate(rng.integers(1, 500, 9))]
    annuli = topk._blocks(index, sizes, 0.1, 100, 300)
    held = {}
    for (_, _, n), (_, _, first, pieces, start, each) in zip(sizes, annuli, strict=True):
        for i in range(pieces):
            zone = (start + i * each) // 300
            assert zone == index.zone[first + i]
            held[zone] = held.get(zone, 0) + -(-n // pieces)
    assert max(held.values()) <= 410 and (np.diff(index.zone) >= 0).all()


def test_best_in_a_block_with_ties():
    rng = np.random.default_rng(9)
    ids, vectors = np.sort(rng.integers(0, 60, 80)), rng.integers(-2, 3, (80, 3)).astype(float)
    names, queries = rng.integers(0, 60, 30), rng.integers(-2, 3, (30, 3)).astype(float)
    at, found, scores = topk._best(names, queries, ids, vectors, 4)
    for i, (name, q) in enumerate(zip(names, queries, strict=True)):
        want = sorted((-int(q @ v), n) for n, v in zip(ids, vectors, strict=True) if n != name)[:4]
        assert [(-int(s), int(n)) for n, s in zip(found[at == i], scores[at == i], strict=True)] == want


def test_bounds_hold_for_every_vector():
    rng = np.random.default_rng(2)
    x = np.floor(rng.normal(size=(500, 6)) * 256)
    index = topk._fit(x[:100], float((x**2).sum(1).max()), 8)
    pivot, distance = index.place(x)
    index.pivot, index.near, index.far = pivot, distance, distance
    assert (index.best_scores(x) >= x @ x.T).all()
    assert (index.best_scores(x) - x @ x.T).min() < 1000


def test_unusable_repeated_and_short_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 2.0]), (50, [1.0, 2.0]), (50, [3.0, -1.0]), (7, [1.0, 2.0]), (7, [1.0, 2.0]), (8, []), (9, [1.0]), (10, None)]
    rows += [(11, [None, 1.0]), (12, [nan, 1.0]), (13, [inf, 1.0]), (None, [9.0, 9.0]), (100, None), (150, [0.0, 0.0])]
    assert search(spark, rows) == brute(rows)
    assert search(spark, []) == []
    assert search(spark, [(0, [1.0])]) == []
    assert search(spark, [(0, []), (1, [])]) == [(0, 1, 1, 0)]


def test_huge_components(spark):
    rows = [(i, [float((i * 7919) % 1000 * 10**9 + i), 2.5e12]) for i in range(60)]
    assert search(spark, rows) == brute(rows)

"""Targets against stepwise sharing, words taken, the splitting tree, odd rows."""

import math
import random
from collections import Counter

import pytest
from odd import CLASH, odd_docs, plain_docs, rows_of
from pyspark.sql import functions as F

from clickloom.llm import mixing
from clickloom.session import staged


def stepwise(sizes, weights=(5, 2, 1), most=3):
    """Share by weight, cap, and share what is over again until none is above."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    weight = {s: weights[i % 3] for i, s in enumerate(names)}
    target, open_, left = {}, set(names), float(sum(sizes.values()))
    while open_:
        whole = sum(weight[s] for s in open_)
        over = {s for s in open_ if most * sizes[s] <= left * weight[s] / whole}
        if not over:
            return target | {s: left * weight[s] / whole for s in open_}
        for s in over:
            target[s] = float(most * sizes[s])
        left -= sum(target[s] for s in over)
        open_ -= over
    return target


def test_targets_equal_stepwise_sharing(spark):
    rng = random.Random(1)
    for _ in range(6):
        sizes = {s: rng.choice([0, 1, 10, 500, 20_000]) for s in rng.sample(["a", "b", "B", "é", "z", "", None], rng.randint(1, 7))}
        rows = [(s, n) for s, n in sizes.items()]
        got = {r["source"]: r["target"] for r in mixing.targets(spark.createDataFrame(rows, "source string, size long")).collect()}
        want = stepwise(sizes)
        assert got.keys() == want.keys() and all(got[s] == pytest.approx(want[s]) for s in want)


def made(rng, n):
    return [(i, "w " * rng.choice([1, 2, 5, 40]), None, rng.choice(["a", "a", "a", "b", "c", None])) for i in range(n)]


def test_words_taken_come_near_the_targets(spark, monkeypatch):
    monkeypatch.setattr(mixing, "LEAF", 8)
    monkeypatch.setattr(mixing, "BLOCK_DOCS", 4)
    docs = plain_docs(spark, made(random.Random(3), 2000))
    got = mixing.mixed_sizes(docs).collect()
    assert len(got) == 2000
    by = {}
    for r in got:
        assert r["taken"] == r["size"] * r["copies"] <= 3 * r["size"] and len(r["shards"]) == r["copies"]
        own = by.setdefault(r["source_size"], [0, r["target"]])
        own[0] += r["taken"]
    assert len(by) == 4
    assert all(abs(taken - target) <= 0.005 * size for size, (taken, target) in by.items())
    assert sorted(rows_of(mixing.mixed_sizes(docs.repartition(5)))) == sorted(tuple(r) for r in got)


def test_small_sources_are_cut_in_the_random_order(spark):
    rng = random.Random(6)
    docs = plain_docs(spark, [(i, "w " * rng.choice([0, 10, 20, 40, 80]), None, "abc"[i % 3]) for i in range(1800)])
    state = {r["source"]: r for r in mixing.targets(docs.select("source", mixing.n_words("text").alias("size"))).collect()}
    assert state["c"]["n"] < mixing.LEAF and 0.2 < state["c"]["target"] / state["c"]["source_size"] < 0.5
    _, plan = mixing.mixing_plan(docs)
    met = plan.where("source = 'c'").join(docs.select("doc_id", mixing.n_words("text").alias("size")), "doc_id")
    rows = met.select("size", "copies", "target", F.xxhash64(F.lit(mixing.SEED), "doc_id").alias("h")).collect()
    rows.sort(key=lambda r: r["h"] % (1 << 64))
    share = sum(r["copies"] for r in rows) / len(rows)
    for size in (0, 10, 20, 40, 80):
        own = [r["copies"] for r in rows if r["size"] == size]
        assert abs(sum(own) / len(own) - share) < 0.15, size
    taken, target = sum(r["size"] * r["copies"] for r in rows), rows[0]["target"]
    assert target - 10 <= taken <= target
    # All but the last few are a prefix of the order.
    prefix = next(i for i, r in enumerate(rows) if not r["copies"])
    assert sum(r["copies"] for r in rows[prefix:]) <= 8


def test_shards_share_all_draws(spark, monkeypatch):
    monkeypatch.setattr(mixing, "BLOCK_DOCS", 2)
    docs = plain_docs(spark, made(random.Random(4), 1200))
    mixed = mixing.mix(docs, shard_words=1 << 10)
    rows = mixed.collect()
    plan = {r["doc_id"]: r["copies"] for r in mixing.mixed_sizes(docs).collect()}
    assert Counter(r["doc_id"] for r in rows) == {i: n for i, n in plan.items() if n}
    shards = Counter(r["mix_shard"] for r in rows)
    assert len(shards) > 4 and max(shards.values()) < 4 * min(shards.values())


@pytest.mark.parametrize("levels", [0, 1, 5])
def test_tree_deals_each_draw_once(spark, levels):
    draws = staged(spark.createDataFrame([(1, 1000), (2, 7), (3, 0), (4, 450)], "place int, draws long"))
    dealt = mixing._deal(draws, levels).collect()
    assert sorted((r["place"], r["draw"]) for r in dealt) == [(p, i) for p, n in ((1, 1000), (2, 7), (4, 450)) for i in range(n)]
    sizes = Counter(r["shard"] for r in dealt)
    assert len(sizes) == 1 << levels and max(sizes.values()) - min(sizes.values()) <= levels


def test_hypergeometric_draws_follow_the_distribution(spark):
    for total, marked, drawn in ((40, 10, 20), (40, 33, 20), (40, 5, 30), (9000, 4000, 4500), (5, 5, 2), (5, 0, 2), (7, 3, 0), (7, 3, 7)):
        n = 4000
        cells = spark.range(n).select(*(F.lit(v).cast("long").alias(c) for c, v in (("t", total), ("m", marked), ("d", drawn))), mixing._uniform(F.col("id"), F.lit(1)).alias("u"))
        got = [r[0] for r in cells.select(mixing._hypergeometric(*(F.col(c) for c in "tmdu"))).collect()]
        assert max(0, marked + drawn - total) <= min(got) and max(got) <= min(marked, drawn)
        mean = marked * drawn / total
        spread = (mean * (1 - marked / total) * (total - drawn) / max(total - 1, 1)) ** 0.5
        assert abs(sum(got) / n - mean) <= 5 * spread / n**0.5 + 1e-9
        assert abs((sum((x - mean) ** 2 for x in got) / n) ** 0.5 - spread) <= 0.1 * spread + 1e-9


def test_large_draws_are_exact_and_not_rounded_normals(spark):
    n = 20_000
    for total, marked, drawn in ((3_000, 300, 40), (200_000, 700, 100_000), (100_000, 40_000, 50_000)):

        def log_choose(a, b):
            return math.lgamma(a + 1) - math.lgamma(b + 1) - math.lgamma(a - b + 1)

        def mass(x):
            return math.exp(log_choose(marked, x) + log_choose(total - marked, drawn - x) - log_choose(total, drawn))  # noqa: B023

        cells = spark.range(n).select(*(F.lit(v).cast("long").alias(c) for c, v in (("t", total), ("m", marked), ("d", drawn))), ((F.col("id") + 0.5) / n).alias("u"))
        got = Counter(r[0] for r in cells.select(mixing._hypergeometric(*(F.col(c) for c in "tmdu"))).collect())
        mean = marked * drawn / total
        for x in range(max(0, int(mean) - 5), int(mean) + 6):
            # Evenly spaced numbers hit each value as often as its probability says, but for its two ends.
            assert abs(got[x] - n * mass(x)) <= 2, (total, x)


def test_draws_are_permuted(spark):
    for draws in (1, 2, 3, 7, 22, 97, 1 << 10, 3_001):
        number, all_ = F.col("id"), F.lit(draws).cast("long")
        orders = [[r[0] for r in spark.range(draws).select(mixing._permuted(number, all_, F.lit(p))).orderBy("id").collect()] for p in range(4)]
        assert all(sorted(order) == list(range(draws)) for order in orders)
        if draws >= 22:
            assert len({tuple(order) for order in orders}) == 4
            for order in orders:  # neither a shift nor a multiplication
                steps = Counter((b - a) % draws for a, b in zip(order, order[1:], strict=False))
                assert max(steps.values()) <= 8


def test_shards_get_their_share_of_each_source(spark):
    sizes = {1: 4_000, 2: 1_000, 3: 64}
    draws = staged(spark.createDataFrame(list(sizes.items()), "place int, draws long"))
    dealt = Counter((r["place"], r["shard"]) for r in mixing._deal(draws, 6).collect())
    for place, n in sizes.items():
        own = [dealt[place, shard] for shard in range(64)]
        assert sum(own) == n
        mean = n / 64
        assert all(abs(x - mean) <= 5 * mean**0.5 for x in own)
        assert len(set(own)) > 2  # drawn, not dealt in turn


def test_many_sources(spark):
    docs = plain_docs(spark, [(i, "w " * (1 + i % 7), None, f"s{i % 600}") for i in range(3_000)])
    got = mixing.mixed_sizes(docs).collect()
    assert len(got) == 3_000 and all(0 <= r["taken"] <= 3 * r["size"] for r in got)
    assert abs(sum(r["taken"] for r in got) - sum(r["target"] / 5 for r in got)) <= 600 * 7


def test_odd_rows(spark):
    docs = odd_docs(spark)
    got = mixing.mixed_sizes(docs).collect()
    assert len(got) == docs.count() and all(r["taken"] <= 3 * r["size"] for r in got)
    assert {r["copies"] for r in got if r["doc_id"] == 4} == {got_copies(got, 4)}
    mixed = mixing.mix(docs)
    assert [c for c in mixed.columns if c not in docs.columns] == ["mix_copy", "mix_order"] and set(CLASH) <= set(mixed.columns)
    assert mixed.count() == sum(r["copies"] for r in got)
    empty = plain_docs(spark, [])
    assert mixing.mixed_sizes(empty).count() == 0 and mixing.mix(empty).count() == 0


def got_copies(rows, doc_id):
    return next(r["copies"] for r in rows if r["doc_id"] == doc_id)

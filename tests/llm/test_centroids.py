"""Clusters against a plain version in whole numbers, and odd rows."""

import hashlib

import numpy as np
import pytest

from clickloom.llm import centroids

SCHEMA = "vec_id long, embedding array<float>, cluster string, v string"


def plain(rows, width, scale=64, clusters=16, rounds=3, seed=1):
    """(vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256) of the kept rows."""
    kept = [(i, [int(np.floor(scale * float(np.float32(x)))) for x in v]) for i, v in rows if v is not None and len(v) == width and all(x is not None and np.isfinite(x) for x in v)]
    name = lambda i: hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()
    cents = [v for _, v in sorted(kept, key=lambda r: (name(r[0]), r[1]))[:clusters]]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    nearest = lambda v: min((far(v, c), i) for i, c in enumerate(cents))
    for _ in range(rounds):
        own = [nearest(v)[1] for _, v in kept]
        for c in range(len(cents)):
            mine = [v for (_, v), o in zip(kept, own, strict=True) if o == c]
            if mine:
                cents[c] = [sum(x) // len(mine) for x in zip(*mine, strict=True)]
    told = [(i, *nearest(v)[::-1]) for i, v in kept]
    total = {c: sum(d for _, o, d in told if o == c) for _, c, _ in told}
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in cents]
    return [(i, c, d, total[c], sum(total.values()), digest[c]) for i, c, d in told]


def got(spark, rows, width, **more):
    df = spark.createDataFrame([(i, v, "x", "y") for i, v in rows], SCHEMA)
    return [tuple(r) for r in centroids.cluster(df, dimensions=width, **more).collect()]


def ordered(rows):
    return sorted(rows, key=str)


def test_same_as_plain(spark):
    rng = np.random.default_rng(3)
    rows = [(i, [float(np.float32(x)) for x in rng.normal(i % 5, 1, 8)]) for i in range(300)]
    rows += rows[:20] + [(None, [0.5] * 8), (7, [0.5] * 8), (7, [0.25] * 8)]
    assert ordered(got(spark, rows, 8)) == ordered(plain(rows, 8))
    assert ordered(got(spark, rows, 8, clusters=3, rounds=5, seed=9)) == ordered(plain(rows, 8, clusters=3, rounds=5, seed=9))


def test_odd_vectors_take_no_part(spark):
    rows = [(1, None), (2, []), (3, [1.0, 2.0]), (4, [1.0, None, 2.0]), (5, [float("nan"), 1.0, 2.0]), (6, [float("-inf"), 1.0, 2.0]), (7, [1.0, -2.0, 3.0]), (7, [1.0, -2.0, 3.0])]
    out = got(spark, rows, 3)
    assert ordered(out) == ordered(plain(rows, 3)) and len(out) == 2
    assert got(spark, rows[:6], 3) == [] and got(spark, [], 3) == []


def test_ties_go_to_the_smaller_number_and_empty_centroids_stay(spark):
    rows = [(i, [float(i % 2), 0.0]) for i in range(40)]  # many equal centroids: the first takes all, the others stay
    out = got(spark, rows, 2)
    assert ordered(out) == ordered(plain(rows, 2)) and len({r[1] for r in out}) == 2
    test = centroids.Tournament(np.array([[4, 0], [0, 0], [0, 0]]))
    assert test.nearest(np.array([[2, 5], [1, 0], [3, 0]])).tolist() == [0, 1, 0]


def test_sums_do_not_depend_on_partitions(spark):
    rng = np.random.default_rng(4)
    df = spark.createDataFrame([(i, rng.normal(0, 1, 64).tolist()) for i in range(400)], "vec_id long, embedding array<double>")
    first = sorted(map(tuple, centroids.cluster(df.coalesce(1)).collect()))
    assert first == sorted(map(tuple, centroids.cluster(df.repartition(7)).collect()))


def test_components_out_of_range_are_refused(spark):
    with pytest.raises(Exception, match="beyond"):
        got(spark, [(1, [1e30, 0.0])], 2)

import numpy as np
import pytest
from pyspark.sql import functions as F

from clickloom.operators.lookup import SALTS, bounded_lookup, broadcast_lookup, hot_keys, measured_lookup, salted_lookup

PARTS = 8


def skewed(spark, n=3000):
    """A third of all rows share one key; some keys are null or not in the table."""
    rng = np.random.default_rng(1)
    keys = [None if i % 50 == 0 else ("hot" if i % 3 == 0 else f"k{rng.integers(0, 400)}") for i in range(n)]
    return spark.createDataFrame([(i, k) for i, k in enumerate(keys)], "id long, k string"), keys


def weights(spark):
    return spark.createDataFrame([("hot", 1.5)] + [(f"k{i}", float(i)) for i in range(0, 400, 2)], "k string, w double")


def expected(keys):
    table = {"hot": 1.5} | {f"k{i}": float(i) for i in range(0, 400, 2)}
    return {i: table.get(k) for i, k in enumerate(keys)}


def test_salted_lookup_is_exact_under_skew(spark, no_broadcast):
    rows, keys = skewed(spark)
    got = {r["id"]: r["w"] for r in salted_lookup(rows, weights(spark), ["k"], ["id"]).collect()}
    assert got == expected(keys)


def test_hot_rows_are_spread(spark, no_broadcast):
    rows, _ = skewed(spark)
    joined = salted_lookup(rows.repartition(4), weights(spark), ["k"], ["id"])
    plan = joined._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(k" in plan and "_salt" in plan
    hot = {r["k"]: r[SALTS] for r in hot_keys(rows, ["k"]).collect()}
    assert hot["hot"] >= PARTS // 2
    assert len(hot) <= 2 * PARTS and sum(hot.values()) <= 3 * PARTS


def test_hot_keys_from_counts(spark):
    counted = spark.createDataFrame([("a", 1000), ("b", 1), ("c", 1), (None, 5000)], "k string, n long")
    hot = {r["k"]: r[SALTS] for r in hot_keys(counted, ["k"], F.col("n")).collect()}
    assert hot == {"a": PARTS, "b": 1, "c": 1}


def test_inner_lookup_drops_unmatched(spark, no_broadcast):
    rows, keys = skewed(spark)
    got = {r["id"]: r["w"] for r in salted_lookup(rows, weights(spark), ["k"], ["id"], how="inner").collect()}
    assert got == {i: w for i, w in expected(keys).items() if w is not None}


@pytest.mark.parametrize("limit", [0, 10_000])
def test_measured_lookup_both_ways(spark, no_broadcast, limit):
    rows, keys = skewed(spark)
    joined = measured_lookup(rows, weights(spark), ["k"], ["id"], max_rows=limit)
    plan = joined._jdf.queryExecution().executedPlan().toString()
    assert ("_salt" in plan) == (limit == 0)
    assert {r["id"]: r["w"] for r in joined.collect()} == expected(keys)


def test_bounds_decide(spark):
    rows, _ = skewed(spark, 100)
    with pytest.raises(ValueError):
        broadcast_lookup(rows, weights(spark), ["k"], 10**9)
    small = bounded_lookup(rows, weights(spark), ["k"], ["id"], 401)
    large = bounded_lookup(rows, weights(spark), ["k"], ["id"], 10**9)
    assert "_salt" not in small._jdf.queryExecution().logical().toString()
    assert "_salt" in large._jdf.queryExecution().logical().toString()

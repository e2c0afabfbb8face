import numpy as np
import pytest
from pyspark.sql import functions as F

from clickloom.operators import batches
from clickloom.operators.order import RANGE, by_ranges, range_bounds, uniform_bounds, with_row_index, with_running_totals


def test_row_index_follows_the_key(spark):
    keys = np.random.default_rng(2).permutation(5000) * 3 - 1000
    df = spark.createDataFrame([(int(k),) for k in keys], "key long").repartition(5)
    got = {r["key"]: r["row_index"] for r in with_row_index(df, "key").collect()}
    assert got == {k: i for i, k in enumerate(sorted(got))}


@pytest.mark.parametrize("bounds", [[], [0.0], [-1e9, 1e9], [10.0, 11.0, 12.0], uniform_bounds(0, 500, 20)])
def test_bounds_never_change_the_result(spark, bounds):
    df = spark.range(500).withColumnRenamed("id", "key").repartition(3)
    rows = with_row_index(df, "key", bounds=bounds).collect()
    assert all(r["key"] == r["row_index"] for r in rows) and len(rows) == 500


def test_empty_table(spark):
    df = spark.createDataFrame([], "key long")
    assert with_row_index(df, "key").collect() == []


def test_quantile_bounds_with_a_hot_value(spark):
    df = spark.range(900).select(F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id")).cast("double").alias("key"))
    bounds = range_bounds(df, "key", 10)
    assert bounds == sorted(set(bounds)) and len(bounds) <= 9


def test_a_hot_key_is_spread_by_its_ties(spark):
    rows = [(0 if i % 10 else i, f"t{i * 7919 % 4000:04d}") for i in range(4000)]
    df = spark.createDataFrame(rows, "key long, token string").repartition(6)
    sizes = [r["count"] for r in by_ranges(df, ["key", "token"], 8).groupBy(RANGE).count().collect()]
    assert sum(sizes) == 4000 and max(sizes) < 1000  # 3,601 rows share the key 0
    got = with_row_index(df, "key", ties=("token",)).orderBy("row_index").collect()
    assert [(r["key"], r["token"]) for r in got] == sorted(rows) and [r["row_index"] for r in got] == list(range(4000))
    assert got[0].asDict().keys() == {"key", "token", "row_index"}


def test_rows_without_any_difference(spark):
    df = spark.createDataFrame([(1, "a")] * 50 + [(None, "b"), (0, None)], "key int, token string")
    got = with_row_index(df, "key", ties=("token",)).orderBy("row_index").collect()
    assert [(r["key"], r["token"]) for r in got] == [(None, "b"), (0, None)] + [(1, "a")] * 50
    assert [r["row_index"] for r in got] == list(range(52))
    assert with_row_index(df.where("false"), "key", ties=("token",)).collect() == []


@pytest.mark.parametrize("descending", [False, True])
def test_running_totals(spark, descending):
    rng = np.random.default_rng(3)
    keys, values = rng.permutation(700) / 7.0, rng.integers(0, 10, 700)
    df = spark.createDataFrame([(float(k), int(v)) for k, v in zip(keys, values, strict=True)], "key double, v long")
    got = {
        r["key"]: r["total"]
        for r in with_running_totals(df, "key", {"total": F.col("v")}, range_bounds(df, "key"), descending).collect()
    }
    order = np.argsort(-keys if descending else keys)
    assert got == dict(zip(keys[order].tolist(), np.cumsum(values[order]).tolist(), strict=True))


def test_shuffle_is_a_permutation_and_seeded(spark):
    df = spark.range(1000).withColumnRenamed("id", "event_id")
    one = {r["event_id"]: r["position"] for r in batches.seeded_shuffle(df, "event_id", 1).collect()}
    again = {r["event_id"]: r["position"] for r in batches.seeded_shuffle(df.repartition(7), "event_id", 1).collect()}
    other = {r["event_id"]: r["position"] for r in batches.seeded_shuffle(df, "event_id", 2, method="xxhash64").collect()}
    assert sorted(one.values()) == list(range(1000)) == sorted(other.values())
    assert one == again != other


def test_shards_partition_the_rows(spark):
    df = with_row_index(spark.range(103).withColumnRenamed("id", "key"), "key")
    sizes = [batches.shard(df, 4, i).count() for i in range(4)]
    assert sorted(sizes) == [25, 26, 26, 26]


def test_padding_is_per_batch(spark):
    df = spark.createDataFrame([(0, ["a"]), (1, ["b", "c"]), (2, []), (3, ["d"])], "row_index long, t array<string>")
    padded = batches.padded_batch(batches.batch_ids(df, 2), {"t": ""})
    assert {r["row_index"]: r["t"] for r in padded.collect()} == {0: ["a", ""], 1: ["b", "c"], 2: [""], 3: ["d"]}


def test_positional_join_stops_at_the_shorter_side(spark):
    left = spark.createDataFrame([(10, "a"), (20, "b"), (30, "c")], "lk long, l string")
    right = spark.createDataFrame([(5, "x"), (1, "y")], "rk long, r string")
    got = {(r["row_index"], r["l"], r["r"]) for r in batches.positional_join(left, right, "lk", "rk").collect()}
    assert got == {(0, "a", "y"), (1, "b", "x")}

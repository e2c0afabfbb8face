"""A store of rates by feature: sizes, pruning, bounds and odd rows."""

import os

import pytest
from pyspark.sql import functions as F

from clickloom.operators import rates
from clickloom.operators.rate_store import RateStore

ROWS = [("user", "ü1", 1, 0.5), ("user", "", 2, None), ("os/2", None, 3, 0.25), ("user", "b" * 50, 4, 1.0), ("other", "x", 5, 0.0)]


@pytest.fixture
def store(spark, tmp_path):
    table = spark.createDataFrame(ROWS, "feature string, value string, n long, rate double")
    return RateStore.write(table, ["os/2", "none", "user"], f"{tmp_path}/store")


def test_sizes_are_known_from_the_writing_job(store):
    assert store.rows == {"os/2": 1, "none": 0, "user": 3}
    assert store.size == {"os/2": 0, "none": 0, "user": 53}


def test_a_feature_is_read_alone(spark, store):
    assert sorted(map(tuple, store.of(spark, "user").collect()), key=str) == sorted([r[1:] for r in ROWS if r[0] == "user"], key=str)
    assert [tuple(r) for r in store.of(spark, "os/2").collect()] == [(None, 3, 0.25)]
    empty = store.of(spark, "none")
    assert empty.collect() == [] and empty.columns == ["value", "n", "rate"]
    assert all("feature_number=2/" in f for f in store.of(spark, "user").inputFiles())


def test_small_features_stay_within_both_bounds_together(store):
    assert store.small(4, 53) == {"none", "os/2", "user"}
    assert store.small(3, 53) == {"none", "os/2"} and store.small(4, 52) == {"none", "os/2"} and store.small(0, 0) == {"none"}


def test_discard_and_empty_rates(spark, store, tmp_path):
    store.discard(spark)
    assert not os.path.exists(store.path)
    none = RateStore.write(spark.createDataFrame([], "feature string, value string, n long"), ["a"])
    assert none.rows == {"a": 0} and none.of(spark, "a").collect() == []


def test_broadcast_and_salted_features_give_the_same_rates(spark):
    log = spark.range(600).select(F.col("id").alias("row"), F.lit("2024-01-02").cast("date").alias("day"), (F.col("id") % 7).alias("a"), F.when(F.col("id") % 3 > 0, "hot").otherwise((F.col("id") % 50).cast("string")).alias("b"), (F.col("id") % 5 == 0).alias("clk"))
    daily = rates.trailing_rates(rates.daily_counts(log, ["a", "b"], "day", F.col("clk")), "day", (1, 7))
    attached = [rates.attach_rates(log.select("row", "day", "a", "b"), daily, ["a", "b"], "day", "row", (1, 7), bound) for bound in (1000, 10, 0)]
    found = [sorted(map(tuple, df.collect())) for df in attached]
    assert found[0] == found[1] == found[2] and len(found[0]) == 600 and all(None not in r for r in found[0])


def test_rate_of_every_row(spark):
    log = spark.createDataFrame([(1, "a", 1), (2, "a", 0), (3, None, 1), (4, "b", None)], "id long, k string, clk int")
    got = sorted(map(tuple, rates.with_target_rate(log, ["k"], F.col("clk") == 1, "id").collect()))
    assert got == [(1, "a", 0.5, 2), (2, "a", 0.5, 2), (3, None, None, None), (4, "b", None, 1)]

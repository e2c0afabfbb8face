"""Sketches per day and feature: merged counts, replaced days, what is shuffled and read."""

import re

import pytest
from pyspark.sql import functions as F

from clickloom.operators import sketches


@pytest.fixture(scope="module")
def log(spark):
    day = F.date_add(F.lit("2024-01-01").cast("date"), (F.col("id") % 10).cast("int"))
    return spark.range(20_000).select(day.alias("day"), (F.col("id") % 3_000).cast("string").alias("user"), F.when(F.col("id") % 2 == 0, "a").alias("os"))


@pytest.fixture(scope="module")
def path(log, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("sketches"))
    sketches.store(sketches.daily_sketches(log, ["user", "os"], F.col("day")), path)
    return path


def counts(df):
    return {r["feature"]: (r["n_values"], r["n"]) for r in df.collect()}


def test_merged_days_count_values_once(spark, path):
    whole = counts(sketches.distinct_counts(sketches.stored(spark, path)))
    assert abs(whole["user"][0] - 3_000) < 4 * 1.04 / 64 * 3_000 and whole["user"][1] == 20_000
    assert whole["os"] == (1, 10_000)
    part = counts(sketches.distinct_counts(sketches.stored(spark, path), "2024-01-02", "2024-01-03"))
    assert abs(part["user"][0] - 600) < 4 * 1.04 / 64 * 600 and part["user"][1] == 4_000
    assert sketches.distinct_counts(sketches.stored(spark, path), "2025-01-01").collect() == []


def test_a_day_that_is_counted_again_replaces_its_sketches(spark, log, path, tmp_path):
    again = str(tmp_path)
    sketches.store(sketches.daily_sketches(log, ["user"], F.col("day")), again)
    before = counts(sketches.distinct_counts(sketches.stored(spark, again)))
    sketches.store(sketches.daily_sketches(log.where("day = '2024-01-04'"), ["user"], F.col("day")), again)
    assert counts(sketches.distinct_counts(sketches.stored(spark, again))) == before


def test_sketches_are_shuffled_and_only_asked_days_read(spark, log, path):
    plan = sketches.daily_sketches(log, ["user"], F.col("day"))._jdf.queryExecution().executedPlan().toString()
    assert plan.index("partial_hll_sketch_agg") > plan.index("Exchange hashpartitioning(feature")
    ranged = sketches.distinct_counts(sketches.stored(spark, path), "2024-01-02", "2024-01-03")
    scan = ranged._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PartitionFilters: \[[^\]]*day", scan)

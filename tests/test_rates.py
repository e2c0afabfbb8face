from datetime import date, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from clickloom.operators import rates, sampling
from clickloom.plans.prepare import Preparation, prepare

DAY0 = date(2024, 1, 1)


def test_four_row_example(spark):
    df = spark.createDataFrame([(0, "F"), (0, "M"), (1, "M"), (0, "M")], "clk int, sex string")
    got = {r["sex"]: (r["rate"], r["n"]) for r in rates.target_rate(df, ["sex"], F.col("clk") == 1).collect()}
    assert got == {"F": (0.0, 1), "M": (pytest.approx(1 / 3), 3)}


@pytest.fixture(scope="module")
def log(spark):
    """A log with missing categories, a hot category and days without traffic."""
    rng = np.random.default_rng(4)
    rows = []
    for i in range(1500):
        day = DAY0 + timedelta(days=int(rng.choice([0, 1, 2, 5, 9, 10, 20, 39])))
        user = None if i % 11 == 0 else ("hot" if i % 3 == 0 else f"u{rng.integers(0, 40)}")
        rows.append((i, day, user, int(rng.integers(0, 4)), int(rng.random() < 0.2)))
    return spark.createDataFrame(rows, "id long, day date, user string, os int, clk int").persist()


def brute_force(rows, feature, value, day, k, include_current=True):
    last = day if include_current else day - timedelta(days=1)
    hits = [r["clk"] for r in rows if str(r[feature] if r[feature] is not None else "") == value
            and last - timedelta(days=k - 1) <= r["day"] <= last]
    return sum(hits) / len(hits) if hits else None


@pytest.mark.parametrize("include_current", [True, False])
def test_trailing_windows(spark, log, include_current):
    rows = log.collect()
    daily = rates.daily_counts(log, ["user", "os"], "day", F.col("clk") == 1)
    got = rates.trailing_rates(daily, "day", (1, 7, 30), include_current).collect()
    assert len(got) == len({(f, r[f], r["day"]) for r in rows for f in ("user", "os")})
    for r in got[::7]:
        for k in (1, 7, 30):
            want = brute_force(rows, r["feature"], r["value"], r["day"], k, include_current)
            assert r[f"rate_{k}"] == (None if want is None else pytest.approx(want))


def test_attached_rates_do_not_depend_on_the_join(spark, log, no_broadcast):
    daily = rates.daily_counts(log, ["user", "os"], "day", F.col("clk") == 1)
    windowed = rates.trailing_rates(daily, "day", (1, 7))

    def attach(limit):
        out = rates.attach_rates(log, windowed, ["user", "os"], "day", "id", (1, 7), limit)
        assert out.columns == [*log.columns, "user_rate_1", "os_rate_1", "user_rate_7", "os_rate_7"]
        return {r["id"]: r for r in out.collect()}

    broadcast, salted = attach(10**6), attach(0)
    assert len(broadcast) == log.count() and broadcast == salted
    assert all(r["user_rate_1"] is not None for r in salted.values())


def test_preparation_uses_the_full_log_for_rates(spark, log):
    run_day = DAY0 + timedelta(days=10)
    job = Preparation(features=("user",), windows=(7,), keep=0.3)
    done = prepare(log, "clk", "day", "id", job, F.col("day") == F.lit(run_day)).collect()
    rows = log.collect()
    assert {r["id"] for r in done if r["clk"] == 1} == {r["id"] for r in rows if r["clk"] == 1 and r["day"] == run_day}
    for r in done:
        assert r["day"] == run_day
        assert r["user_rate_7"] == pytest.approx(brute_force(rows, "user", r["user"] or "", run_day, 7))


def test_preparation_without_features_only_samples(spark, log):
    done = prepare(log, "clk", "day", "id", Preparation(keep=0.5))
    assert done.columns == log.columns
    assert {r["id"] for r in done.collect()} == {r["id"] for r in sampling.downsample(log, "clk", "id", 0.5).collect()}


def test_sampling_shares_and_seeds(spark):
    df = spark.range(20000).select("id", (F.col("id") % 10 == 0).cast("int").alias("clk"))
    kept = {r["id"] for r in sampling.downsample(df, "clk", "id", 0.1).collect()}
    assert set(range(0, 20000, 10)) <= kept
    assert 1600 < len(kept) - 2000 < 2000
    again = sampling.downsample(df.repartition(13), "clk", "id", 0.1)
    assert {r["id"] for r in again.collect()} == kept
    other = sampling.downsample(df, "clk", "id", 0.1, seed=1, method="xxhash64")
    assert {r["id"] for r in other.collect()} != kept
    assert sampling.downsample(df, "clk", "id", 0.0).count() == 2000
    assert sampling.downsample(df, "clk", "id", 1.0).count() == 20000

"""Target rates: the share of positive labels per category over trailing days.

Logs are melted to (feature, value, day) once for all features and counted with map-side combine.
Everything after that works on one row per category and day, so a category with a third of all
impressions costs no more than any other.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clickloom.operators.lookup import BROADCAST_BYTES, BROADCAST_ROWS, hot_keys, salted_lookup
from clickloom.operators.rate_store import RateStore
from clickloom.session import staged

WINDOWS = (1, 7, 30)


def count_sum_by_key(df: DataFrame, keys: list[str], label: Column) -> DataFrame:
    """Rows and positives per key."""
    return df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.sum(label.cast("bigint")).alias("positives")
    )


def target_rate(df: DataFrame, keys: list[str], label: Column, out: str = "rate") -> DataFrame:
    """Mean label per key, with the number of rows behind it."""
    counted = count_sum_by_key(df, keys, label)
    return counted.select(*keys, (F.col("positives") / F.col("n")).alias(out), "n")


def category_text(feature: str) -> Column:
    return F.coalesce(F.col(feature).cast("string"), F.lit(""))


def melt(df: DataFrame, features: list[str], keep: list[str]) -> DataFrame:
    """One row per (row, feature); a missing value is a category of its own, the empty string."""
    pairs = [F.struct(F.lit(f).alias("feature"), category_text(f).alias("value")) for f in features]
    return df.select(*keep, F.inline(F.array(*pairs)))


def daily_counts(df: DataFrame, features: list[str], day: str, label: Column) -> DataFrame:
    """Rows and positives per (feature, value, day)."""
    labelled = df.withColumn("_label", label.cast("bigint"))
    return count_sum_by_key(melt(labelled, features, [day, "_label"]), ["feature", "value", day], F.col("_label"))


def trailing_rates(
    daily: DataFrame, day: str, windows: tuple[int, ...] = WINDOWS, include_current: bool = True
) -> DataFrame:
    """Rate over the trailing k days for every (feature, value, day) that occurs.

    Frames are ranges of day numbers, so days without traffic count as days. ``include_current``
    keeps the row's own day in its windows; without it the rates are free of label leakage and a
    first day has none (null).
    """
    last = 0 if include_current else -1
    number = F.datediff(F.col(day), F.lit("1970-01-01").cast("date"))

    def over(k: int):
        first = last - (k - 1)
        return Window.partitionBy("feature", "value").orderBy("_day_number").rangeBetween(first, last)

    rates = {f"rate_{k}": F.sum("positives").over(over(k)) / F.sum("n").over(over(k)) for k in windows}
    return daily.withColumn("_day_number", number).withColumns(rates).drop("_day_number")


def attach_rates(
    rows: DataFrame,
    rates: DataFrame,
    features: list[str],
    day: str,
    row_id: str,
    windows: tuple[int, ...] = WINDOWS,
    max_broadcast_rows: int = BROADCAST_ROWS,
) -> DataFrame:
    """Append ``<feature>_rate_<k>`` columns, window by window and then feature by feature.

    The rates are stored by feature, which also tells how large each is. Features are broadcast from the
    smallest on, as long as all of them together have at most ``max_broadcast_rows`` rows and BROADCAST_BYTES
    of categories; any other is a shuffle join with its hot categories salted, for which the counts behind
    the rates already tell which categories are hot.
    """
    spark = rows.sparkSession
    columns = ["value", day, "n", *[f"rate_{k}" for k in windows]]
    store = RateStore.write(rates.select("feature", *columns), features)
    small = store.small(max_broadcast_rows, BROADCAST_BYTES)
    keys = ["_value", day]
    joined = rows
    for feature in features:
        mine = store.of(spark, feature).toDF("_value", day, "n", *[f"{feature}_rate_{k}" for k in windows])
        keyed = joined.withColumn("_value", category_text(feature))
        if feature in small:
            joined = keyed.join(F.broadcast(mine.drop("n")), keys, "left").drop("_value")
        else:
            hot = hot_keys(mine, keys, F.col("n"))
            joined = salted_lookup(keyed, mine.drop("n"), keys, [row_id], hot).drop("_value")
    names = [f"{feature}_rate_{k}" for k in windows for feature in features]
    return joined.select(*rows.columns, *names)


def with_target_rate(df: DataFrame, keys: list[str], label: Column, row_id: str, out: str = "rate") -> DataFrame:
    """Row id, keys, target rate and the number of rows behind it, for every row of ``df``.

    ``df`` is read twice: for the rates, which are written once, and for the rows. The written table is the
    lookup table and tells the hot keys, which are salted.
    """
    stored = staged(target_rate(df, keys, label, out), "rates")
    hot = hot_keys(stored, keys, F.col("n"))
    return salted_lookup(df.select(row_id, *keys), stored, keys, [row_id], hot).select(row_id, *keys, out, "n")

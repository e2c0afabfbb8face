"""Approximate distinct counts from sketches stored per day and feature.

A HyperLogLog sketch of each (feature, day) is built on the map side, so that sketches and not values are shuffled,
and stored in a folder per feature and day. The count of any range of days merges stored sketches: no log is read
again, and a day that is counted anew replaces its own sketches only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from clickloom.operators.rates import melt

# The power of two of a sketch's registers; the standard error is some 1.04 / sqrt(registers).
REGISTERS = 12
SCHEMA = "sketch binary, n bigint, feature string, day string"


def daily_sketches(df: DataFrame, features: list[str], day: Column, registers: int = REGISTERS) -> DataFrame:
    """(feature, day, sketch, n): a sketch of the values that aren't missing, and how many rows have one."""
    rows = melt(df.withColumn("_day", day), features, ["_day"]).where(F.col("value") != "")
    sketch = F.hll_sketch_agg("value", F.lit(registers)).alias("sketch")
    return rows.groupBy("feature", F.col("_day").alias("day")).agg(sketch, F.count(F.lit(1)).alias("n"))


def store(sketches: DataFrame, path: str) -> None:
    """Write sketches below ``path``; days and features that are there already are replaced, others stay."""
    rows = sketches.select("sketch", "n", "feature", F.col("day").cast("string").alias("day"))
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("feature", "day").parquet(path)


def stored(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(SCHEMA).parquet(path)


def distinct_counts(sketches: DataFrame, first: str | None = None, last: str | None = None, by: tuple[str, ...] = ("feature",)) -> DataFrame:
    """(``by``, n_values, n): estimated distinct values and rows over all days from ``first`` to ``last``.

    Only the folders of these days are read. Groups without a sketch there have no row.
    """
    chosen = sketches
    if first is not None:
        chosen = chosen.where(F.col("day") >= first)
    if last is not None:
        chosen = chosen.where(F.col("day") <= last)
    merged = chosen.groupBy(*by).agg(F.hll_union_agg("sketch").alias("sketch"), F.sum("n").alias("n"))
    return merged.select(*by, F.hll_sketch_estimate("sketch").alias("n_values"), "n")

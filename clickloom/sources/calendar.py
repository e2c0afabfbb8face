"""Day lists as DataFrames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def day_text(day: Column) -> Column:
    return F.date_format(day, "yyyyMMdd")


def trailing_dates(days: DataFrame, day: str, n: int, out: str = "trailing") -> DataFrame:
    """Each day with itself and the n-1 days before it."""
    return days.withColumn(out, F.explode(F.sequence(F.col(day), F.date_sub(F.col(day), n - 1), F.expr("interval -1 day"))))


def date_range(limits: DataFrame, first: str, last: str, out: str = "day") -> DataFrame:
    """Every day between two date columns, both included."""
    return limits.select(F.explode(F.sequence(F.col(first), F.col(last), F.expr("interval 1 day"))).alias(out))

"""Global order without a single-task window: row indexes and running totals.

Rows are put into P value ranges by quantile bounds of the order key. Ranges are numbered in order, so
a global position is the position inside the range plus the total of all earlier ranges. The list of
range totals has P+1 rows and is the only thing that is broadcast. The bounds influence balance, never
the result. The input is read several times; materialise it first if it is expensive.

Equal keys fall into one range. Where further columns order them, ``with_row_index`` cuts by all of them, so
that a key with a large part of the rows is spread over several ranges; such rows are written once by range.
"""

from __future__ import annotations

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clickloom.session import shuffle_partitions, staged

RANGE = "_range"
SAMPLES_PER_RANGE = 200


def range_bounds(df: DataFrame, key: str, ranges: int | None = None) -> list[float]:
    """Strictly increasing quantile bounds of a numeric column (at most ``ranges`` - 1 of them).

    Taken from a few hundred sampled keys per range: bounds only balance the ranges.
    """
    ranges = ranges or shuffle_partitions(df.sparkSession)
    if ranges < 2:
        return []
    keys = df.select(key)
    share = SAMPLES_PER_RANGE * ranges / max(keys.count(), 1)
    if share < 1:
        keys = keys.sample(share, seed=0)
    fractions = [i / ranges for i in range(1, ranges)]
    found = keys.stat.approxQuantile(key, fractions, 0.25 / ranges)
    return sorted({float(b) for b in found or []})


def uniform_bounds(low: float, high: float, ranges: int) -> list[float]:
    """Equal-width bounds, for keys known to be spread evenly such as hashes."""
    return [low + (high - low) * i / ranges for i in range(1, ranges)]


def with_range(df: DataFrame, key: str, bounds: list[float]) -> DataFrame:
    """Add the range number of ``key``: how many bounds are at or below it."""
    if not bounds:
        return df.withColumn(RANGE, F.lit(0))
    splits = [float("-inf"), *bounds, float("inf")]
    ranged = Bucketizer(splits=splits, inputCol=key, outputCol=RANGE, handleInvalid="keep").transform(df)
    return ranged.withColumn(RANGE, F.col(RANGE).cast("int"))


def with_running_totals(
    df: DataFrame,
    key: str,
    totals: dict[str, Column],
    bounds: list[float],
    descending: bool = False,
    ties: tuple[str, ...] = (),
) -> DataFrame:
    """Add inclusive running sums along ``key``, a column without nulls.

    The key is unique per row (aggregate first), or ``ties`` names columns that order equal keys.
    """
    order = [F.desc(key) if descending else F.asc(key), *ties]
    return _summed(with_range(df, key, bounds), order, totals, len(bounds) + 2, descending)


def _summed(ranged: DataFrame, order: list, totals: dict[str, Column], ranges: int, descending: bool = False) -> DataFrame:
    """Running sums inside each of the ranges plus the totals of the ranges before it."""
    inside = Window.partitionBy(RANGE).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    before = _totals_before(ranged, totals, descending)
    # One range per task: a hash of the range number would put several into some tasks.
    placed = ranged.repartitionById(ranges, RANGE)
    summed = placed.withColumns({name: F.sum(value).over(inside) for name, value in totals.items()})
    joined = summed.join(F.broadcast(before), RANGE, "left")  # one row per range
    return joined.withColumns({name: F.col(name) + F.col(f"_before_{name}") for name in totals}).drop(
        RANGE, *[f"_before_{name}" for name in totals]
    )


def by_ranges(df: DataFrame, order: list[str], ranges: int | None = None) -> DataFrame:
    """``df`` written once with the number of each row's range of ``order``: ranges of like size that ascend.

    Only rows that are equal in all columns of ``order`` must share a range. Spark samples the bounds, which
    another run may place elsewhere; so the ranges are stored with the rows and not found again.
    """
    ranges = ranges or shuffle_partitions(df.sparkSession)
    ranged = df.repartitionByRange(ranges, *order).withColumn(RANGE, F.spark_partition_id())
    return staged(ranged, "ranges")


def with_row_index(
    df: DataFrame, key: str, out: str = "row_index", bounds: list[float] | None = None, ties: tuple[str, ...] = ()
) -> DataFrame:
    """Number rows from 0 in the order of ``key``, a numeric column that is unique (up to ``ties``).

    Given ``bounds`` are for keys that are hardly ever equal. Without them, and with ``ties``, rows are dealt to
    ranges of key and ties together, and the result reads a written copy of the rows.
    """
    number = {out: F.lit(1).cast("bigint")}
    if ties and bounds is None:
        ranges = shuffle_partitions(df.sparkSession)
        numbered = _summed(by_ranges(df, [key, *ties], ranges), [key, *ties], number, ranges)
    else:
        numbered = with_running_totals(df, key, number, range_bounds(df, key) if bounds is None else bounds, ties=ties)
    return numbered.withColumn(out, F.col(out) - 1)


def _totals_before(ranged: DataFrame, totals: dict[str, Column], descending: bool) -> DataFrame:
    per_range = ranged.groupBy(RANGE).agg(*[F.sum(value).alias(f"_t_{name}") for name, value in totals.items()])
    order = F.desc(RANGE) if descending else F.asc(RANGE)
    # One row per range: the single-partition window is bounded by the number of ranges.
    earlier = Window.partitionBy(F.lit(0)).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return per_range.select(
        RANGE,
        *[
            F.coalesce(F.sum(f"_t_{name}").over(earlier), F.lit(0)).alias(f"_before_{name}")
            for name in totals
        ],
    )

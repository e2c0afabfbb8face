"""Profiles that guide configuration: class balance, bucket sizes, collisions, value distributions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clickloom.functions.categorical import SEPARATOR, hash_bucket
from clickloom.operators.rates import category_text, melt

SMALL_CATEGORY = 100
LARGE_CATEGORY = 10_000


def class_balance(df: DataFrame, label: Column) -> DataFrame:
    """Rows per class and the loss weights that balance them."""
    pos, n = F.sum(label.cast("bigint")), F.count(F.lit(1))
    return df.agg(
        n.alias("n"),
        pos.alias("n_pos"),
        (n - pos).alias("n_neg"),
        ((n - pos) / n).alias("pos_weight"),
        (pos / n).alias("neg_weight"),
    )


def distinct_values(df: DataFrame, features: list[str]) -> DataFrame:
    """Distinct (feature, value) pairs of all features in one pass; missing values are left out."""
    return melt(df, features, []).where(F.col("value") != "").distinct()


def bucket_size_advice(df: DataFrame, features: list[str]) -> DataFrame:
    """Recommended range of hash sizes from exact distinct counts.

    2 to 3 ids per value; 3 to 4 for small categories and 1.5 to 2 for large ones.
    """
    n = F.count(F.lit(1))
    counted = distinct_values(df, features).groupBy("feature").agg(n.alias("n_values"))
    small, large = F.col("n_values") <= SMALL_CATEGORY, F.col("n_values") > LARGE_CATEGORY
    low = F.when(small, 3.0).when(large, 1.5).otherwise(2.0)
    high = F.when(small, 4.0).when(large, 2.0).otherwise(3.0)
    return counted.select(
        "feature",
        "n_values",
        F.ceil(low * F.col("n_values")).cast("bigint").alias("size_low"),
        F.ceil(high * F.col("n_values")).cast("bigint").alias("size_high"),
    )


def cross_size_advice(df: DataFrame, crosses: list[tuple[str, ...]]) -> DataFrame:
    """Per cross: observed combinations, twice that number, and the product of the member counts.

    As in ``cross_hash`` a combination with a missing member has no id and doesn't count. A product
    beyond 64 bits is null.
    """
    singles = sorted({m for members in crosses for m in members})

    def combined(members: tuple[str, ...]) -> Column:
        values = [category_text(m) for m in members]
        present = reduce(lambda a, b: a & b, [v != "" for v in values])
        return F.when(present, F.concat_ws(SEPARATOR, *values))

    combos = df.withColumns({"&".join(members): combined(members) for members in crosses})
    counted = (
        distinct_values(combos, singles + ["&".join(members) for members in crosses])
        .groupBy("feature")
        .agg(F.count(F.lit(1)).alias("n_values"))
    )
    # One row per feature and cross of the spec.
    members = counted.select(F.col("feature").alias("member"), F.col("n_values").alias("n_member"))
    split = counted.where(F.col("feature").contains("&")).withColumn("member", F.explode(F.split("feature", "&")))
    return (
        split.join(F.broadcast(members), "member")
        .groupBy(F.col("feature").alias("cross"), "n_values")
        .agg(F.aggregate(F.collect_list("n_member"), F.lit(1).cast("bigint"), F.try_multiply).alias("product_size"))
        .withColumn("double_size", F.col("n_values") * 2)
    )


def hash_collisions(df: DataFrame, features: list[str], size_factor: float = 1.0, method: str = "xxhash64") -> DataFrame:
    """Share of ids in use when a feature is hashed into ``size_factor`` ids per distinct value."""
    values = distinct_values(df, features)
    sizes = values.groupBy("feature").agg(F.count(F.lit(1)).alias("n_values"))
    sized = values.join(F.broadcast(sizes), "feature")  # one row per feature
    size = F.greatest(F.ceil(F.col("n_values") * F.lit(size_factor)), F.lit(1)).cast("bigint")
    buckets = sized.withColumn("bucket", hash_bucket(F.col("value"), size, method))
    used = buckets.select("feature", "n_values", "bucket").distinct()
    return (
        used.groupBy("feature", "n_values")
        .agg(F.count(F.lit(1)).alias("n_buckets"))
        .withColumn("bucket_ratio", F.col("n_buckets") / F.col("n_values"))
    )


def zero_fraction(df: DataFrame, columns: list[str]) -> DataFrame:
    """Share of zeros per column."""
    return df.agg(*[F.avg((F.col(c) == 0).cast("double")).alias(c) for c in columns])


def value_histogram(df: DataFrame, column: str, low: float, high: float, bins: int) -> DataFrame:
    """Counts per equal-width bin; bin 0 is below ``low`` and bin ``bins`` + 1 is at or above ``high``."""
    bin_ = F.width_bucket(F.col(column), F.lit(float(low)), F.lit(float(high)), F.lit(bins))
    return df.groupBy(bin_.cast("bigint").alias("bin")).agg(
        F.count(F.lit(1)).alias("n"), F.min(column).alias("min_value"), F.max(column).alias("max_value")
    )

"""Shards, batches and padding on top of a global row index."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from clickloom.functions.categorical import hash_text
from clickloom.operators.order import uniform_bounds, with_row_index
from clickloom.session import shuffle_partitions

HASH_LIMIT = {"md5": 2**60, "xxhash64": 2**62}


def seeded_shuffle(df: DataFrame, row_id: str, seed: int = 123, out: str = "position", method: str = "md5") -> DataFrame:
    """Position of each row in a random order that depends only on the seed and the row id."""
    bounds = uniform_bounds(0, HASH_LIMIT[method], shuffle_partitions(df.sparkSession))
    drawn = df.withColumn("_draw", hash_text(F.concat(F.lit(f"{seed}:"), F.col(row_id).cast("string")), method))
    return with_row_index(drawn, "_draw", out, bounds, ties=(row_id,)).drop("_draw")


def shard(df: DataFrame, workers: int, index: int, row_index: str = "row_index") -> DataFrame:
    """The rows that worker ``index`` of ``workers`` reads."""
    return df.where(F.col(row_index) % workers == index)


def batch_ids(df: DataFrame, size: int, row_index: str = "row_index", out: str = "batch_id") -> DataFrame:
    return df.withColumn(out, F.floor(F.col(row_index) / F.lit(size)).cast("bigint"))


def padded_batch(df: DataFrame, columns: dict[str, object], batch_id: str = "batch_id") -> DataFrame:
    """Pad array columns with the given value to the longest array of their batch."""
    batch = Window.partitionBy(batch_id)
    padded = df
    for name, fill in columns.items():
        longest = F.max(F.size(name)).over(batch)
        padded = padded.withColumn("_longest", longest).withColumn(
            name, F.concat(F.col(name), F.array_repeat(F.lit(fill), F.col("_longest") - F.size(name)))
        )
    return padded.drop("_longest")


def positional_join(left: DataFrame, right: DataFrame, left_key: str, right_key: str) -> DataFrame:
    """Pair the i-th row of one table with the i-th row of another, up to the shorter one."""
    return with_row_index(left, left_key).join(with_row_index(right, right_key), "row_index")

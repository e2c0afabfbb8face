"""Down-sampling of the negative class."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clickloom.functions.categorical import hash_text

RESOLUTION = 1_000_000
# Slices of the hash space that an exact sample counts, as a power of two.
SLICE_BITS = 12
_HASH_BITS = {"md5": 60, "xxhash64": 62}


def downsample(df: DataFrame, label: str, row_id: str, keep: float, seed: int = 0, method: str = "md5") -> DataFrame:
    """Keep all positives and a ``keep`` share of the rest, decided by a hash of seed and row id.

    The decision is a plain filter: no shuffle, and the same rows survive when a task runs again.
    """
    return df.where((F.col(label) == 1) | keep_row(F.col(row_id), keep, seed, method))


def keep_row(row_id: Column, keep: float, seed: int = 0, method: str = "md5") -> Column:
    draw = hash_text(F.concat(F.lit(f"{seed}:"), row_id.cast("string")), method) % RESOLUTION
    return draw < int(round(keep * RESOLUTION))


def bottom_k(df: DataFrame, strata: list[str], row_id: str, wanted: Column, seed: int = 0, method: str = "md5") -> DataFrame:
    """Of each stratum exactly the ``wanted`` rows with the smallest hash of seed and row id (all, if there are fewer).

    ``wanted`` is a column over the stratum's columns and ``n``, its number of rows. The sample is uniform without
    replacement, has an exact size, and doesn't depend on partitions or on tasks that run again. Rows are counted per
    stratum and slice of the hash space on the map side; whole slices are in or out, and only the one slice in
    which a stratum's sample ends is ordered, so no stratum meets in one task. Equal hashes go by the row id.
    """
    draw = hash_text(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(row_id).cast("string"), F.lit(""))), method)
    drawn = df.withColumns({"_draw": draw, "_slice": F.shiftright(draw, _HASH_BITS[method] - SLICE_BITS).cast("int")})
    keys = {f"_stratum_{i}": F.struct(F.col(c).isNull().alias("absent"), F.col(c).alias("value")) for i, c in enumerate(strata)}
    drawn = drawn.withColumns(keys)
    slices = drawn.groupBy(*keys, "_slice").agg(F.count(F.lit(1)).alias("_held"))
    own = Window.partitionBy(*keys)
    below = F.sum("_held").over(own.orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1))
    told = slices.withColumns({"n": F.sum("_held").over(own), "_below": F.coalesce(below, F.lit(0))})
    told = told.withColumns({c: F.col(f"_stratum_{i}")["value"] for i, c in enumerate(strata)}).withColumn("_wanted", wanted.cast("bigint"))
    # A row for each stratum: the slice in which its sample ends, and how many rows of it belong to the sample.
    ends = told.where("_below < _wanted").groupBy(*keys).agg(F.max(F.struct("_slice", (F.col("_wanted") - F.col("_below")).alias("_rest"), "_held")).alias("_end"))
    met = drawn.join(ends, list(keys))
    inside = met.where((F.col("_slice") < F.col("_end._slice")) | ((F.col("_slice") == F.col("_end._slice")) & (F.col("_end._rest") >= F.col("_end._held"))))
    edge = met.where((F.col("_slice") == F.col("_end._slice")) & (F.col("_end._rest") < F.col("_end._held")))
    ranked = edge.withColumn("_rank", F.row_number().over(Window.partitionBy(*keys, "_slice").orderBy("_draw", row_id)))
    cut = ranked.where(F.col("_rank") <= F.col("_end._rest"))
    return inside.select(*df.columns).unionAll(cut.select(*df.columns))


def downsample_exact(df: DataFrame, label: str, row_id: str, keep: float, seed: int = 0, method: str = "md5") -> DataFrame:
    """All positives, and of the other rows exactly the rounded ``keep`` share, drawn at random without replacement.

    As in ``downsample`` every label but 1, a missing one included, belongs to the rest.
    """
    rest = df.withColumn("_rest", F.coalesce(F.col(label) == 1, F.lit(False)))
    wanted = F.when(F.col("_rest"), F.col("n")).otherwise(F.round(F.col("n") * F.lit(keep)))
    return bottom_k(rest, ["_rest"], row_id, wanted, seed, method).drop("_rest")

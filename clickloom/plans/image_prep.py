"""Image recipes for training and evaluation.

Input tables have ``row_id``, ``pixels`` (flat height-width-channel), ``height`` and ``width``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clickloom.functions import images as im
from clickloom.operators.resize import aspect_resize

RESIZE_SIDE = (256, 512)


def prepare_for_train(
    df: DataFrame,
    channels: int,
    out_height: int,
    out_width: int,
    means: tuple[float, ...],
    sides: tuple[int, int] = RESIZE_SIDE,
    seed: int = 0,
    row_id: str = "row_id",
) -> DataFrame:
    """Random scale, random crop, random flip, mean subtraction."""
    low, high = sides
    shortest = im.draw(seed, "side", F.col(row_id), high - low + 1) + low
    scaled = aspect_resize(df, "pixels", F.col("height"), F.col("width"), channels, shortest)
    cropped = scaled.withColumn(
        "pixels",
        im.random_crop(F.col("pixels"), F.col("height"), F.col("width"), channels, out_height, out_width, F.col(row_id), seed),
    )
    flipped = im.random_flip(F.col("pixels"), out_height, out_width, channels, F.col(row_id), seed)
    return _sized(cropped.withColumn("pixels", im.mean_subtract(flipped, means)), out_height, out_width)


def prepare_for_eval(
    df: DataFrame, channels: int, out_height: int, out_width: int, means: tuple[float, ...], side: int = RESIZE_SIDE[0]
) -> DataFrame:
    """Fixed scale, central crop, mean subtraction."""
    scaled = aspect_resize(df, "pixels", F.col("height"), F.col("width"), channels, side)
    cropped = im.central_crop(F.col("pixels"), F.col("height"), F.col("width"), channels, out_height, out_width)
    return _sized(scaled.withColumn("pixels", im.mean_subtract(cropped, means)), out_height, out_width)


def prepare_custom(
    df: DataFrame, channels: int, height: int, width: int, training: bool, seed: int = 0, row_id: str = "row_id"
) -> DataFrame:
    """Pad by four on each side, crop back at random and flip (training only), then standardise."""
    pixels = F.col("pixels")
    if training:
        padded = df.withColumn("pixels", im.crop_or_pad(pixels, height, width, channels, height + 8, width + 8))
        cropped = padded.withColumn(
            "pixels", im.random_crop(pixels, height + 8, width + 8, channels, height, width, F.col(row_id), seed)
        )
        df = cropped.withColumn("pixels", im.random_flip(pixels, height, width, channels, F.col(row_id), seed))
    return _sized(df.withColumn("pixels", im.standardize(pixels)), height, width)


def _sized(df: DataFrame, height: int, width: int) -> DataFrame:
    return df.withColumns({"height": F.lit(height), "width": F.lit(width)})

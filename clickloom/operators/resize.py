"""Bilinear resizing of image tables in Arrow batches.

A table holds flat (height, width, channel) pixels with their size per row. Images of equal shape in a
batch are resized together by array indexing.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from clickloom.functions.images import aspect_size


# Spark bounds the bytes of incoming batches; this bounds outgoing ones, which may be enlarged.
OUTPUT_BYTES = 64 << 20


def bilinear(images: np.ndarray, new_height: int, new_width: int) -> np.ndarray:
    """Resize (n, h, w, c) images; sample (y, x) reads the source at (y*h/new_h, x*w/new_w)."""
    _, height, width, _ = images.shape
    y0, y1, dy = _neighbours(height, new_height)
    x0, x1, dx = _neighbours(width, new_width)
    dy, dx = dy[None, :, None, None], dx[None, None, :, None]
    upper, lower = images[:, y0], images[:, y1]
    top = upper[:, :, x0] + (upper[:, :, x1] - upper[:, :, x0]) * dx
    bottom = lower[:, :, x0] + (lower[:, :, x1] - lower[:, :, x0]) * dx
    return top + (bottom - top) * dy


def resize(df: DataFrame, pixels: str, height: Column, width: Column, channels: int, new_height: Column, new_width: Column) -> DataFrame:
    """Replace ``pixels`` by the resized image and set the columns ``height`` and ``width``."""
    keep = [c for c in df.columns if c not in (pixels, "height", "width")]
    source = df.select(
        *keep,
        F.col(pixels).cast(T.ArrayType(T.DoubleType())).alias("_pixels"),
        *[c.cast("int").alias(n) for n, c in (("_h", height), ("_w", width), ("_nh", new_height), ("_nw", new_width))],
    )
    schema = T.StructType(
        [df.schema[c] for c in keep]
        + [
            T.StructField("height", T.IntegerType()),
            T.StructField("width", T.IntegerType()),
            T.StructField(pixels, T.ArrayType(T.DoubleType())),
        ]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            shapes = np.stack([batch.column(n).to_numpy() for n in ("_h", "_w", "_nh", "_nw")], axis=1)
            for shape in np.unique(shapes, axis=0):
                same = np.flatnonzero((shapes == shape).all(axis=1))
                h, w, nh, nw = (int(v) for v in shape)
                step = max(1, OUTPUT_BYTES // (nh * nw * channels * 8))
                for start in range(0, len(same), step):
                    part = batch.take(pa.array(same[start : start + step]))
                    n = part.num_rows
                    flat = pc.list_flatten(part.column("_pixels")).to_numpy(zero_copy_only=False)
                    resized = bilinear(flat.reshape(n, h, w, channels), nh, nw).ravel()
                    offsets = pa.array(np.arange(n + 1, dtype=np.int32) * (nh * nw * channels))
                    sizes = [pa.array(np.full(n, v, dtype=np.int32)) for v in (nh, nw)]
                    images = pa.ListArray.from_arrays(offsets, pa.array(resized))
                    arrays = [*[part.column(c) for c in keep], *sizes, images]
                    yield pa.RecordBatch.from_arrays(arrays, [*keep, "height", "width", pixels])

    return source.mapInArrow(run, schema)


def resize_to(df: DataFrame, pixels: str, height: Column, width: Column, channels: int, new_height: int, new_width: int) -> DataFrame:
    return resize(df, pixels, height, width, channels, F.lit(new_height), F.lit(new_width))


def aspect_resize(df: DataFrame, pixels: str, height: Column, width: Column, channels: int, shortest: Column | int) -> DataFrame:
    """Resize so that the shortest side is ``shortest``, keeping the ratio of the sides."""
    return resize(df, pixels, height, width, channels, *aspect_size(height, width, shortest))


def _neighbours(size: int, new_size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    position = np.arange(new_size) * (size / new_size)
    low = np.floor(position).astype(int)
    return low, np.minimum(low + 1, size - 1), position - low

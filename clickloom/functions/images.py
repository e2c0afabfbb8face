"""Pixel operations on flat arrays in row-major (height, width, channel) order.

Geometry moves whole rows of pixels by ``slice``, so the number of interpreted steps per image is its
height rather than its pixel count. Heights, widths and offsets may be columns or integers.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from clickloom.functions.arrays import let
from clickloom.functions.categorical import hash_text

# Channel means in 0..255, red green blue, and their blue green red order for rescaled input.
RGB_MEANS = (123.68, 116.78, 103.94)
BGR_MEANS = (103.939, 116.779, 123.68)


def _c(x) -> Column:
    return x if isinstance(x, Column) else F.lit(x)


def _int(x) -> Column:
    return _c(x).cast("int")


def _rows(height) -> Column:
    return F.sequence(F.lit(0), _int(height) - 1)


@F.arrow_udf(T.BinaryType())
def _packed(images: pa.Array) -> pa.Array:
    lengths, flat = _flat(images)
    if flat.null_count:
        raise ValueError("a pixel is null")
    values = flat.to_numpy(zero_copy_only=False)
    if len(values) and not (0 <= values.min() and values.max() <= 255):
        raise ValueError("a pixel is outside 0 to 255")
    offsets = pa.py_buffer(np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32).tobytes())
    bits = pa.py_buffer(np.packbits(images.is_valid().to_numpy(zero_copy_only=False), bitorder="little").tobytes())
    return pa.Array.from_buffers(pa.binary(), len(images), [bits, offsets, pa.py_buffer(values.astype(np.uint8).tobytes())])


def _flat(images: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """Pixels per image, none for a null, and all pixels in a row."""
    return pc.fill_null(pc.list_value_length(images), 0).to_numpy(zero_copy_only=False), images.flatten()


def bytes_of(pixels: Column) -> Column:
    """Pixels 0..255 packed into one binary value per image, whole Arrow buffers at a time; null stays null.

    A null pixel, or one outside that range, is an error.
    """
    return _packed(pixels.cast(T.ArrayType(T.LongType())))


@F.arrow_udf(T.ArrayType(T.IntegerType()))
def _unpacked(values: pa.Array) -> pa.Array:
    lengths = pc.fill_null(pc.binary_length(values), 0).to_numpy(zero_copy_only=False)
    offsets = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32)
    data = values.buffers()[2]
    begin = np.frombuffer(values.buffers()[1], np.int32)[values.offset] if len(values) else 0
    pixels = np.frombuffer(data, np.uint8, int(offsets[-1]), int(begin)) if data is not None and offsets[-1] else np.zeros(0, np.uint8)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(pixels.astype(np.int32)), mask=values.is_null())


def pixels_of(data: Column) -> Column:
    """The unsigned bytes of a binary value as an array of integers, decoded per Arrow batch; null stays null."""
    return _unpacked(data)


def chw_to_hwc(pixels: Column, height, width, channels: int, element: str = "int") -> Column:
    """Reorder depth-major pixels so that the channels of a pixel are adjacent.

    Whole Arrow batches are moved by their positions, one pattern for each size of image, so heights and widths may
    differ from row to row and null pixels are kept. Positions that an image lacks are null; a null image stays
    null, as does one without a size. ``element`` is the type of a pixel.
    """

    @F.arrow_udf(f"array<{element}>")
    def move(images: pa.Array, heights: pa.Array, widths: pa.Array) -> pa.Array:
        lengths, flat = _flat(images)
        begins = np.cumsum(lengths) - lengths
        known = images.is_valid().to_numpy(zero_copy_only=False) & heights.is_valid().to_numpy(zero_copy_only=False) & widths.is_valid().to_numpy(zero_copy_only=False)
        planes = np.where(known, pc.fill_null(pc.multiply(heights, widths), 0).to_numpy(zero_copy_only=False), 0).astype(np.int64)
        sizes = planes * channels
        starts = np.concatenate([[0], np.cumsum(sizes)])
        taken = np.empty(int(starts[-1]), dtype=np.int64)
        for plane in np.unique(planes[planes > 0]):
            mine = np.flatnonzero(planes == plane)
            k = np.arange(plane * channels)
            place = (k % channels) * plane + k // channels
            at = np.where(place[None] < lengths[mine][:, None], begins[mine][:, None] + place[None], -1)
            taken[starts[mine][:, None] + k[None]] = at
        moved = flat.take(pa.array(taken, mask=taken < 0))
        return pa.ListArray.from_arrays(pa.array(starts.astype(np.int32)), moved, mask=pa.array(~known))

    return move(pixels.cast(f"array<{element}>"), _int(height), _int(width))


def crop(pixels: Column, width, channels: int, top, left, new_height, new_width) -> Column:
    """The window of the given size whose first pixel is (top, left)."""
    stride = _int(width) * channels
    first = _int(top) * stride + _int(left) * channels + 1

    def window(image: Column, start: Column) -> Column:
        return F.flatten(
            F.transform(_rows(new_height), lambda y: F.slice(image, start + y * stride, _int(new_width) * channels))
        )

    return let(pixels, lambda image: let(first, lambda start: window(image, start)))


def checked_crop(pixels: Column, height, width, channels: int, top, left, new_height, new_width) -> Column:
    """Like ``crop``, but an image smaller than the window fails the job."""
    fits = (_int(height) >= _int(new_height)) & (_int(width) >= _int(new_width))
    return F.when(fits, crop(pixels, width, channels, top, left, new_height, new_width)).otherwise(
        F.raise_error(F.lit("an image is smaller than the window cut from it"))
    )


def central_crop(pixels: Column, height, width, channels: int, new_height: int, new_width: int) -> Column:
    top = F.floor((_c(height) - new_height) / 2)
    left = F.floor((_c(width) - new_width) / 2)
    return checked_crop(pixels, height, width, channels, top, left, new_height, new_width)


def draw(seed: int, name: str, row_id: Column, choices) -> Column:
    """A repeatable choice in [0, choices) for a row."""
    text = F.concat(F.lit(f"{seed}:{name}:"), row_id.cast("string"))
    return (hash_text(text, "md5") % _c(choices).cast("bigint")).cast("int")


def random_crop(pixels: Column, height, width, channels: int, new_height: int, new_width: int, row_id: Column, seed: int) -> Column:
    """A window at a random position that depends on the seed and the row id."""
    top = draw(seed, "top", row_id, F.greatest(_c(height) - new_height + 1, F.lit(1)))
    left = draw(seed, "left", row_id, F.greatest(_c(width) - new_width + 1, F.lit(1)))
    return checked_crop(pixels, height, width, channels, top, left, new_height, new_width)


def crop_or_pad(pixels: Column, height: int, width: int, channels: int, new_height: int, new_width: int) -> Column:
    """Centre the image in the new size: cut what is too large, pad what is too small with zeros."""
    cut_h, cut_w = min(height, new_height), min(width, new_width)
    inner = crop(pixels, width, channels, (height - cut_h) // 2, (width - cut_w) // 2, cut_h, cut_w)
    top, left = (new_height - cut_h) // 2, (new_width - cut_w) // 2
    right = new_width - cut_w - left

    def zeros(count: int) -> Column:
        return F.array_repeat(F.lit(0.0), count * channels)

    def row(kept: Column, y: Column) -> Column:
        pixels_of_row = F.slice(kept, (y - top) * cut_w * channels + 1, cut_w * channels)
        inside = (y >= top) & (y < top + cut_h)
        return F.when(inside, F.concat(zeros(left), pixels_of_row, zeros(right))).otherwise(zeros(new_width))

    return let(inner, lambda kept: F.flatten(F.transform(_rows(new_height), lambda y: row(kept, y))))


def flip(pixels: Column, height, width, channels: int) -> Column:
    """Mirror left and right, keeping the channel order of every pixel."""

    def row(image: Column, y: Column) -> Column:
        start = y * _int(width) * channels
        if channels == 1:
            return F.reverse(F.slice(image, start + 1, _int(width)))
        return F.flatten(
            F.transform(
                F.reverse(F.sequence(F.lit(0), _int(width) - 1)),
                lambda x: F.slice(image, start + x * channels + 1, F.lit(channels)),
            )
        )

    return let(pixels, lambda image: F.flatten(F.transform(_rows(height), lambda y: row(image, y))))


def random_flip(pixels: Column, height, width, channels: int, row_id: Column, seed: int) -> Column:
    chosen = draw(seed, "flip", row_id, 2) == 1
    return let(pixels, lambda image: F.when(chosen, flip(image, height, width, channels)).otherwise(image))


def standardize(pixels: Column) -> Column:
    """Zero mean and unit deviation, with the deviation at least 1/sqrt(number of values)."""

    def total(values: Column, term) -> Column:
        return F.aggregate(values, F.lit(0.0), lambda a, x: a + term(x.cast("double")))

    def scaled(image: Column, mean: Column) -> Column:
        n = F.size(image).cast("double")
        spread = F.sqrt(total(image, lambda x: (x - mean) * (x - mean)) / n)
        floor = 1 / F.sqrt(n)
        return let(F.greatest(spread, floor), lambda deviation: F.transform(image, lambda x: (x - mean) / deviation))

    return let(
        pixels, lambda image: let(total(image, lambda x: x) / F.size(image), lambda mean: scaled(image, mean))
    )


def mean_subtract(pixels: Column, means: tuple[float, ...]) -> Column:
    """Subtract one mean per channel."""
    per_channel = F.array(*[F.lit(float(m)) for m in means])
    return F.transform(pixels, lambda x, i: x.cast("double") - F.get(per_channel, i % len(means)))


def channel_reorder(pixels: Column, order: tuple[int, ...], factor: float, means: tuple[float, ...]) -> Column:
    """Rescale, put the channels into a new order and subtract the mean of each new channel."""
    n = len(order)
    source = F.array(*[F.lit(o) for o in order])
    shift = F.array(*[F.lit(float(m)) for m in means])

    def value(image: Column, i: Column) -> Column:
        taken = F.get(image, i - i % n + F.get(source, i % n)).cast("double")
        return taken * F.lit(float(factor)) - F.get(shift, i % n)

    return let(pixels, lambda image: F.transform(image, lambda _, i: value(image, i)))


def linear_rescale(pixels: Column, divisor: float = 128.0) -> Column:
    return F.transform(pixels, lambda x: x.cast("double") / F.lit(float(divisor)) - 1)


def aspect_size(height: Column, width: Column, shortest: Column | int) -> tuple[Column, Column]:
    """Size whose shortest side is ``shortest`` and whose other side keeps the ratio, truncated.

    Computed in single precision, so exact ratios may truncate one below the exact product.
    """
    h, w, s = (_c(x).cast("float") for x in (height, width, shortest))
    factor = F.when(h > w, (s / w).cast("float")).otherwise((s / h).cast("float"))
    return (h * factor).cast("float").cast("int"), (w * factor).cast("float").cast("int")

"""Image-table queries: each embedding is an image of 64 values (8x8x1, 4x4x4, 4x16x1 or 16x4x1)."""

from __future__ import annotations

from pyspark.sql import functions as F

from clickloom.functions import images as im
from clickloom.operators import resize
from clickloom.plans import image_prep as recipes
from clickloom.queries.base import PIXELS, md5_sql, pixels, query, rounded, table


def _images(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select(
        "vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("pixels")
    )


def _by_position(df, pixels_="pixels", digits=9):
    exploded = df.select("vec_id", F.posexplode(pixels_).alias("pos", "v"))
    return exploded.select("vec_id", "pos", rounded(F.col("v"), digits).alias("value"))


def _positions(n: int, expression: str, source: str = "embeddings", digits: int = 9) -> str:
    """SQL that evaluates ``expression`` for each output position k of every image."""
    return f"""SELECT vec_id, CAST(k AS INTEGER) AS pos, round(CAST({expression} AS DOUBLE), {digits}) + 0.0 AS value
    FROM {source}, (SELECT unnest(range({n})) AS k)"""


@query(
    "chw_to_hwc",
    f"""WITH p AS (SELECT vec_id, {PIXELS} AS px FROM embeddings)
    SELECT vec_id, CAST(k AS INTEGER) AS pos, px[(k % 4) * 16 + k // 4 + 1] AS value FROM p, (SELECT unnest(range(64)) AS k)""",
)
def chw_to_hwc(spark, sf_dir):
    """Bytes to unsigned integers, then depth-major to channel-last."""
    stored = table(spark, sf_dir, "embeddings").select("vec_id", im.bytes_of(pixels(F.col("embedding"))).alias("image"))
    decoded = stored.select("vec_id", im.pixels_of(F.col("image")).alias("planes"))
    moved = decoded.select("vec_id", im.chw_to_hwc(F.col("planes"), 4, 4, 4).alias("pixels"))
    return moved.select("vec_id", F.posexplode("pixels").alias("pos", "value"))


def _bilinear_sql(height: str, width: str, new_height: str, new_width: str, k: str = "k") -> str:
    """Value of output position k of a resized single-channel image ``e``."""
    y, x = f"(({k} // {new_width}) * ({height} / {new_height}::DOUBLE))", f"(({k} % {new_width}) * ({width} / {new_width}::DOUBLE))"
    y0, x0 = f"CAST(floor({y}) AS BIGINT)", f"CAST(floor({x}) AS BIGINT)"
    y1, x1 = f"least({y0} + 1, {height} - 1)", f"least({x0} + 1, {width} - 1)"

    def at(row, column):
        return f"CAST(embedding[{row} * {width} + {column} + 1] AS DOUBLE)"

    top = f"({at(y0, x0)} * (1 - ({x} - {x0})) + {at(y0, x1)} * ({x} - {x0}))"
    bottom = f"({at(y1, x0)} * (1 - ({x} - {x0})) + {at(y1, x1)} * ({x} - {x0}))"
    return f"{top} * (1 - ({y} - {y0})) + {bottom} * ({y} - {y0})"


@query("image_resize", _positions(60, _bilinear_sql("8", "8", "6", "10"), digits=8))
def image_resize(spark, sf_dir):
    resized = resize.resize_to(_images(spark, sf_dir), "pixels", F.lit(8), F.lit(8), 1, 6, 10)
    return _by_position(resized, digits=8)


# Padded from 8 to 12 rows, cut from 8 to 6 columns.
@query(
    "crop_or_pad",
    _positions(
        72, "CASE WHEN k // 6 BETWEEN 2 AND 9 THEN embedding[(k // 6 - 2) * 8 + k % 6 + 1 + 1] ELSE 0 END"
    ),
)
def crop_or_pad(spark, sf_dir):
    images = _images(spark, sf_dir)
    return _by_position(images.withColumn("pixels", im.crop_or_pad(F.col("pixels"), 8, 8, 1, 12, 6)))


def _draw_sql(seed: int, name: str, choices: int) -> str:
    return f"({md5_sql(f"'{seed}:{name}:' || vec_id")} % {choices})"


@query(
    "random_crop",
    _positions(30, f"embedding[({_draw_sql(7, 'top', 4)} + k // 6) * 8 + {_draw_sql(7, 'left', 3)} + k % 6 + 1]"),
)
def random_crop(spark, sf_dir):
    images = _images(spark, sf_dir)
    return _by_position(
        images.withColumn("pixels", im.random_crop(F.col("pixels"), 8, 8, 1, 5, 6, F.col("vec_id"), seed=7))
    )


@query(
    "random_flip",
    _positions(
        64,
        f"CASE WHEN {_draw_sql(7, 'flip', 2)} = 1 THEN embedding[(k // 16) * 16 + (3 - (k % 16) // 4) * 4 + k % 4 + 1] "
        "ELSE embedding[k + 1] END",
    ),
)
def random_flip(spark, sf_dir):
    images = _images(spark, sf_dir)
    return _by_position(images.withColumn("pixels", im.random_flip(F.col("pixels"), 4, 4, 4, F.col("vec_id"), seed=7)))


@query(
    "image_standardize",
    """WITH x AS (SELECT vec_id, unnest(range(64)) AS i, CAST(unnest(embedding) AS DOUBLE) AS v FROM embeddings),
    s AS (SELECT vec_id, avg(v) AS mean, greatest(stddev_pop(v), 1 / sqrt(64.0::DOUBLE)) AS deviation FROM x GROUP BY vec_id)
    SELECT vec_id, CAST(i AS INTEGER) AS pos, round((v - mean) / deviation, 8) + 0.0 AS value FROM x JOIN s USING (vec_id)""",
)
def image_standardize(spark, sf_dir):
    return _by_position(_images(spark, sf_dir).withColumn("pixels", im.standardize(F.col("pixels"))), digits=8)


@query("central_crop", _positions(25, "embedding[(1 + k // 5) * 8 + 1 + k % 5 + 1]"))
def central_crop(spark, sf_dir):
    images = _images(spark, sf_dir)
    return _by_position(images.withColumn("pixels", im.central_crop(F.col("pixels"), 8, 8, 1, 5, 5)))


MEANS = (0.1, -0.2, 0.3, 0.05)


@query("mean_subtract", _positions(64, f"CAST(embedding[k + 1] AS DOUBLE) - {list(MEANS)}[k % 4 + 1]::DOUBLE"))
def mean_subtract(spark, sf_dir):
    return _by_position(_images(spark, sf_dir).withColumn("pixels", im.mean_subtract(F.col("pixels"), MEANS)))


# Three shapes by id: square, wide and tall.
SHAPES = """shapes AS (SELECT *, CASE vec_id % 3 WHEN 0 THEN 8 WHEN 1 THEN 4 ELSE 16 END AS h,
  CASE vec_id % 3 WHEN 0 THEN 8 WHEN 1 THEN 16 ELSE 4 END AS w FROM embeddings)"""
ASPECT_SIZES = f"""{SHAPES}, sizes AS (SELECT *,
  CAST(trunc(CAST(h AS FLOAT) * f) AS INTEGER) AS nh, CAST(trunc(CAST(w AS FLOAT) * f) AS INTEGER) AS nw
  FROM (SELECT *, CAST(CASE WHEN h > w THEN 6 / CAST(w AS DOUBLE) ELSE 6 / CAST(h AS DOUBLE) END AS FLOAT) AS f FROM shapes))"""


def _shaped(spark, sf_dir):
    kind = F.col("vec_id") % 3
    return _images(spark, sf_dir).withColumns(
        {
            "height": F.when(kind == 0, 8).when(kind == 1, 4).otherwise(16),
            "width": F.when(kind == 0, 8).when(kind == 1, 16).otherwise(4),
        }
    )


@query("aspect_size", f"WITH {ASPECT_SIZES} SELECT vec_id, h AS height, w AS width, nh AS new_height, nw AS new_width FROM sizes")
def aspect_size(spark, sf_dir):
    height, width = im.aspect_size(F.col("height"), F.col("width"), 6)
    return _shaped(spark, sf_dir).select("vec_id", "height", "width", height.alias("new_height"), width.alias("new_width"))


@query(
    "aspect_resize",
    f"""WITH {ASPECT_SIZES}, cells AS (SELECT *, unnest(range(nh * nw)) AS k FROM sizes)
    SELECT vec_id, CAST(k AS INTEGER) AS pos, round({_bilinear_sql('h', 'w', 'nh', 'nw')}, 8) + 0.0 AS value FROM cells""",
)
def aspect_resize(spark, sf_dir):
    resized = resize.aspect_resize(_shaped(spark, sf_dir), "pixels", F.col("height"), F.col("width"), 1, 6)
    return _by_position(resized, digits=8)


# Evaluation recipe on the three shapes: shortest side 6, centre 5x5, mean 0.1.
@query(
    "image_prep",
    f"""WITH {ASPECT_SIZES}, cells AS (SELECT *, unnest(range(25)) AS c FROM sizes),
    placed AS (SELECT *, ((nh - 5) // 2 + c // 5) * nw + (nw - 5) // 2 + c % 5 AS k FROM cells)
    SELECT vec_id, CAST(c AS INTEGER) AS pos, round({_bilinear_sql('h', 'w', 'nh', 'nw')} - 0.1, 8) + 0.0 AS value FROM placed""",
)
def image_prep(spark, sf_dir):
    done = recipes.prepare_for_eval(_shaped(spark, sf_dir), 1, 5, 5, (0.1,), side=6)
    return _by_position(done, digits=8)


def _random_window_sql(height: str, width: str, new_height: int, new_width: int) -> str:
    """Offsets and flip of a random window, drawn from the row id."""
    return f"""{md5_sql("'7:top:' || vec_id")} % ({height} - {new_height} + 1) AS top,
      {md5_sql("'7:left:' || vec_id")} % ({width} - {new_width} + 1) AS lft, {_draw_sql(7, 'flip', 2)} AS flipped"""


# Training recipe on the three shapes: shortest side 6 to 9, random 5x5 window, random flip, mean 0.1.
@query(
    "image_prep_train",
    f"""WITH {SHAPES}, sides AS (SELECT *, {_draw_sql(7, 'side', 4)} + 6 AS side FROM shapes),
    sizes AS (SELECT *, CAST(trunc(CAST(h AS FLOAT) * f) AS INTEGER) AS nh, CAST(trunc(CAST(w AS FLOAT) * f) AS INTEGER) AS nw
      FROM (SELECT *, CAST(CAST(side AS DOUBLE) / least(h, w) AS FLOAT) AS f FROM sides)),
    windows AS (SELECT *, {_random_window_sql('nh', 'nw', 5, 5)} FROM sizes),
    cells AS (SELECT *, unnest(range(25)) AS c FROM windows),
    placed AS (SELECT *, (top + c // 5) * nw + lft + CASE WHEN flipped = 1 THEN 4 - c % 5 ELSE c % 5 END AS k FROM cells)
    SELECT vec_id, CAST(c AS INTEGER) AS pos, round({_bilinear_sql('h', 'w', 'nh', 'nw')} - 0.1, 8) + 0.0 AS value FROM placed""",
)
def image_prep_train(spark, sf_dir):
    done = recipes.prepare_for_train(_shaped(spark, sf_dir), 1, 5, 5, (0.1,), sides=(6, 9), seed=7, row_id="vec_id")
    return _by_position(done, digits=8)


# Padded from 8x8 to 16x16, random 8x8 window, random flip, standardised.
@query(
    "image_prep_custom",
    f"""WITH windows AS (SELECT *, {_random_window_sql('16', '16', 8, 8)} FROM embeddings),
    cells AS (SELECT *, unnest(range(64)) AS c FROM windows),
    placed AS (SELECT *, top + c // 8 - 4 AS y, lft + CASE WHEN flipped = 1 THEN 7 - c % 8 ELSE c % 8 END - 4 AS x FROM cells),
    v AS (SELECT vec_id, c, CASE WHEN y BETWEEN 0 AND 7 AND x BETWEEN 0 AND 7
      THEN CAST(embedding[y * 8 + x + 1] AS DOUBLE) ELSE 0.0::DOUBLE END AS v FROM placed),
    s AS (SELECT vec_id, avg(v) AS mean, greatest(stddev_pop(v), 1 / sqrt(64.0::DOUBLE)) AS deviation FROM v GROUP BY vec_id)
    SELECT vec_id, CAST(c AS INTEGER) AS pos, round((v - mean) / deviation, 8) + 0.0 AS value FROM v JOIN s USING (vec_id)""",
)
def image_prep_custom(spark, sf_dir):
    done = recipes.prepare_custom(_images(spark, sf_dir), 1, 8, 8, training=True, seed=7, row_id="vec_id")
    return _by_position(done, digits=8)


@query(
    "channel_reorder",
    """SELECT vec_id, CAST(k AS INTEGER) AS pos,
      round(CAST(embedding[k - k % 4 + [3, 2, 1, 4][k % 4 + 1]] AS DOUBLE) * 255 - [103.939, 116.779, 123.68, 0.0][k % 4 + 1]::DOUBLE, 8) + 0.0 AS value,
      round(CAST(embedding[k + 1] AS DOUBLE) / 128 - 1, 9) + 0.0 AS rescaled
    FROM embeddings, (SELECT unnest(range(64)) AS k)""",
)
def channel_reorder(spark, sf_dir):
    """Red green blue alpha to blue green red alpha, and the linear rescale of the other network."""
    p = F.col("pixels")
    both = F.arrays_zip(
        im.channel_reorder(p, (2, 1, 0, 3), 255.0, (*im.BGR_MEANS, 0.0)).alias("reordered"),
        im.linear_rescale(p).alias("rescaled"),
    )
    exploded = _images(spark, sf_dir).select("vec_id", F.posexplode(both).alias("pos", "both"))
    return exploded.select(
        "vec_id",
        "pos",
        rounded(F.col("both.reordered"), 8).alias("value"),
        rounded(F.col("both.rescaled")).alias("rescaled"),
    )

"""Sources: day directories, text lines, typed decoding, calendars, image records."""

from __future__ import annotations

from pyspark.sql import functions as F

from clickloom.functions import images as im
from clickloom.functions.clean import typed_decode
from clickloom.queries.base import LOG, PIXEL_HEX, PIXELS, impressions, pixels, query, table
from clickloom.session import scratch_path
from clickloom.sinks.logs import write_days, write_tsv
from clickloom.sources import images as image_sources
from clickloom.sources import logs
from clickloom.sources.calendar import date_range as dates_between
from clickloom.sources.calendar import day_text
from clickloom.sources.calendar import trailing_dates as dates_before
from clickloom.spec import Continuous, HashBucket, Identity, ModelSpec

LOG_FIELDS = ["event_id", "dt", "user_id", "event_type", "value", "note"]


def _day_directories(spark, sf_dir):
    """The log as TSV in one directory per day."""
    base = scratch_path(spark, "days")
    rows = impressions(spark, sf_dir).select(*LOG_FIELDS[:-1], F.lit("").alias("note"), F.col("dt").alias("day"))
    write_days(rows, base, "day")
    return base


def _days(spark, sf_dir):
    return [r[0] for r in impressions(spark, sf_dir).select("dt").distinct().orderBy("dt").collect()]


@query(
    "scan_days",
    f"""WITH {LOG} SELECT event_id, dt, user_id, event_type, value, CAST(NULL AS VARCHAR) AS note FROM log""",
)
def scan_days(spark, sf_dir):
    base, days = _day_directories(spark, sf_dir), _days(spark, sf_dir)
    logs.require_days(spark, base, days, "day={day}")
    raw = logs.scan_days(spark, base, days, LOG_FIELDS, "day={day}")
    return raw.withColumns({"event_id": F.col("event_id").cast("bigint"), "value": F.col("value").cast("double")})


def _lines(spark, sf_dir):
    """One tab-separated line per event, ending in an empty field."""
    log = impressions(spark, sf_dir)
    path = scratch_path(spark, "lines")
    log.select(F.concat_ws("\t", "event_id", "user_id", "event_type", "k", F.lit(""))).write.text(path)
    return spark.read.text(path)


@query(
    "split_fields",
    f"""WITH {LOG} SELECT CAST(event_id AS VARCHAR) AS first_field, k AS fourth_field, '' AS last_field,
    5 AS n_fields FROM log""",
)
def split_fields(spark, sf_dir):
    parts = logs.split_fields(_lines(spark, sf_dir))
    field = [F.get("fields", i) for i in range(5)]
    return parts.select(
        field[0].alias("first_field"),
        field[3].alias("fourth_field"),
        field[4].alias("last_field"),
        F.size("fields").alias("n_fields"),
    )


@query(
    "named_columns",
    f"""WITH {LOG} SELECT CAST(event_id AS VARCHAR) AS event_id, user_id, event_type, k, '' AS note,
    CAST(NULL AS VARCHAR) AS absent FROM log""",
)
def named_columns(spark, sf_dir):
    parts = logs.split_fields(_lines(spark, sf_dir))
    return logs.named_columns(parts, ["Event_ID", "USER_ID", "Event_Type", "K", "Note", "Absent"])


DECODE_SPEC = ModelSpec(
    fields=("clk", "event_id", "user_id", "hour", "value", "event_type"),
    features=(HashBucket("user_id", 1000), Identity("hour", 24), Continuous("value")),
)


@query(
    "typed_decode",
    f"""WITH {LOG} SELECT clk, CAST(event_id AS VARCHAR) AS event_id,
      CASE WHEN event_id % 7 = 0 THEN '' ELSE user_id END AS user_id,
      CASE WHEN event_id % 5 = 0 OR event_id % 11 = 0 THEN 0 ELSE hour END AS hour,
      CASE WHEN event_id % 3 = 0 THEN 0.0 ELSE round(CAST(CAST(value AS FLOAT) AS DOUBLE), 3) END AS value,
      CASE WHEN event_id % 13 = 0 THEN '' ELSE event_type END AS event_type
    FROM log""",
)
def typed_decode_query(spark, sf_dir):
    e = F.col("event_id")
    raw = impressions(spark, sf_dir).select(
        F.col("clk").cast("string").alias("clk"),
        e.cast("string").alias("event_id"),
        F.when(e % 7 == 0, "-").otherwise(F.col("user_id")).alias("user_id"),
        F.when(e % 5 == 0, "").when(e % 11 == 0, "x1").otherwise(F.col("hour").cast("string")).alias("hour"),
        F.when(e % 3 == 0, "-").otherwise(F.col("value").cast("string")).alias("value"),
        F.when(e % 13 == 0, "-").otherwise(F.col("event_type")).alias("event_type"),
    )
    path = scratch_path(spark, "raw")
    write_tsv(raw, path)
    read = logs.scan_days(spark, path, [""], list(DECODE_SPEC.fields), "{day}")
    decoded = typed_decode(read, DECODE_SPEC)
    return decoded.withColumn("value", F.round(F.col("value").cast("double"), 3))


@query(
    "trailing_dates",
    """SELECT strftime(d.day, '%Y%m%d') AS day, strftime(d.day - t.i * INTERVAL 1 DAY, '%Y%m%d') AS trailing
    FROM (SELECT DISTINCT CAST(ts AS DATE) AS day FROM events) d, (SELECT unnest(range(7)) AS i) t""",
)
def trailing_dates(spark, sf_dir):
    days = impressions(spark, sf_dir).select("day").distinct()
    return dates_before(days, "day", 7).select(day_text(F.col("day")).alias("day"), day_text(F.col("trailing")).alias("trailing"))


@query(
    "date_range",
    """SELECT strftime(unnest(generate_series(lo, hi, INTERVAL 1 DAY)), '%Y%m%d') AS day
    FROM (SELECT min(CAST(ts AS DATE)) AS lo, max(CAST(ts AS DATE)) AS hi FROM events)""",
)
def date_range(spark, sf_dir):
    limits = impressions(spark, sf_dir).agg(F.min("day").alias("lo"), F.max("day").alias("hi"))
    return dates_between(limits, "lo", "hi").select(day_text(F.col("day")).alias("day"))


@query(
    "default_days",
    """WITH t AS (SELECT max(CAST(ts AS DATE)) AS today FROM events)
    SELECT 'prepare' AS job, strftime(today, '%Y%m%d') AS dt, count(*) AS n_rows FROM t JOIN events ON CAST(ts AS DATE) = today GROUP BY ALL
    UNION ALL SELECT 'load', strftime(today - INTERVAL 1 DAY, '%Y%m%d'), count(*) FROM t JOIN events ON CAST(ts AS DATE) = today - INTERVAL 1 DAY GROUP BY ALL""",
)
def default_days(spark, sf_dir):
    """Rows of the days that jobs take when none is named: today to prepare, yesterday to load; the last day counts as today."""
    log = impressions(spark, sf_dir)
    today = log.agg(F.max("day")).first()[0]
    jobs = [("prepare", d) for d in logs.run_days(today=today)] + [("load", logs.load_day(today=today))]
    wanted = spark.createDataFrame(jobs, "job string, dt string")
    return log.join(F.broadcast(wanted), "dt").groupBy("job", "dt").agg(F.count(F.lit(1)).alias("n_rows"))


@query(
    "missing_days",
    """WITH have AS (SELECT DISTINCT CAST(ts AS DATE) AS day FROM events),
    want AS (SELECT DISTINCT CAST(h.day - t.i * INTERVAL 1 DAY AS DATE) AS day
             FROM have h, (SELECT unnest(range(30)) AS i) t)
    SELECT strftime(day, '%Y%m%d') AS dt FROM want WHERE day NOT IN (SELECT day FROM have)""",
)
def missing_days(spark, sf_dir):
    have = impressions(spark, sf_dir).select("day").distinct()
    want = dates_before(have, "day", 30).select(day_text(F.col("trailing")).alias("dt"))
    return logs.missing_days(want, have.select(day_text(F.col("day")).alias("dt")))


@query("per_file_counts", "SELECT event_type AS directory, count(*) AS n_rows FROM events GROUP BY event_type")
def per_file_counts(spark, sf_dir):
    path = scratch_path(spark, "files")
    table(spark, sf_dir, "events").withColumn("kind", F.col("event_type")).write.partitionBy("kind").parquet(path)
    counts = logs.per_file_counts(spark.read.parquet(path))
    directory = F.regexp_extract("file_path", "kind=([^/]+)/", 1)
    return counts.groupBy(directory.alias("directory")).agg(F.sum("n_rows").alias("n_rows"))


def _hex_lines(spark, sf_dir):
    pixels_hex = F.hex(im.bytes_of(pixels(F.col("embedding"))))
    return table(spark, sf_dir, "embeddings").select(pixels_hex.alias("value"))


@query("image_source", f"SELECT {PIXEL_HEX} AS image_hex, CAST(129 AS BIGINT) AS length FROM embeddings")
def image_source(spark, sf_dir):
    path = scratch_path(spark, "image-files")
    _hex_lines(spark, sf_dir).write.option("maxRecordsPerFile", 1).text(path)
    files = image_sources.image_files(spark, path)
    return files.select(F.trim(F.translate(F.col("image").cast("string"), "\n", "")).alias("image_hex"), "length")


@query("fixed_records", f"SELECT {PIXEL_HEX} AS image_hex, 129 AS n_bytes FROM embeddings")
def fixed_records(spark, sf_dir):
    path = scratch_path(spark, "image-records")
    _hex_lines(spark, sf_dir).write.text(path)
    records = image_sources.fixed_records(spark, path, 129)
    text = F.translate(F.col("image").cast("string"), "\n", "")
    return records.select(text.alias("image_hex"), F.octet_length("image").alias("n_bytes"))


@query(
    "image_table",
    f"""SELECT vec_id, len({PIXELS}) AS n_bytes, CAST(list_sum({PIXELS}) AS BIGINT) AS pixel_sum,
      {PIXELS}[1] AS first_pixel, {PIXELS}[64] AS last_pixel FROM embeddings""",
)
def image_table(spark, sf_dir):
    path = scratch_path(spark, "image-table")
    images = table(spark, sf_dir, "embeddings").select("vec_id", im.bytes_of(pixels(F.col("embedding"))).alias("image"))
    image_sources.write_image_table(images, path)
    decoded = image_sources.read_image_table(spark, path).withColumn("pixels", im.pixels_of(F.col("image")))
    total = F.aggregate("pixels", F.lit(0).cast("bigint"), lambda a, p: a + p)
    return decoded.select(
        "vec_id",
        F.octet_length("image").cast("bigint").alias("n_bytes"),
        total.alias("pixel_sum"),
        F.get("pixels", 0).alias("first_pixel"),
        F.get("pixels", 63).alias("last_pixel"),
    )

"""Registry and the tables that several queries share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from clickloom.functions.clean import is_positive
from clickloom.spec import Continuous, Cross, HashBucket, Identity, ModelSpec, Vocab

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a query, with its SQL where SQL can express it."""

    def register(function):
        if name in QUERIES:
            raise ValueError(f"{name} is registered twice")
        QUERIES[name] = function
        if sql is not None:
            SQL[name] = sql
        return function

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vector_ids(spark: SparkSession, sf_dir: str) -> int:
    """How many ids the table of vectors has."""
    return (table(spark, sf_dir, "embeddings").agg(F.max("vec_id")).first()[0] or 0) + 1


def rounded(c: Column, digits: int = 9) -> Column:
    """Rounded, with a negative zero turned positive."""
    return F.round(c.cast("double"), digits) + F.lit(0.0)


def impressions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The event stream as an impression log with a click label."""
    events = table(spark, sf_dir, "events")
    return events.select(
        "event_id",
        F.to_date("ts").alias("day"),
        F.date_format("ts", "yyyyMMdd").alias("dt"),
        F.hour("ts").alias("hour"),
        F.col("user_id").cast("string").alias("user_id"),
        F.get_json_object("props", "$.k").alias("k"),
        is_positive((F.col("event_type") == "click").cast("int")).cast("int").alias("clk"),
        "event_type",
        "value",
    )


# The same log in SQL, as a common table expression.
LOG = """log AS (
  SELECT event_id, CAST(ts AS DATE) AS day, strftime(ts, '%Y%m%d') AS dt,
         CAST(extract(hour FROM ts) AS INTEGER) AS hour, CAST(user_id AS VARCHAR) AS user_id,
         regexp_extract(props, '"k": ([0-9]+)', 1) AS k,
         CASE WHEN event_type = 'click' THEN 1 ELSE 0 END AS clk, event_type, value
  FROM events)"""

VALUE_BOUNDS = (10.0, 25.0, 50.0, 100.0, 200.0)

EVENT_SPEC = ModelSpec(
    fields=("clk", "event_id", "dt", "user_id", "hour", "k", "event_type", "value"),
    features=(
        HashBucket("user_id", 1000),
        Vocab("k", tuple(str(i) for i in range(100))),
        Identity("hour", 24),
        Continuous("value", "min_max", (0.0, 500.0), VALUE_BOUNDS),
    ),
    crosses=(
        Cross(("user_id", "hour"), 5000),
        Cross(("hour", "value"), 300, deep=False),
        Cross(("k", "hour"), 2000),
    ),
)


def md5_sql(text: str) -> str:
    return f"CAST('0x' || substr(md5({text}), 1, 15) AS BIGINT)"


def bucket_sql(number: str, bounds) -> str:
    return "(" + " + ".join(f"CASE WHEN {number} >= {b} THEN 1 ELSE 0 END" for b in bounds) + ")"


VALUE_BUCKET = bucket_sql("value", VALUE_BOUNDS)

# Wide ids of EVENT_SPEC in SQL: one row per (event, id).
EVENT_IDS = f"""ids AS (
  SELECT event_id, clk, day, unnest([
    {md5_sql('user_id')} % 1000,
    CAST(k AS BIGINT) + 1000,
    CAST(hour AS BIGINT) + 1100,
    CAST({VALUE_BUCKET} AS BIGINT) + 1124,
    {md5_sql("user_id || chr(1) || hour")} % 5000 + 1130,
    {md5_sql(f"hour || chr(1) || {VALUE_BUCKET}")} % 300 + 6130,
    {md5_sql("k || chr(1) || hour")} % 2000 + 6430]) AS idx
  FROM log)"""


def pixels(embedding: Column) -> Column:
    """Embedding values as byte-sized pixels."""
    return F.transform(embedding, lambda x: F.floor((x.cast("double") + 1) * 127.5).cast("int"))


PIXELS = "list_transform(embedding, lambda x: CAST(floor((CAST(x AS DOUBLE) + 1) * 127.5) AS INTEGER))"
PIXEL_HEX = f"array_to_string(list_transform({PIXELS}, lambda p: printf('%02X', p)), '')"

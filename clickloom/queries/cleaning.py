"""Cleaning, projections and row weights."""

from __future__ import annotations

from pyspark.sql import functions as F

from clickloom.functions import clean
from clickloom.queries.base import EVENT_SPEC, LOG, impressions, query, table


@query("label_binarize", "SELECT event_id, event_type = 'click' AS is_click FROM events")
def label_binarize(spark, sf_dir):
    return impressions(spark, sf_dir).select("event_id", clean.is_positive(F.col("clk")).alias("is_click"))


@query("prune_columns", f"WITH {LOG} SELECT clk, user_id, hour, k, value FROM log")
def prune_columns(spark, sf_dir):
    return clean.prune_columns(impressions(spark, sf_dir), EVENT_SPEC)


@query(
    "fill_missing",
    f"""WITH {LOG} SELECT event_id,
      CASE WHEN event_id % 4 IN (0, 1) THEN 'none' ELSE user_id END AS user_id,
      CASE WHEN event_id % 6 = 0 THEN 0.0 ELSE value END AS value FROM log""",
)
def fill_missing(spark, sf_dir):
    e = F.col("event_id")
    holes = impressions(spark, sf_dir).select(
        e,
        F.when(e % 4 == 0, "-").when(e % 4 == 1, "").otherwise(F.col("user_id")).alias("user_id"),
        F.when(e % 6 != 0, F.col("value")).alias("value"),
    )
    return holes.select(
        "event_id",
        clean.fill_missing(F.col("user_id"), "none").alias("user_id"),
        F.coalesce("value", F.lit(0.0)).alias("value"),
    )


URL_TOKENS = "list_filter(string_split(url, '/'), lambda t: t <> '')"


@query(
    "split_multivalue",
    f"SELECT page_id, len({URL_TOKENS}) AS n_tokens, array_to_string({URL_TOKENS}, '|') AS tokens FROM pages",
)
def split_multivalue(spark, sf_dir):
    tokens = clean.split_multivalue(F.col("url"), "/")
    return table(spark, sf_dir, "pages").select(
        "page_id", F.size(tokens).cast("bigint").alias("n_tokens"), F.array_join(tokens, "|").alias("tokens")
    )


@query(
    "scalar_to_array",
    "SELECT event_id, CAST(1 AS BIGINT) AS n_values, value AS first_value FROM events",
)
def scalar_to_array(spark, sf_dir):
    events = table(spark, sf_dir, "events").select("event_id", clean.scalar_to_array(F.col("value")).alias("values"))
    return events.select("event_id", F.size("values").cast("bigint").alias("n_values"), F.get("values", 0).alias("first_value"))


@query(
    "class_weight",
    """SELECT doc_id, CASE WHEN quality = 1 THEN 0.25 ELSE 1.0 END::DOUBLE AS quality_weight,
      CASE WHEN toxic = 1 THEN 7.5 ELSE 0.5 END::DOUBLE AS toxic_weight FROM labels""",
)
def class_weight(spark, sf_dir):
    return table(spark, sf_dir, "labels").select(
        "doc_id",
        clean.class_weight(F.col("quality"), positive=0.25).alias("quality_weight"),
        clean.class_weight(F.col("toxic"), 7.5, 0.5).alias("toxic_weight"),
    )


@query("pred_projection", f"WITH {LOG} SELECT user_id, hour, k, value FROM log")
def pred_projection(spark, sf_dir):
    return clean.prune_columns(impressions(spark, sf_dir), EVENT_SPEC, with_label=False)


@query("select_by_kind", f"WITH {LOG} SELECT event_id, user_id, hour, k, event_type AS unused_event_type FROM log")
def select_by_kind(spark, sf_dir):
    log = impressions(spark, sf_dir)
    unused = [n for n in EVENT_SPEC.names("unused") if n not in ("event_id", "dt")]
    chosen = clean.select_by_kind(log, EVENT_SPEC, "category", keep=("event_id", *unused))
    return chosen.withColumnsRenamed({n: f"unused_{n}" for n in unused})


@query(
    "request_struct",
    f"""WITH {LOG} SELECT event_id, user_id, k, CAST(CAST(hour AS FLOAT) AS DOUBLE) AS hour,
      round(CAST(CAST(value AS FLOAT) AS DOUBLE), 3) AS value FROM log""",
)
def request_struct(spark, sf_dir):
    requests = impressions(spark, sf_dir).select("event_id", clean.request_struct(EVENT_SPEC).alias("request"))
    return requests.select(
        "event_id",
        "request.user_id",
        "request.k",
        F.col("request.hour").cast("double").alias("hour"),
        F.round(F.col("request.value").cast("double"), 3).alias("value"),
    )

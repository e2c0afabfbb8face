"""Sinks: each query writes, reads back and returns what is there."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from clickloom.operators import ftrl, sampling
from clickloom.operators.rates import WINDOWS
from clickloom.plans.prepare import Preparation, prepare_files
from clickloom.queries.base import EVENT_SPEC, LOG, impressions, md5_sql, query, rounded
from clickloom.queries.models import MAX_IDS, _examples, _ftrl_sql, _rounded_state
from clickloom.session import scratch_path
from clickloom.sinks import logs as log_sinks
from clickloom.sinks.models import export_model, load_model
from clickloom.sources import logs

FIELDS = ["clk", "event_id", "dt", "user_id", "hour", "k", "event_type", "value"]
KEEP = 0.5
KEEP_SQL = f"(clk = 1 OR {md5_sql("'0:' || event_id")} % 1000000 < {int(KEEP * 1_000_000)})"


def _decoded(raw):
    return raw.select(
        F.col("event_id").cast("bigint").alias("event_id"),
        F.col("clk").cast("int").alias("clk"),
        "dt",
        F.col("user_id").alias("user_id"),
        F.col("hour").cast("int").alias("hour"),
        F.col("k").alias("k"),
        F.col("value").cast("double").alias("value"),
    )


ALL_ROWS = "SELECT event_id, clk, dt, user_id, hour, k, value"


@query("write_tsv", f"WITH {LOG} {ALL_ROWS} FROM log WHERE {KEEP_SQL}")
def write_tsv(spark, sf_dir):
    """Down-sampled rows in two files, written twice: the second write replaces the first."""
    path = scratch_path(spark, "tsv")
    log = impressions(spark, sf_dir).select(*FIELDS)
    log_sinks.write_tsv(log, path)
    log_sinks.write_tsv(sampling.downsample(log, "clk", "event_id", KEEP), path, files=2)
    return _decoded(logs.scan_days(spark, path, [""], FIELDS, "{day}"))


@query("write_days", f"WITH {LOG} {ALL_ROWS} FROM log WHERE dt <> '20240103' OR clk = 1")
def write_days(spark, sf_dir):
    """One directory per day; one day is written again with its positives only."""
    base = scratch_path(spark, "days")
    log = impressions(spark, sf_dir).select(*FIELDS).withColumn("day", F.col("dt"))
    log_sinks.write_days(log, base, "day")
    log_sinks.write_days(log.where("dt = '20240103' AND clk = 1"), base, "day")
    days = spark.read.schema(logs.text_schema(FIELDS).add("day", "string")).csv(base, sep="\t", quote="")
    return _decoded(days.where(F.col("day") == F.col("dt")))


@query("export_day", f"WITH {LOG} SELECT dt, count(*) AS n_rows, CAST(1 AS BIGINT) AS n_files FROM log GROUP BY dt")
def export_day(spark, sf_dir):
    """One merged file per day."""
    base = scratch_path(spark, "export")
    log = impressions(spark, sf_dir).select(*FIELDS).withColumn("day", F.col("dt"))
    log_sinks.export_days(log, base, "day", "event_id")
    read = logs.per_file_counts(spark.read.text(base))
    day = F.regexp_extract("file_path", "day=([0-9]+)/", 1).alias("dt")
    return read.groupBy(day).agg(F.sum("n_rows").alias("n_rows"), F.count(F.lit(1)).alias("n_files"))


@query("copy_day", f"WITH {LOG} {ALL_ROWS} FROM log")
def copy_day(spark, sf_dir):
    source, target = scratch_path(spark, "raw"), scratch_path(spark, "copied")
    log = impressions(spark, sf_dir).select(*FIELDS).withColumn("day", F.col("dt"))
    log_sinks.write_days(log, source, "day")
    days = [r[0] for r in log.select("day").distinct().orderBy("day").collect()]  # one row per day
    log_sinks.copy_days(spark, source, target, days, "day={day}")
    return _decoded(logs.scan_days(spark, target, days, FIELDS, "day={day}"))


RUN_FEATURES = ("user_id", "hour")
RUN_NAMES = [f"{f}_rate_{k}" for k in WINDOWS for f in RUN_FEATURES]


def _prepared_sql() -> str:
    """The latest day of the log with its trailing rates; the day's window ends with itself."""
    rates = [
        f"""(SELECT avg(h.clk) FROM log h WHERE h.{f} = l.{f} AND h.day BETWEEN l.day - {k - 1} AND l.day)"""
        for k in WINDOWS
        for f in RUN_FEATURES
    ]
    columns = ", ".join(f"round({rate}, 9) AS {name}" for rate, name in zip(rates, RUN_NAMES, strict=True))
    return f"WITH {LOG} SELECT event_id, clk, {columns} FROM log l WHERE day = (SELECT max(day) FROM log) AND {KEEP_SQL}"


def _prepared(spark, sf_dir, with_counts: bool):
    source, target = scratch_path(spark, "raw"), scratch_path(spark, "prepared")
    log = impressions(spark, sf_dir).select(*FIELDS).withColumn("day", F.col("dt"))
    log_sinks.write_days(log, source, "day")
    days = [r[0] for r in log.select("dt").distinct().orderBy("dt").collect()]  # one row per day
    job = Preparation(features=RUN_FEATURES, keep=KEEP)
    counts = None
    if with_counts:
        # Count all days but the last one, as an earlier run would have done; their windows are short.
        counts = scratch_path(spark, "counts")
        earlier = Preparation(features=RUN_FEATURES, windows=(len(days) - 1,), keep=KEEP)
        prepare_files(spark, source, target, days[-2:-1], FIELDS, "event_id", earlier, directory="day={day}", counts=counts)
    prepare_files(spark, source, target, days[-1:], FIELDS, "event_id", job, directory="day={day}", counts=counts)
    done = logs.scan_days(spark, target, days[-1:], [*FIELDS, *RUN_NAMES], "run_dt={day}")
    return done.select(
        F.col("event_id").cast("bigint").alias("event_id"),
        F.col("clk").cast("int").alias("clk"),
        *[rounded(F.col(n)).alias(n) for n in RUN_NAMES],
    )


@query("prepared_files", _prepared_sql())
def prepared_files(spark, sf_dir):
    """The whole daily job on files: 30 day directories in, one prepared directory out."""
    return _prepared(spark, sf_dir, with_counts=False)


@query("prepared_from_counts", _prepared_sql())
def prepared_from_counts(spark, sf_dir):
    """The same with stored daily counts: only the last day is read raw by the last run."""
    return _prepared(spark, sf_dir, with_counts=True)


LATE = "event_id % 7 = 3 AND day < DATE '2024-01-20'"


def _late_sql() -> str:
    """Days by directory: a late row counts for the day after its own, and comes out with it."""
    rate = "(SELECT avg(h.clk) FROM moved h WHERE h.user_id = l.user_id AND h.dir BETWEEN l.dir - 6 AND l.dir)"
    return f"""WITH {LOG}, moved AS (SELECT *, CASE WHEN {LATE} THEN day + 1 ELSE day END AS dir FROM log)
    SELECT event_id, strftime(dir, '%Y%m%d') AS run_dt, CASE WHEN event_id % 11 = 0 THEN '-' ELSE dt END AS dt, round({rate}, 9) AS user_rate
    FROM moved l WHERE dir IN (SELECT DISTINCT dir FROM moved ORDER BY dir DESC LIMIT 12)"""


@query("prepared_late_rows", _late_sql())
def prepared_late_rows(spark, sf_dir):
    """Rows that came a day late and days that can't be parsed: nothing is lost, and directories decide."""
    source, target, counts = (scratch_path(spark, name) for name in ("raw", "prepared", "counts"))
    moved = F.when(F.expr(LATE), F.date_add("day", 1)).otherwise(F.col("day"))
    log = impressions(spark, sf_dir).withColumn("dir", F.date_format(moved, "yyyyMMdd"))
    log = log.withColumn("dt", F.when(F.col("event_id") % 11 == 0, "-").otherwise(F.col("dt")))
    log_sinks.write_days(log.select(*FIELDS, "dir"), source, "dir")
    days = [r[0] for r in log.select("dir").distinct().orderBy("dir").collect()]  # one row per day
    job = Preparation(features=("user_id",), windows=(7,), keep=1.0)
    for run in (days[-18:-12], days[-12:]):
        prepare_files(spark, source, target, run, FIELDS, "event_id", job, directory="dir={day}", counts=counts)
    fields = logs.text_schema([*FIELDS, "user_rate"]).add("run_dt", "string")
    done = spark.read.schema(fields).csv(target, sep="\t", quote="")
    return done.where(F.col("run_dt").isin(days[-12:])).select(
        F.col("event_id").cast("bigint").alias("event_id"), "run_dt", "dt", rounded(F.col("user_rate")).alias("user_rate")
    )


@query("model_export", _ftrl_sql(1).replace("round(w, 7) + 0.0 AS w FROM", "round(w, 7) + 0.0 AS w, 8 AS n_fields FROM"))
def model_export(spark, sf_dir):
    """The latest exported version and the number of fields in the spec stored next to it."""
    base = scratch_path(spark, "model")
    data = _examples(spark, sf_dir)
    export_model(ftrl.empty_state(spark), base, 1, EVENT_SPEC)
    export_model(ftrl.step(data, ftrl.empty_state(spark), max_ids=MAX_IDS), base, 2, EVENT_SPEC)
    stored_spec = json.loads(spark.read.text(f"{base}/_spec/version=2").first()[0])
    return _rounded_state(load_model(spark, base), F.lit(len(stored_spec["fields"])).alias("n_fields"))

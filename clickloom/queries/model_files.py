"""Training, evaluation and prediction that begin and end with files."""

from __future__ import annotations

from pyspark.sql import functions as F

from clickloom.operators import ftrl
from clickloom.plans.model_files import ModelJob, evaluate_files, file_examples, predict_files, train_files
from clickloom.queries.base import EVENT_SPEC, impressions, query, rounded
from clickloom.queries.models import FTRL_INPUT, _evaluation_sql, _ftrl_step_sql, _scored_sql
from clickloom.session import scratch_path
from clickloom.sinks.logs import write_days
from clickloom.sinks.models import export_model

JOB = ModelJob(EVENT_SPEC, "event_id", "day={day}", method="md5")
DAYS = 30  # the days of the given event table


def _log_files(spark, sf_dir, with_label: bool = True) -> tuple[str, list[str]]:
    """The event log as day directories, and its days."""
    base = scratch_path(spark, "log")
    fields = list(EVENT_SPEC.fields) if with_label else EVENT_SPEC.names("all")
    log = impressions(spark, sf_dir).select(*fields, F.col("dt").alias("day"))
    write_days(log, base, "day")
    return base, [r[0] for r in log.select("day").distinct().orderBy("day").collect()]  # one row per day


def _daily_sql() -> str:
    ctes, results = [FTRL_INPUT], []
    for day in range(DAYS - 1):
        here, following = (f"day = DATE '2024-01-01' + {d}" for d in (day, day + 1))
        step = _ftrl_step_sql(day + 1, here).replace(f"s{day + 1} AS (", f"s{day + 1} AS MATERIALIZED (")
        ctes += [step, _scored_sql(day, day + 1, following), _evaluation_sql(day)]
        train, test = f"202401{day + 1:02}", f"202401{day + 2:02}"
        results.append(f"SELECT '{train}' AS train_day, '{test}' AS test_day, metric, value FROM m{day}")
    return f"{', '.join(ctes)} {' UNION ALL '.join(results)}"


@query("train_files", _daily_sql())
def train_from_files(spark, sf_dir):
    """From day directories to a stored model: train on each day, evaluate on the next."""
    base, days = _log_files(spark, sf_dir)
    results = train_files(spark, base, days, JOB, scratch_path(spark, "models"), 1)
    return results.select(
        F.col("train_part").alias("train_day"), F.col("test_part").alias("test_day"), "metric", F.round("value", 6).alias("value")
    )


def _one_pass(spark, sf_dir) -> tuple[str, list[str], str]:
    """Log files with a model that has seen them once, and is followed by a newer version."""
    base, days = _log_files(spark, sf_dir)
    models = scratch_path(spark, "models")
    data = file_examples(spark, base, days, JOB)
    state = ftrl.train(data, max_ids=JOB.max_ids)
    export_model(state, models, 1, EVENT_SPEC)
    export_model(ftrl.train(data, state, max_ids=JOB.max_ids), models, 2, EVENT_SPEC)
    return base, days, models


@query(
    "evaluate_files",
    f"""{FTRL_INPUT}, {_ftrl_step_sql(1)}, {_ftrl_step_sql(2)}, {_scored_sql(0, 2, "true")}, {_evaluation_sql(0)}
    SELECT metric, value FROM m0""",
)
def evaluate_from_files(spark, sf_dir):
    """The latest of two stored versions on all days."""
    base, days, models = _one_pass(spark, sf_dir)
    return evaluate_files(spark, base, days, JOB, models).select("metric", F.round("value", 6).alias("value"))


@query(
    "predict_files",
    f"""{FTRL_INPUT}, {_ftrl_step_sql(1)},
    l AS (SELECT event_id, sum(w) AS z FROM pairs JOIN s1 USING (idx) GROUP BY event_id)
    SELECT event_id, CASE WHEN z > 0 THEN 1 ELSE 0 END AS class_id, round(1 / (1 + exp(-z)), 7) AS probability FROM l""",
)
def predict_from_files(spark, sf_dir):
    """An older version asked for by number, on files without a label; the predictions are read back."""
    _, _, models = _one_pass(spark, sf_dir)
    base, days = _log_files(spark, sf_dir, with_label=False)
    out = scratch_path(spark, "predictions")
    predict_files(spark, base, days, JOB, models, out, version=1)
    read = spark.read.schema("event_id bigint, class_id int, probability double").csv(out, sep="\t")
    return read.select("event_id", "class_id", rounded(F.col("probability"), 7).alias("probability"))

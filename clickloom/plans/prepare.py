"""The daily preparation job: raw logs to down-sampled rows with trailing target rates."""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from clickloom.functions.clean import typed
from clickloom.operators.rates import WINDOWS, attach_rates, daily_counts, trailing_rates
from clickloom.operators.sampling import downsample
from clickloom.session import delete
from clickloom.sinks.logs import write_days
from clickloom.sources.logs import available_days, day_files, day_of_path, days_back, require_days, scan_days


@dataclass(frozen=True)
class Preparation:
    """What to add and what to keep."""

    features: tuple[str, ...] = ()
    windows: tuple[int, ...] = WINDOWS
    keep: float = 0.01
    seed: int = 0
    include_current: bool = True


def prepare(
    log: DataFrame,
    label: str,
    day: str,
    row_id: str,
    job: Preparation,
    run: Column | None = None,
    daily: DataFrame | None = None,
) -> DataFrame:
    """Sampled rows of the run days with the rates of all trailing days.

    ``run`` selects the days to prepare (all by default); ``day`` is a date column. Rates come from
    the full log, or from its stored daily counts when ``daily`` is given. Sampling commutes with the
    lookup, so negatives are dropped before the join and only the kept rows meet the rates.
    """
    selected = log if run is None else log.where(run)
    rows = downsample(selected, label, row_id, job.keep, job.seed)
    if not job.features:
        return rows
    if daily is None:
        daily = daily_counts(log, list(job.features), day, F.col(label) == 1)
    rates = trailing_rates(daily, day, job.windows, job.include_current)
    if run is not None:
        rates = rates.where(run)
    return attach_rates(rows, rates, list(job.features), day, row_id, job.windows)


def prepare_files(
    spark: SparkSession,
    source: str,
    target: str,
    days: list[str],
    fields: list[str],
    row_id: str,
    job: Preparation,
    label: str = "clk",
    directory: str = "{day}",
    counts: str | None = None,
) -> None:
    """Read the trailing days of all run days once, prepare these together, write ``run_dt=<day>`` each.

    A row belongs to the day whose directory holds it, for counts, windows and output alike, so that a
    late or malformed day field neither moves nor loses it; the field is passed on as it is. With a
    ``counts`` folder, daily counts are kept there: a raw day is then read for counting only once, unless
    its files, the label or the fields have changed since, and a daily run reads its own day instead of
    thirty. Stops before any work if an input day is missing.
    """
    history = sorted({d for run_day in days for d in days_back(run_day, max(job.windows))}) if job.features else days
    definition = json.dumps([label, fields, directory])
    uncounted = history
    if counts is not None and job.features:
        present, known = day_files(spark, source, history, directory), _manifest(spark, counts)
        uncounted = _uncounted_days(history, job.features, definition, present, known)
    require_days(spark, source, sorted({*uncounted, *days}), directory)

    def read(wanted: list[str]) -> DataFrame:
        raw = scan_days(spark, source, wanted, fields, directory).withColumn("_dir", day_of_path(directory))
        return raw.withColumn(label, typed(F.col(label), "int")).withColumn("_day", F.to_date("_dir", "yyyyMMdd"))

    def count(wanted: list[str]) -> DataFrame:
        return daily_counts(read(wanted), list(job.features), "_day", F.col(label) == 1)

    daily = None
    if job.features and counts is None:
        daily = count(history)
    elif job.features:
        if uncounted:
            notes = {(d, f): (definition, present[d]) for d in uncounted for f in job.features}
            _store_counts(spark, count(uncounted), counts, notes, known)
        daily = _stored_counts(spark, counts, history, job.features)
    # Rows come from the run days' own directories; the history is read for its counts only.
    done = prepare(read(days), label, "_day", row_id, job, F.col("_day").isin([_iso(d) for d in days]), daily)
    write_days(done.withColumn("run_dt", F.col("_dir")).drop("_day", "_dir"), target, "run_dt")


COUNTS_SCHEMA = "value string, _day date, n bigint, positives bigint, feature string, count_day string"
MANIFEST_SCHEMA = "count_day string, feature string, definition string, files string"

# What the counts of a (day, feature) come from: label, fields and layout, and the day's files.
Manifest = dict[tuple[str, str], tuple[str, str]]


def _manifest(spark: SparkSession, counts: str) -> Manifest:
    if not available_days(spark, counts, ["manifest"]):
        return {}
    rows = spark.read.schema(MANIFEST_SCHEMA).parquet(f"{counts}/manifest").collect()  # days x features
    return {(r["count_day"], r["feature"]): (r["definition"], r["files"]) for r in rows}


def _note(spark: SparkSession, counts: str, known: Manifest) -> None:
    rows = [(*key, *value) for key, value in sorted(known.items())]
    spark.createDataFrame(rows, MANIFEST_SCHEMA).coalesce(1).write.mode("overwrite").parquet(f"{counts}/manifest")


def _uncounted_days(days: list[str], features: tuple[str, ...], definition: str, present: dict[str, str], known: Manifest) -> list[str]:
    """Days whose counts of any feature aren't stored, or are those of other files, fields or labels.

    A day whose raw files are gone keeps its counts.
    """

    def counted(day: str, feature: str) -> bool:
        was = known.get((day, feature))
        return was is not None and was[0] == definition and present.get(day, was[1]) == was[1]

    return [d for d in days if not all(counted(d, f) for f in features)]


def _store_counts(spark: SparkSession, daily: DataFrame, counts: str, notes: Manifest, known: Manifest) -> None:
    """Replace the counts of the days and features in ``notes``.

    A day that has no rows any more must not keep its old counts, so these are deleted first. Their notes
    go before that: a job that ends halfway leaves days that the next one counts again.
    """
    others = {key: value for key, value in known.items() if key not in notes}
    if others != known:
        _note(spark, counts, others)
    delete(spark, [f"{counts}/daily/feature={feature}/count_day={day}" for day, feature in notes])
    dated = daily.withColumn("count_day", F.date_format("_day", "yyyyMMdd")).hint("rebalance", F.col("count_day"))
    dated.write.mode("append").partitionBy("feature", "count_day").parquet(f"{counts}/daily")
    _note(spark, counts, others | notes)


def _stored_counts(spark: SparkSession, counts: str, days: list[str], features: tuple[str, ...]) -> DataFrame:
    stored = spark.read.schema(COUNTS_SCHEMA).parquet(f"{counts}/daily")
    return stored.where(F.col("feature").isin(*features) & F.col("count_day").isin(*days)).drop("count_day")


def _iso(day: str) -> str:
    return f"{day[:4]}-{day[4:6]}-{day[6:]}"

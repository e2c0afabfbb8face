"""Writing day-partitioned, tab-separated logs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from clickloom.sources.logs import day_of_path

_FIRST = T.StructField("_first", T.IntegerType())


def write_tsv(df: DataFrame, path: str, files: int | None = None, delimiter: str = "\t") -> None:
    """Replace ``path`` by tab-separated text.

    ``files`` fixes the number of files; without it Spark balances them by size.
    """
    placed = df.repartition(files) if files else df.hint("rebalance")
    _text(placed.write, delimiter).save(path)


def write_days(df: DataFrame, base: str, day: str = "dt", delimiter: str = "\t") -> None:
    """One directory ``<day>=...`` per day, replacing only the days that are in ``df``.

    Rows of one day are written by as many tasks as its size needs.
    """
    balanced = df.hint("rebalance", F.col(day))
    writer = balanced.write.partitionBy(day).option("partitionOverwriteMode", "dynamic")
    _text(writer, delimiter).save(base)


def export_days(df: DataFrame, base: str, day: str, row_id: str, files: int = 1, delimiter: str = "\t") -> None:
    """``files`` merged files per day, days in parallel and one task per file.

    One merged file is what readers of an export expect, whatever the size of a day; a caller with days that
    one task can't take asks for more files. Rows without a day go to a day directory of their own.
    """
    spark = df.sparkSession
    days = [r[0] for r in df.select(day).distinct().orderBy(day).collect()]  # one row per day
    if not days:
        return
    field = T.StructField("_day", df.schema[day].dataType)
    plan = spark.createDataFrame([(value, i * files) for i, value in enumerate(days)], T.StructType([field, _FIRST]))
    slot = F.col("_first") + F.pmod(F.xxhash64(row_id), F.lit(files)).cast("int")
    same_day = F.col(day).eqNullSafe(F.col("_day"))
    placed = df.join(F.broadcast(plan), same_day).repartitionById(len(days) * files, slot).drop("_day", "_first")
    writer = placed.write.partitionBy(day).option("partitionOverwriteMode", "dynamic")
    _text(writer, delimiter).save(base)


def copy_days(spark: SparkSession, source: str, target: str, days: list[str], directory: str = "{day}") -> None:
    """Copy raw day directories to ``day=<day>`` directories in one job, line by line as they are.

    The day is taken from the path, so rows need not carry it, and lines stay in the tasks that read
    them: nothing is parsed and nothing is shuffled. Every line ends with a newline in the copy.
    """
    raw = spark.read.option("lineSep", "\n").text([f"{source}/{directory.format(day=day)}" for day in days])
    dated = raw.select("value", day_of_path(directory).alias("day"))
    writer = dated.write.partitionBy("day").option("partitionOverwriteMode", "dynamic")
    writer.mode("overwrite").option("lineSep", "\n").text(target)


def _text(writer, delimiter: str):
    return (
        writer.format("csv")
        .mode("overwrite")
        .options(sep=delimiter, quote="", escapeQuotes=False, emptyValue="", nullValue="", header=False)
        .options(ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)
    )

"""Reading day-partitioned, tab-separated logs."""

from __future__ import annotations

from datetime import date, timedelta

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

DAY_FORMAT = "%Y%m%d"


def text_schema(fields: list[str]) -> T.StructType:
    """Every field as nullable text, in file order, with lower-case names."""
    return T.StructType([T.StructField(name.lower(), T.StringType()) for name in fields])


def scan_days(
    spark: SparkSession,
    base: str,
    days: list[str],
    fields: list[str],
    directory: str = "{day}",
    delimiter: str = "\t",
) -> DataFrame:
    """One table from the day directories below ``base``, which ``directory`` names.

    Quotes have no meaning in these logs, and trailing empty fields are kept. Only the listed
    directories are opened and only selected columns are parsed.
    """
    return _csv(spark, fields, delimiter).load([f"{base}/{directory.format(day=day)}" for day in days])


def scan_partitions(spark: SparkSession, base: str, fields: list[str], delimiter: str = "\t") -> DataFrame:
    """One table from ``base/dt=<day>`` directories; filters on ``dt`` prune directories."""
    schema = text_schema(fields).add("dt", T.StringType())
    return _csv(spark, fields, delimiter).schema(schema).load(base)


def day_of_path(directory: str = "{day}") -> Column:
    """The day that the directory of a row's file names, as text."""
    before, after = (f"\\Q{part}\\E" for part in directory.split("{day}"))
    return F.regexp_extract(F.col("_metadata.file_path"), f"/{before}([^/]+){after}/[^/]+$", 1)


def split_fields(lines: DataFrame, line: str = "value", delimiter: str = "\t") -> DataFrame:
    """Replace a text line by the array ``fields`` of its positional fields."""
    parts = F.split(F.col(line), f"\\Q{delimiter}\\E", -1)
    return lines.withColumn("fields", parts).drop(line)


def named_columns(df: DataFrame, fields: list[str], array: str = "fields") -> DataFrame:
    """Positional fields as lower-case named columns; missing trailing fields are null."""
    others = [c for c in df.columns if c != array]
    return df.select(*others, *[F.get(F.col(array), i).alias(name.lower()) for i, name in enumerate(fields)])


def per_file_counts(df: DataFrame) -> DataFrame:
    """Rows per input file. Readers skip names that start with a dot or underscore."""
    return df.groupBy(F.col("_metadata.file_path").alias("file_path")).agg(F.count(F.lit(1)).alias("n_rows"))


def run_days(start: str | None = None, end: str | None = None, today: date | None = None) -> list[str]:
    """Days to prepare, both ends included; today when a limit is not given."""
    if not start or not end:
        return [(today or date.today()).strftime(DAY_FORMAT)]
    first, last = _parse(start), _parse(end)
    return [(first + timedelta(days=i)).strftime(DAY_FORMAT) for i in range((last - first).days + 1)]


def load_day(day: str | None = None, today: date | None = None) -> str:
    """Day to export; yesterday when not given."""
    return day or ((today or date.today()) - timedelta(days=1)).strftime(DAY_FORMAT)


def days_back(day: str, n: int) -> list[str]:
    """``day`` and the n-1 days before it, latest first."""
    return [(_parse(day) - timedelta(days=i)).strftime(DAY_FORMAT) for i in range(n)]


def missing_days(wanted: DataFrame, available: DataFrame, day: str = "dt") -> DataFrame:
    """Wanted days that are not available."""
    return wanted.select(day).distinct().join(available.select(day).distinct(), day, "left_anti")


def available_days(spark: SparkSession, base: str, days: list[str], directory: str = "{day}") -> list[str]:
    """Which of the day directories exist, asked of the file system that holds them in one listing."""
    found = {status.getPath().getName() for status in _glob(spark, base, days, directory)}
    return [day for day in days if directory.format(day=day).rsplit("/", 1)[-1] in found]


def day_files(spark: SparkSession, base: str, days: list[str], directory: str = "{day}") -> dict[str, str]:
    """For each day directory that exists its files by name, size and time of change, as one text."""
    names = {directory.format(day=day).rsplit("/", 1)[-1]: day for day in days}
    found: dict[str, list[str]] = {day: [] for day in available_days(spark, base, days, directory)}
    for status in _glob(spark, base, days, directory, "/*"):
        path = status.getPath()
        listed = f"{path.getName()}:{status.getLen()}:{status.getModificationTime()}"
        found.setdefault(names[path.getParent().getName()], []).append(listed)
    return {day: ",".join(sorted(files)) for day, files in found.items()}


def _glob(spark: SparkSession, base: str, days: list[str], directory: str, below: str = ""):
    if not days:
        return []
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    files = path(base).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    pattern = directory.format(day="{" + ",".join(days) + "}")
    return files.globStatus(path(f"{base}/{pattern}{below}")) or []


def require_days(spark: SparkSession, base: str, days: list[str], directory: str = "{day}") -> None:
    """Fail before any work when an input day is missing."""
    found = set(available_days(spark, base, days, directory))
    absent = [day for day in days if day not in found]
    if absent:
        raise FileNotFoundError(f"no input for {', '.join(absent)} below {base}")


def _csv(spark: SparkSession, fields: list[str], delimiter: str):
    return (
        spark.read.format("csv")
        .schema(text_schema(fields))
        .options(sep=delimiter, quote="", header=False, mode="PERMISSIVE")
    )


def _parse(day: str) -> date:
    return date(int(day[:4]), int(day[4:6]), int(day[6:8]))

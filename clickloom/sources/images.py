"""Image tables: files, fixed-length records and Parquet tables with one binary field."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

RECORD = T.StructType([T.StructField("image", T.BinaryType())])


def image_files(spark: SparkSession, path: str) -> DataFrame:
    """Every file below ``path`` as (file, length, image)."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.select(F.regexp_extract("path", "[^/]+$", 0).alias("file"), "length", F.col("content").alias("image"))


def fixed_records(spark: SparkSession, path: str, length: int) -> DataFrame:
    """Records of ``length`` bytes each, as a table with the binary column ``image``.

    Files are split between tasks at record boundaries, and records go from the file system's reader straight
    into rows, without Python. A file whose size isn't a multiple of ``length`` is an error, an empty one has no records.
    """
    if length <= 0:
        raise ValueError("a record needs at least one byte")
    records = spark.sparkContext._jsc.sc().binaryRecords(path, length, spark.sparkContext._jsc.hadoopConfiguration())
    rows = spark._jsparkSession.createDataset(records, spark._jvm.org.apache.spark.sql.Encoders.BINARY())
    return DataFrame(rows.toDF(), spark).toDF(*RECORD.names)


def write_image_table(df: DataFrame, path: str) -> None:
    """Store a table with a binary ``image`` column, one record per row."""
    df.write.mode("overwrite").parquet(path)


def read_image_table(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)

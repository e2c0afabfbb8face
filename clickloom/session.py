"""Session settings and lineage cutting."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_SETTING = "spark.checkpoint.dir"

# Settings a job wants on a large cluster. AQE sizes shuffle reads and splits skewed sort-merge
# partitions; the parquet settings keep a scan task near 256 MB.
CLUSTER_SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.files.maxPartitionBytes": "256m",
    "spark.sql.sources.partitionOverwriteMode": "dynamic",
    "spark.sql.session.timeZone": "UTC",
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
    "spark.python.sql.dataFrameDebugging.enabled": "false",
}


def local_session(app: str = "clickloom", cores: int | str = 8, shuffle_partitions: int = 8) -> SparkSession:
    """A local session for tests and the benchmark."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    )
    for key, value in CLUSTER_SETTINGS.items():
        if not key.startswith("spark.sql.files"):
            builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors can reach, as named by the cluster in ``spark.checkpoint.dir``.

    Only a local master without that setting gets a fresh temporary folder.
    """
    configured = spark.conf.get(CHECKPOINT_SETTING, None) or spark.sparkContext.getConf().get(CHECKPOINT_SETTING)
    if configured:
        return configured.rstrip("/")
    current = spark.sparkContext.getCheckpointDir()
    if current:
        return current.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError(f"set {CHECKPOINT_SETTING} to a folder shared by all executors")
    created = tempfile.mkdtemp(prefix="clickloom-")
    spark.sparkContext.setCheckpointDir(created)
    return created


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new, unused path below the shared folder."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def staged(df: DataFrame, name: str = "stage") -> DataFrame:
    """Write ``df`` as Parquet below the shared folder and continue from the written table.

    Unlike a checkpoint the copy keeps column pruning and pushed filters. It is deleted by ``discard``,
    or else when the application ends.
    """
    spark = df.sparkSession
    path = temporary(spark, scratch_path(spark, name))
    df.write.option("compression", "zstd").parquet(path)
    table = spark.read.schema(df.schema).parquet(path)
    table._staged_path = path
    return table


def temporary(spark: SparkSession, path: str) -> str:
    """The path, whose files are deleted when the application ends."""
    folder, files = _file_system(spark, path)
    files.deleteOnExit(folder)
    return path


def discard(*tables: DataFrame) -> None:
    """Delete the files of staged tables that nothing reads any more."""
    for table in tables:
        delete(table.sparkSession, [table._staged_path])


def delete(spark: SparkSession, paths: list[str]) -> None:
    """Delete files or folders; those that aren't there are passed over."""
    for path in paths:
        folder, files = _file_system(spark, path)
        files.delete(folder, True)


def _file_system(spark: SparkSession, path: str):
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return folder, folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and continue from the written copy.

    Reliable checkpoint files outlive the executors that wrote them, so an iterative job neither
    grows its plan nor recomputes earlier steps when an executor is lost.
    """
    spark = df.sparkSession
    folder = shared_dir(spark)
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(folder)
    return df.checkpoint(eager=True)

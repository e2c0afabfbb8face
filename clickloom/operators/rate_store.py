"""Rates of many features, stored by feature.

One job computes the rates of all features and writes each feature to a folder of its own, while its rows and
bytes are counted on the way (no second pass finds out how large a feature is). A reader of one feature lists
and reads that feature's files only, so attaching F features reads every rate once, not F times.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql import types as T

from clickloom.session import delete, scratch_path, temporary

_FOLDER = "feature_number"


@dataclass(frozen=True)
class RateStore:
    """A written table of rates; ``rows`` and ``size`` (bytes of categories) are known per feature."""

    path: str
    features: tuple[str, ...]
    schema: T.StructType
    rows: dict[str, int]
    size: dict[str, int]

    @classmethod
    def write(cls, rates: DataFrame, features: list[str], path: str | None = None) -> RateStore:
        """Store ``rates`` (feature, value, ...); without a path in the shared folder, until the application ends.

        Rows of other features are left out; a feature without rows is an empty table.
        """
        spark = rates.sparkSession
        number = F.coalesce(*(F.when(F.col("feature") == f, F.lit(i)) for i, f in enumerate(features)))
        seen = Observation()
        counts = []
        for i in range(len(features)):
            mine = F.col(_FOLDER) == i
            counts.append(F.sum(F.when(mine, 1).otherwise(0)).alias(f"rows_{i}"))
            counts.append(F.sum(F.when(mine, F.octet_length("value")).otherwise(0).cast("bigint")).alias(f"size_{i}"))
        numbered = rates.withColumn(_FOLDER, number).where(F.col(_FOLDER).isNotNull()).drop("feature")
        where = path or temporary(spark, scratch_path(spark, "rates"))
        numbered.observe(seen, *counts).write.mode("overwrite").option("compression", "zstd").partitionBy(_FOLDER).parquet(where)
        found = seen.get
        rows, size = ({f: found.get(f"{what}_{i}") or 0 for i, f in enumerate(features)} for what in ("rows", "size"))
        schema = T.StructType([f for f in numbered.schema.fields if f.name != _FOLDER])
        return cls(where, tuple(features), schema, rows, size)

    def of(self, session, feature: str) -> DataFrame:
        """The rates of one feature; nothing else is listed or read."""
        if not self.rows[feature]:
            return session.createDataFrame([], self.schema)
        return session.read.schema(self.schema).parquet(f"{self.path}/{_FOLDER}={self.features.index(feature)}")

    def small(self, max_rows: int, max_bytes: int) -> set[str]:
        """The features, from the smallest on, that together stay within both bounds."""
        chosen = set()
        for feature in sorted(self.features, key=self.rows.__getitem__):
            max_rows, max_bytes = max_rows - self.rows[feature], max_bytes - self.size[feature]
            if max_rows >= 0 and max_bytes >= 0:
                chosen.add(feature)
        return chosen

    def discard(self, session) -> None:
        delete(session, [self.path])

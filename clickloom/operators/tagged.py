"""Everything a model needs of a row as one stream of tagged pairs, and logits from one aggregation of them.

A pair is (row, branch, idx, value): branch -1 are ids of the sparse model, the others are columns of the dense
input (a number, a hot id, or an id of an embedding table). Weights and vectors are one lookup table keyed by
branch and id, so all branches share one read of the rows, one lookup and one exchange by row.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from clickloom.functions.numeric import scale
from clickloom.operators import lookup
from clickloom.operators.lookup import bounded_lookup
from clickloom.operators.networks import Network, Scorer
from clickloom.operators.sparse import narrow_rows, with_column_ids, with_wide_ids
from clickloom.spec import ModelSpec

WIDE = -1


def tagged_pairs(rows: DataFrame, spec: ModelSpec, row_id: str, wide: bool, deep: bool, first_ids: list[int], method: str, dealt: bool = False) -> DataFrame:
    """(row id, branch, idx, value) of the branches asked for; a row without any keeps one pair without an id.

    ``first_ids`` are ids that every row has in the sparse model, such as its bias. ``dealt`` rows lie by row id.
    """
    columns = {c.name: c for c in [*spec.features, *spec.crosses]}
    slots = spec.deep_slots() if deep else []
    ids = {f"_ids_{i}": columns[s.name] for i, s in enumerate(slots) if s.how != "number"}
    scaled = {f"_number_{i}": scale(F.col(s.name), columns[s.name].scale, columns[s.name].params) for i, s in enumerate(slots) if s.how == "number"}
    used = rows.withColumns(scaled) if scaled else rows
    used = used.repartition(row_id) if dealt else used
    used = with_wide_ids(used, spec, method, "_wide") if wide else used
    used = with_column_ids(used, spec, ids, method) if ids else used

    def pair(branch: int, idx: Column, value: Column) -> Column:
        return F.struct(F.lit(branch).alias("branch"), idx.cast("bigint").alias("idx"), value.cast("double").alias("value"))

    def several(branch: int, name: str) -> Column:
        return F.transform(name, lambda idx: pair(branch, idx, F.lit(1.0)))

    parts = [F.array(*(pair(WIDE, F.lit(i), F.lit(1.0)) for i in first_ids)), several(WIDE, "_wide")] if wide else []
    for i, slot in enumerate(slots):
        parts.append(F.array(pair(i, F.lit(0), F.col(f"_number_{i}"))) if slot.how == "number" else several(i, f"_ids_{i}"))
    pairs = used.select(row_id, F.concat(*parts).alias("_pairs"))
    return pairs.select(row_id, F.inline_outer("_pairs"))


def lookup_table(spec: ModelSpec, weights: DataFrame | None, tables: dict[str, DataFrame] | None) -> tuple[DataFrame | None, int]:
    """(branch, idx, w, vector) for all branches that look something up, and a bound of its size in narrow rows."""
    none = F.lit(None).cast("array<double>").alias("vector")
    parts, bound = [], 0
    if weights is not None:
        parts.append(weights.where(F.col("w") != 0).select(F.lit(WIDE).alias("branch"), "idx", "w", none))
        bound += spec.wide_dimension + 1
    for i, slot in enumerate(spec.deep_slots() if tables is not None else []):
        if slot.how == "embedding":
            vector = F.col("vector").cast("array<double>").alias("vector")
            parts.append(tables[slot.name].select(F.lit(i).alias("branch"), F.col("idx").cast("bigint").alias("idx"), F.lit(None).cast("double").alias("w"), vector))
            size = next(c.size for c in [*spec.features, *spec.crosses] if c.name == slot.name)
            bound += narrow_rows(size, slot.width)
    return (reduce(DataFrame.unionByName, parts) if parts else None), bound


def branch_logits(
    rows: DataFrame,
    spec: ModelSpec,
    row_id: str,
    weights: DataFrame | None,
    networks: list[Network],
    tables: dict[str, DataFrame],
    first_ids: list[int],
    method: str = "xxhash64",
    max_ids: int | None = None,
) -> DataFrame:
    """(row id, wide, deep): the sparse logit and the summed logit of the networks, null for a model without that part.

    ``max_ids`` replaces the spec's bound of the lookup table, for one that is known to be smaller.
    """
    table, bound = lookup_table(spec, weights, tables if networks else None)
    bound = bound if max_ids is None else max_ids
    # If no lookup moves the pairs, rows are dealt before they become pairs with vectors, which are many times larger.
    dealt = table is None or bound <= lookup.BROADCAST_ROWS
    pairs = tagged_pairs(rows, spec, row_id, weights is not None, bool(networks), first_ids if weights is not None else [], method, dealt)
    if table is None:
        found = pairs.select("*", F.lit(None).cast("double").alias("w"), F.lit(None).cast("array<double>").alias("vector"))
    else:
        found = bounded_lookup(pairs, table, ["branch", "idx"], [row_id], bound)
    wide = F.coalesce(F.sum(F.when(F.col("branch") == WIDE, F.col("w"))), F.lit(0.0))
    if not networks:
        return found.groupBy(row_id).agg(wide.alias("wide")).withColumn("deep", F.lit(None).cast("double"))
    # A row has as many pairs as its columns have ids.
    dense = F.collect_list(F.when(F.col("branch") >= 0, F.struct("branch", "idx", "value", "vector")))
    gathered = found.groupBy(row_id).agg(wide.alias("_wide"), dense.alias("_pairs"))
    return _scored(gathered, spec, row_id, networks, weights is not None)


def _scored(gathered: DataFrame, spec: ModelSpec, row_id: str, networks: list[Network], with_wide: bool) -> DataFrame:
    assemble = Assembly(spec)
    scorer = Scorer(gathered.sparkSession, networks)
    schema = T.StructType([gathered.schema[row_id], T.StructField("wide", T.DoubleType()), T.StructField("deep", T.DoubleType())])

    def score(batches):
        for batch in batches:
            if batch.num_rows:
                deep = scorer(assemble(batch.column("_pairs")))[:, 0]
                wide = batch.column("_wide") if with_wide else pa.nulls(batch.num_rows, pa.float64())
                yield pa.RecordBatch.from_arrays([batch.column(row_id), wide, pa.array(deep)], [row_id, "wide", "deep"])

    return gathered.mapInArrow(score, schema)


class Assembly:
    """Dense rows from lists of (branch, idx, value, vector): numbers and counts added, vectors averaged."""

    def __init__(self, spec: ModelSpec):
        slots = spec.deep_slots()
        self.offsets = np.concatenate(([0], np.cumsum([s.width for s in slots]))).astype(np.int64)
        self.widths = {i: s.width for i, s in enumerate(slots) if s.how == "embedding"}

    def __call__(self, pairs: pa.Array) -> np.ndarray:
        dense = np.zeros((len(pairs), int(self.offsets[-1])))
        if not len(pairs):
            return dense
        row = np.repeat(np.arange(len(pairs)), pairs.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))
        flat = pairs.flatten()
        branch, idx, value = (flat.field(n).to_numpy(zero_copy_only=False) for n in ("branch", "idx", "value"))
        vector = flat.field("vector")
        plain = ~np.isin(branch, list(self.widths))
        np.add.at(dense, (row[plain], self.offsets[branch[plain]] + idx[plain].astype(np.int64)), value[plain])
        for slot, width in self.widths.items():
            mine = np.flatnonzero((branch == slot) & vector.is_valid().to_numpy(zero_copy_only=False))
            if len(mine):
                held = vector.take(pa.array(mine)).flatten().to_numpy(zero_copy_only=False).reshape(len(mine), -1)[:, :width]
                total, block = np.bincount(row[mine], minlength=len(pairs)), np.zeros((len(pairs), width))
                np.add.at(block, row[mine], held)
                dense[:, self.offsets[slot] : self.offsets[slot] + width] = block / np.maximum(total, 1)[:, None]
        return dense

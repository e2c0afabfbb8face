"""Versioned model tables: sparse weights, network weights and the feature spec next to them."""

from __future__ import annotations

import json
from dataclasses import asdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clickloom.operators.networks import Network
from clickloom.spec import ModelSpec

NETWORK_SCHEMA = "layer int, input int, units array<double>"


def export_model(state: DataFrame, base: str, version: int, spec: ModelSpec | None = None) -> str:
    """Write the state of a sparse model as a positive version, with its spec as JSON."""
    if version <= 0:
        raise ValueError("a model version must be positive")
    path = f"{base}/version={version}"
    state.write.mode("overwrite").parquet(path)
    if spec is not None:
        text = json.dumps(spec_record(spec), sort_keys=True)
        state.sparkSession.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(
            f"{base}/_spec/version={version}"
        )
    return path


def load_model(spark: SparkSession, base: str, version: int | None = None) -> DataFrame:
    """State of the given version, or of the latest one."""
    models = spark.read.option("basePath", base).parquet(base)
    if version is None:
        version = models.agg(F.max("version")).first()[0]
    return models.where(F.col("version") == version).drop("version")


def spec_record(spec: ModelSpec) -> dict:
    return {
        "fields": list(spec.fields),
        "features": [{"how": type(f).__name__, **asdict(f)} for f in spec.features],
        "crosses": [asdict(c) for c in spec.crosses],
        "multivalue": spec.multivalue,
    }


def feature_spec_rows(spec: ModelSpec) -> list[tuple[str, str, str]]:
    """Parse spec of a scoring request: feature, fixed or variable length, and type."""
    return [
        (n, "variable" if spec.feature(n).kind == "category" else "fixed", spec.field_type(n)) for n in spec.names("used")
    ]


def network_table(spark: SparkSession, network: Network) -> DataFrame:
    """A row per layer and input with the weights to all units; input -1 is the bias.

    The network's own arrays go to Spark as Arrow columns, without an object for each weight.
    """
    layers, inputs, units, sizes = [], [], [], []
    for layer, (kernel, bias) in enumerate([*network.layers, network.output]):
        layers.append(np.full(len(kernel) + 1, layer, dtype=np.int32))
        inputs.append(np.arange(-1, len(kernel), dtype=np.int32))
        units += [bias.astype(np.float64), kernel.astype(np.float64).ravel()]
        sizes.append(np.full(len(kernel) + 1, len(bias)))
    offsets = np.concatenate(([0], np.cumsum(np.concatenate(sizes))))
    lists = pa.LargeListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(units)))
    table = pa.table({"layer": np.concatenate(layers), "input": np.concatenate(inputs), "units": lists.cast(pa.list_(pa.float64()))})
    return spark.createDataFrame(table)


def network_from_table(table: DataFrame, mode: str | list[str], activation: str = "relu") -> Network:
    """Rebuild a network from its weight table, which is as large as the topology says, not as the data.

    A layer without a bias row has zeros there, and inputs without a row have zero weights.
    """
    told = table.select("layer", "input", "units").orderBy("layer", "input").toArrow()
    layer, place = (told[c].to_numpy() for c in ("layer", "input"))
    units = told["units"].combine_chunks()
    pairs = []
    for number in np.unique(layer):
        mine = np.flatnonzero(layer == number)
        weights = units.slice(mine[0], len(mine)).flatten().to_numpy(zero_copy_only=False).reshape(len(mine), -1)
        kernel, bias = np.zeros((place[mine].max() + 1, weights.shape[1])), np.zeros(weights.shape[1])
        for row, at in zip(weights, place[mine], strict=True):
            if at < 0:
                bias = row.copy()
            else:
                kernel[at] = row
        pairs.append((kernel, bias))
    return Network(mode, pairs[:-1], pairs[-1], activation)

"""Training of plain feed-forward networks by mini-batch gradient steps.

Examples lie on the executors, dealt by id once. For an update every task runs its Arrow batches forward and
backward and gives one row with its summed gradient; these rows are added in a tree (groups of about the square
root of their number, then the few group sums on the driver), so what meets in one place is bounded by the network
and not by the data. A task that runs again gives the same sums, as its rows have a fixed order.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clickloom.operators.ftrl import BATCH, placed
from clickloom.operators.networks import Network, forward_layers
from clickloom.session import shuffle_partitions

_SUMS = "task long, loss double, weight double, gradient binary"
# The derivative of an activation, from its input and its output.
_SLOPES = {
    "relu": lambda z, h: (z > 0).astype(z.dtype),
    "sigmoid": lambda z, h: h * (1 - h),
    "tanh": lambda z, h: 1 - h * h,
}


@dataclass(frozen=True)
class Adagrad:
    """Steps of ``rate`` over the root of each weight's summed squares, which start at ``initial``."""

    rate: float = 0.1
    initial: float = 0.1


@dataclass(frozen=True)
class Fit:
    """The network after training, the squares its steps go by, and the average loss before each update."""

    network: Network
    squares: np.ndarray
    losses: list[float]


def start(n_inputs: int, hidden: list[int], activation: str = "relu", seed: int = 0) -> Network:
    """A network of the plain topology with uniform weights in the usual range and no bias."""
    rng = np.random.default_rng(seed)
    widths = [n_inputs, *hidden, 1]
    pairs = []
    for rows, columns in zip(widths, widths[1:], strict=False):
        limit = math.sqrt(6 / (rows + columns))
        pairs.append((rng.uniform(-limit, limit, (rows, columns)), np.zeros(columns)))
    return Network("simple", pairs[:-1], pairs[-1], activation)


def flat(network: Network) -> np.ndarray:
    return np.concatenate([np.concatenate([k.ravel(), b]) for k, b in [*network.layers, network.output]])


def shaped(network: Network, values: np.ndarray) -> Network:
    """The same topology with other weights."""
    pairs, at = [], 0
    for kernel, bias in [*network.layers, network.output]:
        middle, end = at + kernel.size, at + kernel.size + bias.size
        pairs.append((values[at:middle].reshape(kernel.shape), values[middle:end]))
        at = end
    return replace(network, layers=pairs[:-1], output=pairs[-1])


def gradient(network: Network, x: np.ndarray, label: np.ndarray, weight: np.ndarray) -> tuple[float, np.ndarray]:
    """Summed weighted loss of a batch and its gradient, in the order of ``flat``."""
    sums, outputs, z = forward_layers(network, x)
    z = z[:, 0]
    loss = weight * (np.maximum(z, 0) - z * label + np.log1p(np.exp(-np.abs(z))))
    p = np.where(z >= 0, 1 / (1 + np.exp(-np.abs(z))), np.exp(-np.abs(z)) / (1 + np.exp(-np.abs(z))))
    back = (weight * (p - label))[:, None]
    parts, slope = [], _SLOPES[network.activation]
    pairs = [*network.layers, network.output]
    for layer in range(len(pairs) - 1, -1, -1):
        parts.append(np.concatenate([(outputs[layer].T @ back).ravel(), back.sum(0)]))
        if layer:
            back = (back @ pairs[layer][0].T) * slope(sums[layer - 1], outputs[layer])
    return float(loss.sum()), np.concatenate(parts[::-1])


def fit(
    data: DataFrame,
    network: Network,
    epochs: int = 1,
    batches: int = 1,
    opt: Adagrad = Adagrad(),
    squares: np.ndarray | None = None,
) -> Fit:
    """Train on ``data`` (id, label, weight, features) with ``batches`` updates per epoch, each example in one of them.

    Give the ``squares`` of an earlier fit to go on from it. A null label or weight counts as 0, rows without
    features are left out, and an update without examples changes nothing. Only the plain topology without
    normalisation can be trained.
    """
    if network.mode != "simple" or network.norms or network.activation not in _SLOPES:
        raise ValueError("only plain networks without normalisation, with relu, sigmoid or tanh, can be trained")
    squares = np.full(network.n_weights, opt.initial) if squares is None else squares
    used = data.where(F.col("features").isNotNull()).select(
        "id", F.coalesce(F.col("label").cast("double"), F.lit(0.0)).alias("label"), F.coalesce(F.col("weight").cast("double"), F.lit(0.0)).alias("weight"), F.col("features").cast("array<double>").alias("features")
    )
    losses = []
    with placed(used, batches) as rows:
        for _ in range(epochs):
            for batch in range(batches):
                part = rows if batches == 1 else rows.where(F.col(BATCH) == batch)
                loss, weight, total = summed(part.select("label", "weight", "features"), network)
                if weight > 0:
                    step = total / weight
                    squares = squares + step * step
                    network = shaped(network, flat(network) - opt.rate * step / np.sqrt(squares))
                    losses.append(loss / weight)
    return Fit(network, squares, losses)


def summed(rows: DataFrame, network: Network) -> tuple[float, float, np.ndarray]:
    """Loss, weight and gradient over all rows (label, weight, features)."""
    spark = rows.sparkSession
    shared = spark.sparkContext.broadcast(network)

    def run(batches):
        total, loss, weights = np.zeros(shared.value.n_weights), 0.0, 0.0
        for batch in batches:
            if batch.num_rows:
                label, weight = (batch.column(n).to_numpy(zero_copy_only=False) for n in ("label", "weight"))
                x = batch.column("features").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
                own, step = gradient(shared.value, x, label, weight)
                total, loss, weights = total + step, loss + own, weights + float(weight.sum())
        if weights:
            yield _row(TaskContext.get().partitionId(), loss, weights, total)

    tasks = rows.mapInArrow(run, _SUMS)
    groups = max(1, math.isqrt(shuffle_partitions(spark)))  # examples are placed on so many tasks
    parts = tasks.groupBy(F.pmod("task", F.lit(groups)).alias("part")).applyInArrow(_added, _SUMS).collect()  # `groups` rows
    shared.unpersist()
    parts = sorted(parts, key=lambda r: r["task"])
    total = sum((np.frombuffer(r["gradient"]) for r in parts), np.zeros(network.n_weights))
    return sum(r["loss"] for r in parts), sum(r["weight"] for r in parts), total


def _added(rows: pa.Table) -> pa.Table:
    """One row for the sums of a group, added in the order of tasks."""
    told = sorted(rows.to_pylist(), key=lambda r: r["task"])
    total = sum((np.frombuffer(r["gradient"]) for r in told[1:]), np.frombuffer(told[0]["gradient"]).copy())
    return pa.Table.from_batches([_row(told[0]["task"], sum(r["loss"] for r in told), sum(r["weight"] for r in told), total)])


def _row(task: int, loss: float, weight: float, gradient: np.ndarray) -> pa.RecordBatch:
    columns = [pa.array([task], pa.int64()), pa.array([loss]), pa.array([weight]), pa.array([gradient.tobytes()], pa.binary())]
    return pa.RecordBatch.from_arrays(columns, ["task", "loss", "weight", "gradient"])

"""Batch scoring of feed-forward networks.

A network's weights are bounded by its topology, not by the data: they are broadcast to the tasks,
and each Arrow batch is one matrix product per layer. A topology only says which earlier outputs are
concatenated; the layers themselves are all dense -> activation -> normalisation.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

TOPOLOGIES = ("simple", "first_dense", "last_dense", "dense", "resnet")
NORM_EPSILON = 1e-3


@dataclass(frozen=True)
class Norm:
    """Stored moments and affine parameters of inference-time batch normalisation."""

    mean: np.ndarray
    variance: np.ndarray
    gamma: np.ndarray
    beta: np.ndarray


@dataclass(frozen=True)
class Network:
    """``layers`` are (kernel, bias) pairs of the hidden layers, ``output`` the pair of the logits.

    ``mode`` is a topology name or a list of links such as ``["0-1", "0-3"]``, where 0 is the input
    and i-j adds output i to the output of layer j.
    """

    mode: str | list[str]
    layers: list[tuple[np.ndarray, np.ndarray]]
    output: tuple[np.ndarray, np.ndarray]
    activation: str = "relu"
    norms: list[Norm] | None = None

    @property
    def units(self) -> int:
        return self.output[1].shape[0]

    @property
    def n_weights(self) -> int:
        return sum(k.size + b.size for k, b in [*self.layers, self.output])


def parse_links(mode: list[str], n_layers: int) -> dict[int, list[int]]:
    """Earlier outputs added to each layer's output, in ascending order."""
    links: dict[int, list[int]] = {layer: [] for layer in range(1, n_layers + 1)}
    for text in mode:
        source, target = (int(part) for part in text.split("-"))
        if not 0 <= source < target <= n_layers:
            raise ValueError(f"link {text} does not go from an earlier to a later layer")
        links[target].append(source)
    return {target: sorted(sources) for target, sources in links.items()}


def check_mode(mode: str | list[str]) -> None:
    if isinstance(mode, str) and mode not in TOPOLOGIES:
        raise ValueError(f"unknown topology {mode!r}; known: {', '.join(TOPOLOGIES)}")


def layer_inputs(mode: str | list[str], n_inputs: int, hidden: list[int]) -> list[int]:
    """Input width of each hidden layer and, last, of the logits."""
    widths = []

    def record(x, layer):
        widths.append(x.shape[1])
        return np.zeros((1, hidden[layer] if layer < len(hidden) else 1))

    _connect(mode, np.zeros((1, n_inputs)), len(hidden), record)
    return widths


def forward(network: Network, x: np.ndarray) -> np.ndarray:
    """Logits of a batch: one row per input row."""
    act = _NUMPY_ACTIVATIONS[network.activation]
    last = len(network.layers)

    def apply(inputs: np.ndarray, layer: int) -> np.ndarray:
        kernel, bias = network.output if layer == last else network.layers[layer]
        z = inputs @ kernel + bias
        if layer == last:
            return z
        h = act(z)
        if network.norms:
            n = network.norms[layer]
            h = (h - n.mean) / np.sqrt(n.variance + NORM_EPSILON) * n.gamma + n.beta
        return h

    return _connect(network.mode, x, last, apply)


def forward_layers(network: Network, x: np.ndarray) -> tuple[list[np.ndarray], list[np.ndarray], np.ndarray]:
    """Of a plain network without normalisation: each hidden layer's sums, the input and its outputs, and the logits."""
    act, sums, outputs = _NUMPY_ACTIVATIONS[network.activation], [], [x]
    for kernel, bias in network.layers:
        sums.append(outputs[-1] @ kernel + bias)
        outputs.append(act(sums[-1]))
    kernel, bias = network.output
    return sums, outputs, outputs[-1] @ kernel + bias


def broadcast_modes(hidden: list, modes) -> list[tuple[list[int], str | list[str]]]:
    """Pair the hidden units of several nets with their modes; a single mode serves all nets."""
    nets = hidden if isinstance(hidden[0], (list, tuple)) else [hidden]
    single = isinstance(modes, str) or (isinstance(modes[0], str) and "-" in modes[0])
    per_net = [modes] * len(nets) if single else list(modes)
    if len(per_net) != len(nets):
        raise ValueError(f"{len(nets)} networks but {len(per_net)} modes")
    return list(zip(nets, per_net, strict=True))


class Scorer:
    """Networks sent to the executors once; called with a batch, it gives their summed logits."""

    def __init__(self, spark: SparkSession, networks: list[Network]):
        for network in networks:
            check_mode(network.mode)
        self.shared = spark.sparkContext.broadcast(networks)

    def __call__(self, x: np.ndarray) -> np.ndarray:
        return sum(forward(network, x) for network in self.shared.value)


def score_networks(df: DataFrame, networks: list[Network], features: str, keep: list[str], out: str = "logits") -> DataFrame:
    """Add the summed logits of one or more networks to the ``keep`` columns, as an array."""
    scorer = Scorer(df.sparkSession, networks)
    source = df.select(*keep, F.col(features).cast(T.ArrayType(T.DoubleType())).alias("_features"))
    schema = T.StructType([df.schema[name] for name in keep] + [T.StructField(out, T.ArrayType(T.DoubleType()))])

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x = batch.column("_features").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
            logits = scorer(x)
            offsets = pa.array(np.arange(batch.num_rows + 1, dtype=np.int32) * logits.shape[1])
            column = pa.ListArray.from_arrays(offsets, pa.array(np.ascontiguousarray(logits).ravel()))
            yield pa.RecordBatch.from_arrays([*[batch.column(name) for name in keep], column], [*keep, out])

    return source.mapInArrow(score, schema)


def _connect(mode: str | list[str], x: np.ndarray, n_layers: int, apply: Callable) -> np.ndarray:
    """Run ``apply(input, layer)`` for all hidden layers and the logits along a topology."""
    links = None if isinstance(mode, str) else parse_links(mode, n_layers)
    hidden, outputs = [], [x]
    for layer in range(n_layers):
        h = apply(outputs[-1], layer)
        hidden.append(h)
        if mode == "first_dense":
            parts = [h, x]
        elif mode == "dense":
            parts = [x, *hidden]
        elif mode == "resnet":
            parts = [h, outputs[-1]]
        elif links is not None:
            parts = [*[outputs[i] for i in links[layer + 1]], h]
        else:
            parts = [h]
        outputs.append(np.concatenate(parts, axis=1))
    final = np.concatenate([x, *hidden], axis=1) if mode == "last_dense" else outputs[-1]
    return apply(final, n_layers)


def _selu(x):
    from clickloom.functions.numeric import SELU_ALPHA, SELU_SCALE

    return SELU_SCALE * np.where(x < 0, SELU_ALPHA * np.expm1(np.minimum(x, 0)), x)


_NUMPY_ACTIVATIONS = {
    "sigmoid": lambda x: 1 / (1 + np.exp(-x)),
    "tanh": np.tanh,
    "relu": lambda x: np.maximum(x, 0),
    "relu6": lambda x: np.clip(x, 0, 6),
    "leaky_relu": lambda x: np.maximum(x, 0.2 * x),
    "crelu": lambda x: np.concatenate([np.maximum(x, 0), np.maximum(-x, 0)], axis=1),
    "elu": lambda x: np.where(x < 0, np.expm1(np.minimum(x, 0)), x),
    "selu": _selu,
    "softplus": lambda x: np.logaddexp(0, x),
    "softsign": lambda x: x / (1 + np.abs(x)),
}

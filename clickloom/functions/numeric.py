"""Scaling of continuous features and layer activations."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def scale(number: Column, how: str | None, params: tuple[float, float] | None = None) -> Column:
    """Scale with given parameters; missing numbers count as 0."""
    x = F.coalesce(number.cast("double"), F.lit(0.0))
    if how is None:
        return x
    if how == "log":
        return F.log(x)
    first, second = (F.lit(float(p)) for p in params)
    if how == "min_max":
        return (x - first) / (second - first)
    if how == "standard":
        return (x - first) / second
    raise ValueError(f"unknown scaling {how!r}")


def sigmoid(z: Column) -> Column:
    """Logistic function, written so that neither tail overflows."""
    small = F.exp(-F.abs(z))
    return F.when(z >= 0, F.lit(1.0) / (1 + small)).otherwise(small / (1 + small))


# Fixed values of the self-normalising unit and the leaky unit.
SELU_ALPHA = 1.6732632423543772
SELU_SCALE = 1.0507009873554805
LEAKY_SLOPE = 0.2

_ACTIVATIONS = {
    "sigmoid": sigmoid,
    "tanh": F.tanh,
    "relu": lambda x: F.greatest(x, F.lit(0.0)),
    "relu6": lambda x: F.least(F.greatest(x, F.lit(0.0)), F.lit(6.0)),
    "leaky_relu": lambda x: F.greatest(x, F.lit(LEAKY_SLOPE) * x),
    "crelu": lambda x: F.array(F.greatest(x, F.lit(0.0)), F.greatest(-x, F.lit(0.0))),
    "elu": lambda x: F.when(x < 0, F.expm1(x)).otherwise(x),
    "selu": lambda x: F.lit(SELU_SCALE) * F.when(x < 0, F.lit(SELU_ALPHA) * F.expm1(x)).otherwise(x),
    "softplus": lambda x: F.greatest(x, F.lit(0.0)) + F.log1p(F.exp(-F.abs(x))),
    "softsign": lambda x: x / (1 + F.abs(x)),
}

ACTIVATIONS = tuple(_ACTIVATIONS)


def activation(x: Column, name: str) -> Column:
    """A named activation; ``crelu`` yields two values and therefore an array."""
    if name not in _ACTIVATIONS:
        raise ValueError(f"unknown activation {name!r}; known: {', '.join(sorted(_ACTIVATIONS))}")
    return _ACTIVATIONS[name](x.cast("double"))


def embedding_width(size: Column) -> Column:
    """Numbers that represent one of ``size`` ids."""
    return F.pow(F.lit(2.0), F.ceil(F.log(F.pow(size.cast("double"), F.lit(0.25))))).cast("bigint")

"""Logit combination, prediction heads and row losses."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from clickloom.functions.arrays import let
from clickloom.functions.numeric import sigmoid


def joint_logit(model_type: str, wide: Column | None = None, deep: Column | None = None, image: Column | None = None) -> Column:
    """Sum of the logits that ``model_type`` uses; a logit that is not available counts as 0."""
    if model_type not in ("wide", "deep", "joint"):
        raise ValueError(f"unknown model type {model_type!r}")
    parts = []
    if model_type != "deep" and wide is not None:
        parts.append(wide)
    if model_type != "wide" and deep is not None:
        parts.append(deep)
    if image is not None:
        parts.append(image)
    if not parts:
        raise ValueError(f"{model_type} has no logit")
    return reduce(lambda a, b: a + b, [F.coalesce(p.cast("double"), F.lit(0.0)) for p in parts])


def binary_probabilities(logit: Column) -> Column:
    p = sigmoid(logit)
    return F.array(1 - p, p)


def binary_class(logit: Column) -> Column:
    """Class 1 when its probability is above one half."""
    return (logit > 0).cast("int")


def softmax(logits: Column) -> Column:
    def shares(powers: Column) -> Column:
        total = F.aggregate(powers, F.lit(0.0), lambda a, b: a + b)
        return let(total, lambda t: F.transform(powers, lambda e: e / t))

    def powers(z: Column) -> Column:
        return let(F.array_max(z), lambda top: F.transform(z, lambda x: F.exp(x - top)))

    return let(logits, lambda z: let(powers(z), shares))


def argmax(scores: Column) -> Column:
    """Position of the largest score, the first one on ties."""
    return let(scores, lambda s: (F.array_position(s, F.array_max(s)) - 1).cast("int"))


def log_loss(logit: Column, label: Column, weight: Column | None = None) -> Column:
    """Weighted sigmoid cross-entropy of one row, in the form that is stable for large logits."""
    loss = F.greatest(logit, F.lit(0.0)) - logit * label + F.log1p(F.exp(-F.abs(logit)))
    return loss if weight is None else loss * weight

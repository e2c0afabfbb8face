"""Batch scoring: logits to predictions, optionally with a chosen model version."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clickloom.functions.heads import binary_class, binary_probabilities, joint_logit
from clickloom.functions.numeric import sigmoid
from clickloom.operators import ftrl
from clickloom.operators.networks import Network
from clickloom.operators.tagged import branch_logits
from clickloom.sinks.models import load_model
from clickloom.spec import ModelSpec


def predict(df: DataFrame, logit: str, keep: list[str]) -> DataFrame:
    """Class, probabilities and the percentage of the predicted class."""
    z = F.col(logit)
    p = sigmoid(z)
    return df.select(
        *keep,
        binary_class(z).alias("class_id"),
        p.alias("probability"),
        binary_probabilities(z).alias("probabilities"),
        F.round(100 * F.greatest(p, 1 - p), 1).alias("percent"),
    )


def joint_logits(
    rows: DataFrame,
    spec: ModelSpec,
    row_id: str,
    model_type: str = "joint",
    state: DataFrame | None = None,
    networks: list[Network] | None = None,
    tables: dict[str, DataFrame] | None = None,
    method: str = "xxhash64",
    image: DataFrame | None = None,
) -> DataFrame:
    """Logit per row from raw features: sparse weights, networks on the dense input, and image logits.

    ``state`` is the sparse model, ``tables`` the embedding tables of the networks and ``image`` a table
    (row id, image logit). Only what ``model_type`` uses is computed, from one read of the rows.
    """
    weights = state if model_type != "deep" else None
    nets = list(networks or []) if model_type != "wide" else []
    if weights is None and not nets:
        logits = rows.select(row_id, *(F.lit(None).cast("double").alias(n) for n in ("wide", "deep")))
    else:
        logits = branch_logits(rows, spec, row_id, weights, nets, tables or {}, [ftrl.BIAS], method)
    parts = {"wide": F.col("wide"), "deep": F.col("deep")}
    if image is not None:
        logits = logits.join(image.toDF(row_id, "image"), row_id, "left")
        parts["image"] = F.col("image")
    return logits.select(row_id, joint_logit(model_type, **parts).alias("logit"))


def score_version(data: DataFrame, base: str, version: int | None = None, max_ids: int | None = None) -> DataFrame:
    """Predictions of an example table under one exported version."""
    state = load_model(data.sparkSession, base, version)
    return predict(ftrl.score(data, state, max_ids, []), "logit", ["id"])

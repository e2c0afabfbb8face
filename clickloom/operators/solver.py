"""The sparse logistic model fitted by Spark's own solver, and a check of fitted weights."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import CountVectorizerModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clickloom.functions.heads import log_loss
from clickloom.operators import ftrl


def fit(data: DataFrame, n_ids: int, reg: float, mix: float = 0.0, iterations: int = 100) -> DataFrame:
    """Weights (idx, w) that minimise the mean weighted log loss plus an elastic net; zeros are left out.

    ``data`` is an example table. ``reg`` is the strength of the penalty and ``mix`` the share of its
    absolute part; the bias has none. The solver holds a number per id that the spec allows on the
    driver and in each task; specs with more ids than fit there are trained by ``ftrl``.
    """
    names = F.transform(F.filter("ids", lambda i: i != ftrl.BIAS), lambda i: i.cast("string"))
    counted = CountVectorizerModel.from_vocabulary([str(i) for i in range(n_ids)], "names", "features")
    vectors = counted.transform(data.select("label", "weight", names.alias("names")))
    solver = LogisticRegression(
        weightCol="weight", regParam=reg, elasticNetParam=mix, maxIter=iterations, tol=1e-10, standardization=False
    )
    model = solver.fit(vectors)
    weights = model.coefficients.toArray()
    used = np.flatnonzero(weights)
    table = pd.DataFrame({"idx": [ftrl.BIAS, *used], "w": [model.intercept, *weights[used]]})
    return data.sparkSession.createDataFrame(table, "idx bigint, w double")


def excess(data: DataFrame, weights: DataFrame, max_ids: int | None, reg: float, mix: float = 0.0) -> DataFrame:
    """Per id in use (idx, w, excess): how far the slope of the objective of ``fit`` is from what a minimum allows."""
    total = data.agg(F.sum("weight")).first()[0]
    found = ftrl.gradients(data, weights, max_ids).join(weights, "idx", "left")
    w = F.coalesce("w", F.lit(0.0))
    slope = F.col("g") / total + F.when(F.col("idx") == ftrl.BIAS, 0.0).otherwise(reg * (1 - mix) * w)
    bound = F.when(F.col("idx") == ftrl.BIAS, 0.0).otherwise(F.lit(reg * mix))
    beyond = F.when(w == 0, F.greatest(F.abs(slope) - bound, F.lit(0.0))).otherwise(F.abs(slope + bound * F.signum(w)))
    return found.select("idx", w.alias("w"), beyond.alias("excess"))


def gain(data: DataFrame, weights: DataFrame, max_ids: int | None) -> float:
    """How much lower the mean weighted log loss is under the weights than under the best bias alone.

    The losses are subtracted row by row: as a difference of two sums, the rounding of many rows would decide
    about weights that are a bias alone. With one class the best bias has no loss, and nothing is gained.
    """
    total, positive = data.agg(F.sum("weight"), F.sum(F.col("weight") * F.col("label"))).first()
    if not total or not 0 < positive < total:
        return 0.0
    scored = ftrl.score(data, weights, max_ids, ["label", "weight"])
    label, weight = F.col("label"), F.col("weight")
    alone = log_loss(F.lit(math.log(positive / (total - positive))), label, weight)
    return scored.agg(F.sum(alone - log_loss(F.col("logit"), label, weight))).first()[0] / total

"""Evaluation of scored tables.

Every metric aggregates before anything is ordered. The exact curves run over distinct scores in value
ranges (see ``order``); the binned ones need 200 rows whatever the size of the data.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clickloom.functions.heads import argmax, log_loss
from clickloom.functions.numeric import sigmoid
from clickloom.operators.order import range_bounds, with_running_totals
from clickloom.session import staged

THRESHOLDS = 200


def loss_summary(df: DataFrame, logit: str, label: str, weight: str | None = None) -> DataFrame:
    """Total and weighted average cross-entropy."""
    w = F.lit(1.0) if weight is None else F.col(weight)
    total = F.sum(log_loss(F.col(logit), F.col(label), w))
    return df.agg(total.alias("loss_sum"), (total / F.sum(w)).alias("average_loss"))


def accuracy_metrics(df: DataFrame, logit: str, label: str) -> DataFrame:
    """Accuracy, accuracy of always guessing the larger class, mean label and mean prediction."""
    mean = F.avg(F.col(label).cast("double"))
    return df.agg(
        F.avg(((F.col(logit) > 0).cast("int") == F.col(label)).cast("double")).alias("accuracy"),
        F.greatest(mean, 1 - mean).alias("accuracy_baseline"),
        mean.alias("label_mean"),
        F.avg(sigmoid(F.col(logit))).alias("prediction_mean"),
    )


def auc(df: DataFrame, score: str, label: str) -> DataFrame:
    """Exact area under the ROC curve; ties count one half. Null if a class is missing."""
    ranked = _running_classes(df, score, label)
    # Positives above a score, plus half of those that share it, beat its negatives.
    above = F.col("cum_pos") - F.col("pos")
    wins = F.sum(F.col("neg") * (above + F.col("pos") / 2))
    pairs = F.sum("pos").cast("double") * F.sum("neg")
    return ranked.agg((wins / F.nullif(pairs, F.lit(0.0))).alias("auc"))


def auc_pr(df: DataFrame, score: str, label: str) -> DataFrame:
    """Exact area under the precision-recall curve, trapezoids between distinct scores.

    The curve starts at recall 0 with the precision of the highest score. Null without positives.
    """
    ranked = _running_classes(df, score, label)
    tp, seen = F.col("cum_pos"), F.col("cum_pos") + F.col("cum_neg")
    before_tp = tp - F.col("pos")
    before_seen = seen - F.col("pos") - F.col("neg")
    precision = tp / seen
    before = F.when(before_seen == 0, precision).otherwise(before_tp / F.nullif(before_seen, F.lit(0)))
    area = F.sum(F.col("pos") * (precision + before) / 2)
    return ranked.agg((area / F.nullif(F.sum("pos"), F.lit(0))).alias("auc_pr"))


def threshold_bin(probability: Column, thresholds: int = THRESHOLDS) -> Column:
    """How many of the inner thresholds j/(thresholds-1) lie below the probability."""
    steps = thresholds - 1
    return F.least(F.greatest(F.ceil(probability * steps) - 1, F.lit(0)), F.lit(steps - 1)).cast("int")


def evaluate(df: DataFrame, logit: str, label: str, weight: str | None = None) -> DataFrame:
    """All evaluation metrics in one pass, as rows (metric, value).

    One aggregation to at most 199 bins, then everything else on those bins. The curves are
    trapezoids between 200 thresholds.
    """
    w = F.lit(1.0) if weight is None else F.col(weight)
    y = F.col(label).cast("double")
    p = sigmoid(F.col(logit))
    binned = df.groupBy(threshold_bin(p).alias("bin")).agg(
        F.sum(w * y).alias("pos"),
        F.sum(w * (1 - y)).alias("neg"),
        F.sum(log_loss(F.col(logit), y, w)).alias("loss"),
        F.sum(w * ((F.col(logit) > 0).cast("double") == y).cast("double")).alias("hits"),
        F.sum(w * p).alias("predicted"),
        F.count(F.lit(1)).alias("n"),
    )
    down = Window.partitionBy(F.lit(0)).orderBy(F.desc("bin")).rowsBetween(Window.unboundedPreceding, 0)
    curve = binned.withColumns({"tp": F.sum("pos").over(down), "fp": F.sum("neg").over(down)})
    before_tp, before_fp = F.col("tp") - F.col("pos"), F.col("fp") - F.col("neg")
    precision = F.col("tp") / (F.col("tp") + F.col("fp"))
    before = F.when(before_tp + before_fp == 0, precision).otherwise(
        before_tp / F.nullif(before_tp + before_fp, F.lit(0.0))
    )
    pos, neg = F.sum("pos"), F.sum("neg")
    total = pos + neg
    mean = pos / total
    metrics = {
        "accuracy": F.sum("hits") / total,
        "accuracy_baseline": F.greatest(mean, 1 - mean),
        "auc": F.sum(F.col("neg") * (before_tp + F.col("tp")) / 2) / F.nullif(pos * neg, F.lit(0.0)),
        "auc_precision_recall": F.sum(F.col("pos") * (precision + before) / 2) / F.nullif(pos, F.lit(0.0)),
        "average_loss": F.sum("loss") / total,
        "label_mean": mean,
        "loss": F.sum("loss"),
        "n_rows": F.sum("n").cast("double"),
        "prediction_mean": F.sum("predicted") / total,
    }
    wide = curve.agg(*[value.alias(name) for name, value in metrics.items()])
    return wide.select(
        F.inline(F.array(*[F.struct(F.lit(name).alias("metric"), F.col(name).alias("value")) for name in metrics]))
    )


def error_rate(df: DataFrame, scores: Column, label: str) -> DataFrame:
    """Share of rows whose best-scored class is not the label."""
    wrong = (argmax(scores) != F.col(label)).cast("double")
    return df.agg(F.avg(wrong).alias("error_rate"), F.count(F.lit(1)).alias("n"))


def _running_classes(df: DataFrame, score: str, label: str) -> DataFrame:
    """Positives and negatives per distinct score with running totals from the highest score down."""
    positive = (F.col(label) == 1).cast("bigint")
    per_score = df.groupBy(F.col(score).cast("double").alias("score")).agg(
        F.sum(positive).alias("pos"), F.sum(1 - positive).alias("neg")
    )
    stored = staged(per_score, "scores")  # read for the bounds, the range totals and the curve
    totals = {"cum_pos": F.col("pos"), "cum_neg": F.col("neg")}
    return with_running_totals(stored, "score", totals, range_bounds(stored, "score"), descending=True)

"""Training loops of the sparse model: epochs over files, walk-forward over days, versions."""

from __future__ import annotations

from contextlib import ExitStack, contextmanager
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clickloom.operators import ftrl
from clickloom.operators.metrics import evaluate
from clickloom.session import cut_lineage, delete, scratch_path


def evaluation(data: DataFrame, state: DataFrame, max_ids: int | None, weight: str | None = "weight") -> DataFrame:
    """Metrics of a state on an example table."""
    keep = ["label"] if weight is None else ["label", weight]
    return evaluate(ftrl.score(data, state, max_ids, keep), "logit", "label", weight)


@contextmanager
def stage(data: DataFrame, part: str):
    """The examples written once, one directory per part, so that every pass reads only its part.

    The ids of a row are then computed once, however often the row is trained on or evaluated. The
    copy is deleted at the end.
    """
    spark, path = data.sparkSession, scratch_path(data.sparkSession, "examples")
    data.hint("rebalance", F.col(part)).write.partitionBy(part).parquet(path)
    try:
        yield spark.read.schema(data.schema).parquet(path)
    finally:
        delete(spark, [path])


def parts_of(data: DataFrame, part: str) -> list:
    """The parts in order: one row per day or file."""
    return [r[0] for r in data.select(part).distinct().orderBy(part).collect()]


def walk_forward(
    data: DataFrame,
    part: str,
    opt: ftrl.Ftrl = ftrl.Ftrl(),
    epochs: int = 1,
    max_ids: int | None = None,
    state: DataFrame | None = None,
    batches: int = 1,
) -> tuple[DataFrame, DataFrame]:
    """Train on each part in turn and evaluate on the next one, carrying the weights.

    ``data`` is an example table with a ``part`` column (a day or a file). Returns the metrics
    (train_part, test_part, epoch, metric, value) and the final state. An epoch makes ``batches`` updates.
    """
    results = []
    with stage(data, part) as data, ExitStack() as kept:
        parts = parts_of(data, part)
        if len(parts) < 2:
            raise ValueError("walk-forward needs at least two parts")

        def place(value):
            held = kept.enter_context(ExitStack())
            return held, held.enter_context(ftrl.placed(_part(data, part, value), batches))

        # A part is dealt by id once, and evaluated and then trained on as it lies.
        (held, train), rest = place(parts[0]), parts[1:]
        for train_part, test_part in zip(parts, rest, strict=False):
            next_held, test = place(test_part)
            for epoch in range(1, epochs + 1):
                state = ftrl.train_placed(train, state, 1, opt, max_ids, batches)
                labels = {"train_part": F.lit(train_part), "test_part": F.lit(test_part), "epoch": F.lit(epoch)}
                results.append(_labelled(evaluation(test, state, max_ids), labels))
            held.close()
            held, train = next_held, test
    return reduce(DataFrame.unionByName, results), state


def train_parts(
    data: DataFrame,
    part: str,
    opt: ftrl.Ftrl = ftrl.Ftrl(),
    epochs: int = 1,
    max_ids: int | None = None,
    state: DataFrame | None = None,
    batches: int = 1,
) -> DataFrame:
    """Train on every part in order, epoch by epoch, without evaluation."""
    with stage(data, part) as data:
        parts = parts_of(data, part)
        with ftrl.placed(data, batches, (part,)) as rows:
            for _ in range(epochs):
                for p in parts:
                    state = ftrl.train_placed(_part(rows, part, p), state, 1, opt, max_ids, batches)
    return ftrl.empty_state(data.sparkSession) if state is None else state


def epoch_metrics(
    data: DataFrame,
    part: str,
    held_out: Column,
    opt: ftrl.Ftrl = ftrl.Ftrl(),
    epochs: int = 2,
    epochs_per_test: int = 1,
    max_ids: int | None = None,
    state: DataFrame | None = None,
    test: DataFrame | None = None,
    batches: int = 1,
) -> tuple[DataFrame, DataFrame]:
    """Per epoch, train on every part and evaluate after each; test after every few epochs.

    ``held_out`` marks the evaluation rows, and ``test`` is an example table of its own for the
    periodic test (the evaluation rows without one). Returns metrics (epoch, part, metric, value), in
    which the part ``test`` is the periodic test, and the final state.
    """
    results = []
    with stage(data, part) as data:
        train_rows, eval_rows = data.where(~held_out), data.where(held_out).drop(part)
        test = eval_rows if test is None else test
        parts = parts_of(train_rows, part)
        with ftrl.placed(train_rows, batches, (part,)) as rows:
            for epoch in range(1, epochs + 1):
                for p in parts:
                    state = ftrl.train_placed(_part(rows, part, p), state, 1, opt, max_ids, batches)
                    labels = {"epoch": F.lit(epoch), "part": F.lit(str(p))}
                    results.append(_labelled(evaluation(eval_rows, state, max_ids), labels))
                if epoch % epochs_per_test == 0:
                    labels = {"epoch": F.lit(epoch), "part": F.lit("test")}
                    results.append(_labelled(evaluation(test, state, max_ids), labels))
    return reduce(DataFrame.unionByName, results), state


def _part(rows: DataFrame, part: str, value) -> DataFrame:
    return rows.where(F.col(part) == value).drop(part)


def _labelled(metrics: DataFrame, labels: dict[str, Column]) -> DataFrame:
    # A few rows per evaluation; written at once so that later weights cannot grow this plan.
    return cut_lineage(metrics.select(*[c.alias(n) for n, c in labels.items()], "metric", "value"))

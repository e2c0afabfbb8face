"""The sparse model from files to files, and the library solver."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from clickloom.operators import ftrl, solver
from clickloom.plans.model_files import DAY, ModelJob, evaluate_files, file_examples, predict_files, train_files
from clickloom.queries import QUERIES
from clickloom.sinks.models import load_model
from clickloom.spec import Cross, HashBucket, Identity, ModelSpec

SPEC = ModelSpec(
    ("clk", "request", "user", "hour"), (HashBucket("user", 20), Identity("hour", 24)), (Cross(("user", "hour"), 50),)
)
DAYS = ["20240101", "20240102", "20240103"]



@pytest.fixture(scope="module")
def logs(tmp_path_factory):
    """Labelled days, and the same days without labels; one row misses its user, one has no label."""
    random = np.random.default_rng(3)
    labelled, plain = tmp_path_factory.mktemp("labelled"), tmp_path_factory.mktemp("plain")
    for number, day in enumerate(DAYS):
        rows = []
        for i in range(40):
            user, hour = random.integers(6), random.integers(24)
            rows.append([str(int(user % 2 == 0)), f"r{number}-{i}", f"u{user}", str(hour)])
        rows[0][2], rows[1][0] = "-", ""
        for base, first in ((labelled, 0), (plain, 1)):
            (base / day).mkdir()
            (base / day / "part").write_text("".join("\t".join(r[first:]) + "\n" for r in rows))
    return str(labelled), str(plain)


def weights(state):
    return {r["idx"]: r["w"] for r in state.collect()}


def test_files_give_examples_of_their_day(spark, logs):
    data = file_examples(spark, logs[0], DAYS, ModelJob(SPEC, "request", positive=3.0))
    rows = {r["id"]: r for r in data.collect()}
    assert len(rows) == 120 and {r[DAY] for r in rows.values()} == set(DAYS)
    assert len(rows["r0-0"]["ids"]) == 2  # the bias and the hour: no user, no cross
    assert rows["r0-1"]["label"] == 0.0 and rows["r0-1"]["weight"] == 1.0
    assert all(r["weight"] == (3.0 if r["label"] == 1.0 else 1.0) for r in rows.values())
    with pytest.raises(FileNotFoundError):
        file_examples(spark, logs[0], [*DAYS, "20240104"], ModelJob(SPEC, "request"))


def test_training_resumes_and_predicts_without_labels(spark, logs, tmp_path):
    job, models, out = ModelJob(SPEC, "request", epochs=2, batches=2), str(tmp_path / "models"), str(tmp_path / "out")
    results = train_files(spark, logs[0], DAYS, job, models, 1)
    rounds = {(r["train_part"], r["test_part"], r["epoch"]) for r in results.collect()}
    assert rounds == {(a, b, e) for a, b in zip(DAYS, DAYS[1:]) for e in (1, 2)}
    # The last day is only evaluated; the state is that of training on the others by hand.
    want = None
    for day in DAYS[:-1]:
        data = file_examples(spark, logs[0], [day], job).drop(DAY)
        want = ftrl.train(data, want, 2, max_ids=job.max_ids, batches=2)
    assert weights(load_model(spark, models, 1)) == pytest.approx(weights(want))
    train_files(spark, logs[0], DAYS, job, models, 2, resume=1)
    loss = {
        v: {r["metric"]: r["value"] for r in evaluate_files(spark, logs[0], DAYS, job, models, v).collect()}["loss"] for v in (1, 2)
    }
    assert loss[2] < loss[1]
    predict_files(spark, logs[1], DAYS, job, models, out, version=1)
    got = {r["_c0"]: (int(r["_c1"]), float(r["_c2"])) for r in spark.read.csv(out, sep="\t").collect()}
    scored = ftrl.score(file_examples(spark, logs[0], DAYS, job), want, job.max_ids, [])
    assert {r["id"]: 1 / (1 + np.exp(-r["logit"])) for r in scored.collect()} == pytest.approx({i: p for i, (_, p) in got.items()})
    assert all(c == (p > 0.5) for c, p in got.values())


def test_solver_is_at_its_minimum(spark, logs):
    job = ModelJob(SPEC, "request", positive=2.0)
    data = file_examples(spark, logs[0], DAYS, job)
    fitted = solver.fit(data, SPEC.wide_dimension, 0.01, 0.5)
    assert ftrl.BIAS in weights(fitted)
    assert solver.excess(data, fitted, job.max_ids, 0.01, 0.5).agg(F.max("excess")).first()[0] < 1e-5
    moved = fitted.withColumn("w", F.col("w") + 0.1)
    assert solver.excess(data, moved, job.max_ids, 0.01, 0.5).agg(F.max("excess")).first()[0] > 1e-3


@pytest.mark.parametrize("n", [100, 1000, 2000])
def test_a_bias_alone_does_not_beat_itself(spark, tmp_path, n):
    """All events have the same ids, so that no weight helps: rounding of the summed losses must not decide."""
    events = spark.range(n).select(
        F.col("id").alias("event_id"),
        F.lit("2024-01-01 05:00:00").cast("timestamp").alias("ts"),
        F.lit(7).cast("bigint").alias("user_id"),
        F.when(F.col("id") % 5 == 0, "click").otherwise("view").alias("event_type"),
        F.lit(20.0).alias("value"),
        F.lit('{"k": 3}').alias("props"),
    )
    events.coalesce(1).write.parquet(f"{tmp_path}/events.parquet")
    assert [tuple(r) for r in QUERIES["wide_lr_optimum"](spark, str(tmp_path)).collect()] == [(8, True, False)]

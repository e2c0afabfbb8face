"""The sparse model from log files to files: training, evaluation and prediction of day directories."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clickloom.functions.clean import class_weight, typed_decode
from clickloom.operators import ftrl
from clickloom.operators.sparse import with_wide_ids
from clickloom.plans import training
from clickloom.plans.scoring import predict
from clickloom.sinks.logs import write_tsv
from clickloom.sinks.models import export_model, load_model
from clickloom.sources.logs import day_of_path, require_days, scan_days
from clickloom.spec import ModelSpec

DAY = "_day"


@dataclass(frozen=True)
class ModelJob:
    """What files hold and how a model learns from them.

    ``row_id`` names a field without repeats. An unset class weight is 1, and ``batches`` is the number
    of updates that a pass over a day makes.
    """

    spec: ModelSpec
    row_id: str
    directory: str = "{day}"
    delimiter: str = "\t"
    positive: float | None = None
    negative: float | None = None
    method: str = "xxhash64"
    opt: ftrl.Ftrl = ftrl.Ftrl()
    epochs: int = 1
    batches: int = 1

    @property
    def max_ids(self) -> int:
        """The spec allows this many ids, and the bias is one more."""
        return self.spec.wide_dimension + 1


def file_examples(spark: SparkSession, base: str, days: list[str], job: ModelJob, with_label: bool = True) -> DataFrame:
    """Examples (id, label, weight, ids, _day) of day directories, of which all must exist.

    A row belongs to the day whose directory holds it. Files for prediction have no label field; their
    label is null.
    """
    spec = job.spec
    require_days(spark, base, days, job.directory)
    fields = list(spec.fields) if with_label else spec.names("all")
    raw = scan_days(spark, base, days, fields, job.directory, job.delimiter)
    decoded = typed_decode(raw, spec, with_label).withColumn(DAY, day_of_path(job.directory))
    with_ids = with_wide_ids(decoded, spec, job.method, "_ids")
    label = F.col(spec.label) if with_label else F.lit(None).cast("int")
    weight = class_weight(label, job.positive, job.negative)
    return ftrl.examples(with_ids, job.row_id, label, F.col("_ids"), weight, keep=[F.col(DAY)])


def train_files(
    spark: SparkSession, base: str, days: list[str], job: ModelJob, models: str, version: int, resume: int | None = None
) -> DataFrame:
    """Train on each day in turn, evaluate on the next, and store the weights as ``version``.

    ``resume`` names the stored version to go on from. Returns the metrics of every round.
    """
    state = None if resume is None else load_model(spark, models, resume)
    data = file_examples(spark, base, days, job)
    results, state = training.walk_forward(data, DAY, job.opt, job.epochs, job.max_ids, state, job.batches)
    export_model(state, models, version, job.spec)
    return results


def evaluate_files(
    spark: SparkSession, base: str, days: list[str], job: ModelJob, models: str, version: int | None = None
) -> DataFrame:
    """Metrics (metric, value) of a stored version, or the latest, on day directories."""
    return training.evaluation(file_examples(spark, base, days, job), load_model(spark, models, version), job.max_ids)


def predict_files(
    spark: SparkSession, base: str, days: list[str], job: ModelJob, models: str, out: str, version: int | None = None
) -> None:
    """Score day directories without labels and replace ``out`` by (id, class, probability) as text."""
    data = file_examples(spark, base, days, job, with_label=False)
    scored = ftrl.score(data, load_model(spark, models, version), job.max_ids, [])
    write_tsv(predict(scored, "logit", ["id"]).select("id", "class_id", "probability"), out, delimiter=job.delimiter)

"""Sparse logistic regression trained by FTRL as table steps.

State is a table (idx, z, n, w), never a driver vector. One step:

1. explode each example's ids and look up their weights (broadcast when the spec's dimension proves
   the table small, salted shuffle join otherwise),
2. add them up per example; examples hash-partitioned by id need no exchange for this,
3. sum the gradients per id with map-side combine, so an id in every example stays cheap,
4. update the touched ids with column arithmetic.

Each step's state is cut from its lineage through the shared folder.
"""

from __future__ import annotations

from contextlib import contextmanager
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from clickloom.functions.categorical import hash_text
from clickloom.functions.numeric import sigmoid
from clickloom.operators import lookup
from clickloom.operators.lookup import bounded_lookup
from clickloom.session import cut_lineage, shuffle_partitions

STATE_SCHEMA = "idx bigint, z double, n double, w double"
BIAS = -1
BATCH = "_batch"
# Examples that a task sorts, and whose ids it adds up gradients for.
TASK_EXAMPLES = 1 << 16


@dataclass(frozen=True)
class Ftrl:
    """Step size, penalties and the initial squared-gradient sum."""

    rate: float = 0.1
    l1: float = 0.5
    l2: float = 1.0
    n0: float = 0.1


def empty_state(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], STATE_SCHEMA)


def examples(
    df: DataFrame,
    row_id: str,
    label: Column,
    ids: Column,
    weight: Column | None = None,
    bias: bool = True,
    keep: list[Column] | None = None,
) -> DataFrame:
    """Training table (id, label, weight, ids); the bias is one more id that every example has."""
    all_ids = F.concat(F.array(F.lit(BIAS).cast("bigint")), ids) if bias else ids
    return df.select(
        F.col(row_id).alias("id"),
        label.cast("double").alias("label"),
        (F.lit(1.0) if weight is None else weight.cast("double")).alias("weight"),
        all_ids.alias("ids"),
        *(keep or []),
    )


def logits(data: DataFrame, state: DataFrame, max_ids: int | None, hot: DataFrame | None = None) -> DataFrame:
    """Add the logit under the given weights to every example."""
    pairs = _pairs(data, "id")
    weights = state.where(F.col("w") != 0).select("idx", "w")
    found = bounded_lookup(pairs, weights, ["idx"], ["id"], max_ids, hot, how="inner")
    summed = found.groupBy("id").agg(F.sum("w").alias("logit"))
    return data.join(summed, "id", "left").withColumn("logit", F.coalesce("logit", F.lit(0.0)))


def score(
    data: DataFrame, state: DataFrame, max_ids: int | None, keep: list[str], hot: DataFrame | None = None, tasks: int | None = None
) -> DataFrame:
    """Only (id, ``keep`` columns, logit): the kept columns ride along, so nothing is joined back.

    ``tasks`` is how many tasks a join of ids with too many weights for a broadcast is dealt to.
    """
    pairs = _pairs(data, "id", *keep)
    weights = state.where(F.col("w") != 0).select("idx", "w")
    found = bounded_lookup(pairs, weights, ["idx"], ["id"], max_ids, hot, tasks=tasks)
    return found.groupBy("id", *keep).agg(F.coalesce(F.sum("w"), F.lit(0.0)).alias("logit"))


def gradients(data: DataFrame, state: DataFrame, max_ids: int | None, hot: DataFrame | None = None) -> DataFrame:
    """Weighted gradient sum per id of one pass over the examples."""
    error = F.col("weight") * (sigmoid(F.col("logit")) - F.col("label"))
    scored = _pairs(logits(data, state, max_ids, hot).withColumn("error", error), "error")
    return scored.where(F.col("idx").isNotNull()).groupBy("idx").agg(F.sum("error").alias("g"))


def update(state: DataFrame, grads: DataFrame, opt: Ftrl) -> DataFrame:
    """Fold one gradient sum per id into the state; ids without a gradient keep theirs."""
    old_z, old_w = (F.coalesce(c, F.lit(0.0)) for c in ("z", "w"))
    old_n = F.coalesce("n", F.lit(float(opt.n0)))
    g = F.col("g")
    new_n = old_n + g * g
    new_z = old_z + g - (F.sqrt(new_n) - F.sqrt(old_n)) / F.lit(opt.rate) * old_w
    stepped = state.join(grads, "idx", "full").select(
        "idx",
        F.when(g.isNull(), old_z).otherwise(new_z).alias("z"),
        F.when(g.isNull(), old_n).otherwise(new_n).alias("n"),
    )
    shrunk = F.signum("z") * F.lit(opt.l1) - F.col("z")
    w = F.when(F.abs("z") > opt.l1, shrunk / (F.sqrt("n") / F.lit(opt.rate) + F.lit(2 * opt.l2))).otherwise(F.lit(0.0))
    return stepped.withColumn("w", w)


def step(data: DataFrame, state: DataFrame, opt: Ftrl = Ftrl(), max_ids: int | None = None, hot: DataFrame | None = None) -> DataFrame:
    """One synchronous step over all given examples."""
    return update(state, gradients(data, state, max_ids, hot), opt)


def tasks_for(data: DataFrame) -> int:
    """As many tasks as the session asks for, and more for many examples."""
    return max(shuffle_partitions(data.sparkSession), -(-data.count() // TASK_EXAMPLES))


@contextmanager
def placed(data: DataFrame, batches: int = 1, parts: tuple[str, ...] = ()):
    """The examples dealt by id and kept on the executors while a training passes over them.

    Within a task they lie in order of ``parts``, then of their batch, so that a filter on either skips
    all other stretches of the kept rows, and every update still runs on all tasks. More examples make more
    tasks, not larger ones.
    """
    dealt = data if batches == 1 else data.withColumn(BATCH, _batch_of("id", batches))
    order = [*parts, *([] if batches == 1 else [BATCH]), "id"]
    kept = dealt.repartition(tasks_for(data), "id").sortWithinPartitions(*order).persist()
    try:
        yield kept
    finally:
        kept.unpersist()


def train(
    data: DataFrame,
    state: DataFrame | None = None,
    steps: int = 1,
    opt: Ftrl = Ftrl(),
    max_ids: int | None = None,
    batches: int = 1,
) -> DataFrame:
    """``steps`` passes over the examples, each split by id hash into ``batches`` updates.

    Starts from ``state`` to continue a training, or clean without one. Examples are placed by id
    once; every step then exchanges only gradients (and, if too large to broadcast, weights).
    """
    with placed(data, batches) as rows:
        return train_placed(rows, state, steps, opt, max_ids, batches)


def train_placed(
    rows: DataFrame,
    state: DataFrame | None = None,
    steps: int = 1,
    opt: Ftrl = Ftrl(),
    max_ids: int | None = None,
    batches: int = 1,
) -> DataFrame:
    """``train`` for examples, or parts of them, that ``placed`` holds with the same ``batches``."""
    spark = rows.sparkSession
    state = empty_state(spark) if state is None else state
    proven = max_ids is not None and max_ids <= lookup.BROADCAST_ROWS
    hot = None
    for _ in range(steps):
        for batch in range(batches):
            bound = max_ids
            if not proven:
                # The penalty keeps most weights at zero: count what a lookup really needs.
                bound = state.where(F.col("w") != 0).count()
                if bound > lookup.BROADCAST_ROWS and hot is None:
                    # Ids do not change between steps, so the hot ones (2P rows) are found once.
                    hot = cut_lineage(lookup.hot_keys(_pairs(rows), ["idx"]))
            part = rows if batches == 1 else rows.where(F.col(BATCH) == batch)
            state = cut_lineage(step(part, state, opt, bound, hot))
    return state


def _pairs(data: DataFrame, *keep: str) -> DataFrame:
    """One row per id of an example, with a null id for an example without ids.

    For a plain explode Spark adds a filter on the array, which would compute its ids once more.
    """
    return data.select(*keep, F.explode_outer("ids").alias("idx"))


def _batch_of(row_id: str, batches: int) -> Column:
    return hash_text(F.col(row_id).cast("string"), "md5") % batches

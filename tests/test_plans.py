"""Physical plans that must not regress."""

import re

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from clickloom.operators import deep_training, ftrl, order, rates
from clickloom.plans import scoring, training
from clickloom.session import cut_lineage
from clickloom.spec import Continuous, Cross, HashBucket, ModelSpec

PURE = (
    "target_rate target_rate_windows downsample class_balance bucket_size_advice hash_collisions cross_size_advice "
    "wide_input wide_logit deep_input embedding_mean evaluation batch_ids padded_batch positional_join missing_days "
    "multi_hot cross_multivalue softmax_head image_standardize"
).split()


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def initial(plan):
    return plan.split("== Initial Plan ==")[0]


@pytest.mark.parametrize("name", PURE)
def test_no_cross_joins(spark, sf_dir, no_broadcast, name):
    plan = plan_of(entry.queries()[name](spark, sf_dir))
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_scans_read_only_what_is_used(spark, sf_dir):
    plan = plan_of(entry.queries()["downsample"](spark, sf_dir))
    assert re.findall(r"ReadSchema: struct<([^>]*)>", plan) == ["event_id:bigint,event_type:string"]
    assert "Exchange" not in plan


def test_day_filter_reaches_the_scan(spark, sf_dir):
    events = spark.read.parquet(f"{sf_dir}/events.parquet").where(F.col("event_id") > 10)
    assert "GreaterThan(event_id,10)" in plan_of(events.select("event_id"))


def test_windows_of_rates_run_on_counts(spark, sf_dir, no_broadcast):
    plan = plan_of(entry.queries()["target_rate_windows"](spark, sf_dir))
    assert plan.index("Window") < plan.index("HashAggregate(keys=[feature") < plan.rindex("partial_sum") < plan.index("Scan parquet")
    assert "MapInArrow" not in plan and "Python" not in plan


def test_row_index_has_one_exchange_for_the_rows(spark):
    df = spark.range(1000).withColumnRenamed("id", "key")
    plan = plan_of(order.with_row_index(df, "key"))
    assert plan.count("shufflepartitionidpassthrough") == 1
    assert plan.count("Exchange hashpartitioning") == 1  # the range totals


def test_training_step_exchanges_gradients_only(spark, no_broadcast):
    data = spark.range(200).select(
        "id", F.lit(1.0).alias("label"), F.lit(1.0).alias("weight"), F.array(F.col("id") % 7).alias("ids")
    )
    placed = data.repartition(4, "id").sortWithinPartitions("id").persist()
    placed.count()
    state = cut_lineage(ftrl.step(placed, ftrl.empty_state(spark), max_ids=10))
    plan = plan_of(ftrl.gradients(placed, state, 10))
    # Inside the cached relation there is the placement itself; outside only the exchange by idx.
    assert len(re.findall(r"Exchange hashpartitioning\(idx", plan)) == 1
    assert not re.findall(r"Exchange hashpartitioning\(id#\d+L?, \d+\), ENSURE_REQUIREMENTS", plan)
    placed.unpersist()


def test_a_batch_reads_only_its_stretch_of_the_placed_rows(spark):
    data = spark.range(200).select(
        "id", F.lit(1.0).alias("label"), F.lit(1.0).alias("weight"), F.array(F.col("id") % 7).alias("ids")
    )
    with ftrl.placed(data.withColumn("day", F.col("id") % 2), 2, ("day",)) as rows:
        plan = plan_of(rows.where((F.col("day") == 1) & (F.col(ftrl.BATCH) == 0)))
        pruned = re.search(r"InMemoryTableScan \[[^\]]*\], \[(.*?)\]", plan).group(1)
        assert "day" in pruned and ftrl.BATCH in pruned


def test_each_feature_of_the_rates_is_read_once(spark, sf_dir):
    spark.conf.set("spark.sql.maxMetadataStringLength", "1000")
    try:
        plan = initial(plan_of(entry.queries()["target_rate_multi"](spark, sf_dir)))
    finally:
        spark.conf.unset("spark.sql.maxMetadataStringLength")
    assert sorted(re.findall(r"feature_number=(\d+)", plan)) == ["0", "1", "2"]
    assert len(re.findall("FileScan parquet", plan)) == 4  # and the rows


def test_rate_join_scans_the_log_twice(spark, sf_dir, no_broadcast):
    scans = []
    read = spark.read.parquet(f"{sf_dir}/events.parquet")
    log = read.select("event_id", "user_id", (F.col("event_type") == "click").alias("clk"))
    aggregate = rates.target_rate(log, ["user_id"], F.col("clk"))
    scans += re.findall(r"FileScan parquet .*events", initial(plan_of(aggregate)))
    joined = rates.with_target_rate(log, ["user_id"], F.col("clk"), "event_id")
    scans += re.findall(r"FileScan parquet .*events", initial(plan_of(joined)))
    assert len(scans) == 2
    assert initial(plan_of(joined)).count("FileScan parquet") == 4  # rows, the stored rates, and these twice for their hot keys


def test_joint_logits_read_the_rows_once(spark, no_broadcast):
    spec = ModelSpec(("clk", "u", "age"), (HashBucket("u", 30), Continuous("age", "min_max", (0.0, 10.0), (3.0, 6.0))), (Cross(("u", "age"), 64),))
    log = spark.createDataFrame([(0, "a", 1.0)], "id long, u string, age double").repartition(2)
    state = spark.createDataFrame([(1, 0.0, 0.1, 0.5)], ftrl.STATE_SCHEMA)
    tables = {s.name: spark.range(5).select(F.col("id").alias("idx"), F.array(*[F.lit(0.5)] * s.width).alias("vector")) for s in spec.deep_slots() if s.how == "embedding"}
    nets = [deep_training.start(spec.deep_dimension, [3])]
    plan = initial(plan_of(scoring.joint_logits(log, spec, "id", "joint", state, nets, tables, "md5")))
    assert plan.count("Exchange RoundRobinPartitioning") == 1 and plan.count("SortMergeJoin") == 0
    assert len(re.findall(r"Exchange hashpartitioning\(id", plan)) == 1  # the lookup table is proven small
    assert plan.count("Exchange hashpartitioning") == 1


def test_walk_forward_deals_each_part_once(spark, monkeypatch):
    """The part that is evaluated lies dealt by id already, as it does when it is trained on next."""
    rows = [(i, float(i % 3 == 0), 1.0, [-1, i % 7], i % 4) for i in range(200)]
    data = spark.createDataFrame(rows, "id long, label double, weight double, ids array<long>, part int")
    dealt, scored, placed, evaluation = [], [], ftrl.placed, training.evaluation
    before = len(spark.sparkContext._jsc.getPersistentRDDs())
    monkeypatch.setattr(ftrl, "placed", lambda rows, *given: dealt.append(1) or placed(rows, *given))
    monkeypatch.setattr(training, "evaluation", lambda rows, *given: scored.append(rows.storageLevel.useMemory) or evaluation(rows, *given))
    results, _ = training.walk_forward(data, "part", epochs=2, max_ids=8)
    assert len(dealt) == 4 and scored == [True] * 6
    assert results.where("metric = 'n_rows' AND value = 50").count() == 6
    assert len(spark.sparkContext._jsc.getPersistentRDDs()) == before


def test_joint_logits_deal_rows_before_pairs(spark, no_broadcast):
    """With a proven small table rows are exchanged, not their pairs and vectors."""
    spec = ModelSpec(("clk", "u", "age"), (HashBucket("u", 30), Continuous("age", "min_max", (0.0, 10.0), (3.0, 6.0))))
    log = spark.createDataFrame([(0, "a", 1.0)], "id long, u string, age double")
    state = spark.createDataFrame([(1, 0.0, 0.1, 0.5)], ftrl.STATE_SCHEMA)
    tables = {s.name: spark.range(5).select(F.col("id").alias("idx"), F.array(*[F.lit(0.5)] * s.width).alias("vector")) for s in spec.deep_slots() if s.how == "embedding"}
    plan = initial(plan_of(scoring.joint_logits(log, spec, "id", "joint", state, [deep_training.start(spec.deep_dimension, [3])], tables, "md5")))
    assert "Generate" in plan and plan.index("Generate") < plan.index("Exchange hashpartitioning(id")

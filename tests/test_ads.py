"""The whole ad-log spec: ids of every column, and weights that are too many for a broadcast."""

from compare import connect, difference, spark_rows, sql_rows

from clickloom.operators import ftrl, lookup
from clickloom.queries import SQL, ads


def test_spec_is_above_the_broadcast_bound():
    assert ads.SPEC.wide_dimension > lookup.BROADCAST_ROWS
    assert len(ads.SPEC.features) == 39 and len(ads.SPEC.crosses) == 31


def test_every_field_stays_in_its_range(spark, sf_dir):
    log = ads.ad_log(spark, sf_dir)
    assert log.columns == ["event_id", "clk", *(f.name for f in ads.SPEC.features)]
    assert log.where(" OR ".join(f"{f.name} IS NULL" for f in ads.SPEC.features)).count() == 0


def test_training_and_scoring_by_salted_joins(spark, sf_dir, monkeypatch, no_broadcast):
    monkeypatch.setattr(lookup, "BROADCAST_ROWS", 100)
    scored = ads.ads_train(spark, sf_dir)
    plan = scored._jdf.queryExecution().optimizedPlan().toString()
    assert lookup.SALT in plan
    assert difference(spark_rows(scored), sql_rows(connect(sf_dir), SQL["ads_train"])) is None


def test_more_examples_make_more_tasks(spark, sf_dir, monkeypatch, no_broadcast):
    """Neither training nor scoring hands a task more examples than its share."""
    monkeypatch.setattr(lookup, "BROADCAST_ROWS", 100)
    monkeypatch.setattr(ftrl, "TASK_EXAMPLES", 50)
    n = spark.read.parquet(f"{sf_dir}/events.parquet").count()
    data = spark.range(n).selectExpr("id", "1.0D AS label", "1.0D AS weight", "array(-1L, id) AS ids")
    with ftrl.placed(data) as rows:
        assert rows.rdd.getNumPartitions() == -(-n // 50) > 8
    plan = ads.ads_train(spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("RepartitionByExpression") >= 2 and f", {-(-n // 50)}" in plan

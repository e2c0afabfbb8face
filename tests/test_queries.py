"""Every registered query with SQL must give exactly the SQL's rows."""

import pytest
from compare import connect, difference, spark_rows, sql_rows

import __spark_entry__ as entry


@pytest.fixture(scope="module")
def con(sf_dir):
    return connect(sf_dir)


def test_every_sql_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_same_rows_as_sql(spark, con, sf_dir, name):
    got = spark_rows(entry.queries()[name](spark, sf_dir))
    assert got[1], "no rows"
    assert difference(got, sql_rows(con, entry.oracle_sql()[name])) is None


def test_random_sample_keeps_positives(spark, sf_dir):
    sampled = entry.queries()["downsample_rand"](spark, sf_dir).collect()
    log = spark.read.parquet(f"{sf_dir}/events.parquet")
    positives = {r[0] for r in log.where("event_type = 'click'").select("event_id").collect()}
    assert {r["event_id"] for r in sampled if r["clk"] == 1} == positives
    assert len({r["event_id"] for r in sampled}) == len(sampled)


def test_library_models_predict_every_row(spark, sf_dir):
    assert entry.queries()["wide_lr"](spark, sf_dir).count() == spark.read.parquet(f"{sf_dir}/events.parquet").count()
    assert entry.queries()["deep_train"](spark, sf_dir).count() == spark.read.parquet(f"{sf_dir}/embeddings.parquet").count()

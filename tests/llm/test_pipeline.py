"""Stages one after the other on a small corpus, and the SQL of the corpus queries."""

import pytest
from compare import connect, difference, spark_rows, sql_rows

import corpus_pipeline
from clickloom.llm import queries

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon".split()


def text(i, n=60):
    return " ".join(WORDS[(i * 7 + j * (i % 5 + 1) + j * j) % len(WORDS)] + str((i * j) % 17) for j in range(n))


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("corpus"))
    passage = text(999, 30)
    rows = [(i, text(i), "en", f"s{i % 3}") for i in range(40)]
    rows += [(100, text(3), "en", "s0"), (101, text(3), "en", "s1")]  # copies of 3
    rows += [(102, "word and " + passage + " more", "en", "s0"), (103, "12345 !!", "en", "s1"), (104, None, "en", "s1")]
    rows += [(105, text(105) + " password=Zq8sLk3jQw7dPx5v", "en", "s2")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").selectExpr("*", "cast(length(text) as long) n_chars")
    docs.write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(1, passage)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return folder


def test_stages_decide_and_keep_clean_documents(spark, folder, tmp_path):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    clean = {*range(40), 105}
    kept = [clean | {100, 101, 102}, clean | {102}, clean, clean]
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, folder).write.parquet(f"{tmp_path}/{i}")
        after = spark.read.parquet(f"{tmp_path}/{i}")
        if i < 4:
            assert after.columns == docs.columns and sorted(r[0] for r in after.select("doc_id").collect()) == sorted(kept[i]), name
        docs = after
    assert {r[0] for r in docs.select("doc_id").collect()} <= clean
    assert not docs.where("text like '%Zq8sLk3jQw7dPx5v%'").count()
    words = docs.selectExpr("sum(size(split(text, ' ')))").first()[0]
    assert abs(words - 41 * 60) < 0.1 * 41 * 60


def test_run_gives_the_last_stage(spark, folder):
    out = corpus_pipeline.run(spark, folder)
    assert {"doc_id", "text", "mix_shard"} <= set(out.columns) and out.count() > 0


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_same_rows_as_sql(spark, sf_dir, name):
    got = spark_rows(queries.QUERIES[name](spark, sf_dir))
    assert got[1] and difference(got, sql_rows(connect(sf_dir), queries.SQL[name])) is None

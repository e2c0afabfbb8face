"""Lookups of rates, embeddings and weights; positional joins."""

from __future__ import annotations

from pyspark.sql import functions as F

from clickloom.functions import categorical as cat
from clickloom.functions.clean import is_positive, split_multivalue
from clickloom.operators import batches, rates, sparse
from clickloom.operators.lookup import measured_lookup
from clickloom.queries.base import EVENT_IDS, EVENT_SPEC, LOG, impressions, md5_sql, query, rounded, table, vector_ids

RATE_SQL = f"""WITH {LOG}, rates AS (SELECT user_id, avg(clk) AS rate, count(*) AS n FROM log GROUP BY user_id)
    SELECT event_id, user_id, round(rate, 9) AS user_id_rate, n FROM log LEFT JOIN rates USING (user_id)"""


@query("target_rate", RATE_SQL)
def target_rate(spark, sf_dir):
    joined = rates.with_target_rate(impressions(spark, sf_dir), ["user_id"], is_positive(F.col("clk")), "event_id", "user_id_rate")
    return joined.withColumn("user_id_rate", rounded(F.col("user_id_rate")))


@query("target_rate_broadcast", RATE_SQL)
def target_rate_broadcast(spark, sf_dir):
    log = impressions(spark, sf_dir)
    by_user = rates.target_rate(log, ["user_id"], is_positive(F.col("clk")), "user_id_rate")
    joined = measured_lookup(log.select("event_id", "user_id"), by_user, ["user_id"], ["event_id"], count=F.col("n"))
    return joined.select("event_id", "user_id", rounded(F.col("user_id_rate")).alias("user_id_rate"), "n")


@query(
    "positional_join",
    """WITH a AS (SELECT row_number() OVER (ORDER BY doc_id) - 1 AS row_index, doc_id, quality FROM labels),
    b AS (SELECT row_number() OVER (ORDER BY vec_id) - 1 AS row_index, vec_id,
                 round(CAST(embedding[1] AS DOUBLE), 9) AS first_value FROM embeddings)
    SELECT row_index, doc_id, quality, vec_id, first_value FROM a JOIN b USING (row_index)""",
)
def positional_join(spark, sf_dir):
    rows = table(spark, sf_dir, "labels").select("doc_id", "quality")
    first = rounded(F.get("embedding", 0)).alias("first_value")
    images = table(spark, sf_dir, "embeddings").select("vec_id", first)
    return batches.positional_join(rows, images, "doc_id", "vec_id")


@query(
    "embedding_mean",
    f"""WITH tokens AS (SELECT p_partkey, unnest(list_filter(string_split(p_name, ' '), lambda t: t <> '')) AS t FROM part),
    ids AS (SELECT p_partkey, {md5_sql('t')} % (SELECT max(vec_id) + 1 FROM embeddings) AS idx FROM tokens),
    vectors AS (SELECT vec_id AS idx, unnest(range(64)) AS dim, CAST(unnest(embedding) AS DOUBLE) AS v FROM embeddings),
    means AS (SELECT p_partkey, dim, avg(v) AS v FROM ids JOIN vectors USING (idx) GROUP BY p_partkey, dim)
    SELECT p_partkey, CAST(dim AS INTEGER) AS dim, round(v, 9) + 0.0 AS value FROM means""",
)
def embedding_mean(spark, sf_dir):
    """Words of names share all vectors of the table."""
    vectors = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("idx"), F.col("embedding").alias("vector"))
    n_ids = vector_ids(spark, sf_dir)
    ids = cat.hash_bucket_tokens(split_multivalue(F.col("p_name"), " "), n_ids, "md5")
    rows = table(spark, sf_dir, "part").select("p_partkey", ids.alias("ids"))
    means = sparse.embedding_mean(rows, vectors, "p_partkey", "ids", 64, n_ids)
    exploded = means.select("p_partkey", F.posexplode("embedded").alias("dim", "v"))
    return exploded.select("p_partkey", "dim", rounded(F.col("v")).alias("value"))


@query(
    "wide_logit",
    f"""WITH {LOG}, {EVENT_IDS},
    weights AS (SELECT idx, ((idx * 37) % 101 - 50) / 100.0::DOUBLE AS w FROM (SELECT DISTINCT idx FROM ids WHERE idx % 3 <> 0))
    SELECT event_id, round(coalesce(sum(w), 0.0) + 0.25, 9) + 0.0 AS logit
    FROM ids LEFT JOIN weights USING (idx) GROUP BY event_id""",
)
def wide_logit(spark, sf_dir):
    rows = sparse.with_wide_ids(impressions(spark, sf_dir), EVENT_SPEC, "md5").select("event_id", "ids")
    # A weight table for two thirds of the ids in use; the others count 0.
    used = rows.select(F.explode_outer("ids").alias("idx")).where(F.col("idx") % 3 != 0).distinct()
    weights = used.withColumn("w", ((F.col("idx") * 37) % 101 - 50) / F.lit(100.0))
    logits = sparse.wide_logit(rows, weights, "event_id", "ids", EVENT_SPEC.wide_dimension, bias=0.25)
    return logits.select("event_id", rounded(F.col("logit")).alias("logit"))

"""Rates over trailing days, sampling, ordering, batches and profiles."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clickloom.functions.clean import is_positive, split_multivalue
from clickloom.operators import batches, order, profile, rates, sampling, sketches
from clickloom.plans.prepare import Preparation, prepare
from clickloom.queries.base import LOG, impressions, md5_sql, query, rounded, table
from clickloom.session import scratch_path


def click():
    return is_positive(F.col("clk"))


@query(
    "count_sum_by_key",
    f"WITH {LOG} SELECT user_id, hour, count(*) AS n, CAST(sum(clk) AS BIGINT) AS positives FROM log GROUP BY user_id, hour",
)
def count_sum_by_key(spark, sf_dir):
    return rates.count_sum_by_key(impressions(spark, sf_dir), ["user_id", "hour"], click())


def _frame(k: int, last: int = 0) -> str:
    def bound(offset: int) -> str:
        return "CURRENT ROW" if offset == 0 else f"{-offset} PRECEDING"

    return f"(PARTITION BY value ORDER BY day_number RANGE BETWEEN {bound(last - k + 1)} AND {bound(last)})"


def _rates_sql(feature: str, windows, prefix: str, last: int = 0) -> str:
    """Common table expressions for the daily counts and trailing rates of one feature."""
    rates_ = ", ".join(
        f"sum(p) OVER {_frame(k, last)} / CAST(sum(n) OVER {_frame(k, last)} AS DOUBLE) AS {prefix}rate_{k}" for k in windows
    )
    return f"""daily_{feature} AS (SELECT CAST({feature} AS VARCHAR) AS value, day, datediff('day', DATE '1970-01-01', day) AS day_number,
      count(*) AS n, sum(clk) AS p FROM log GROUP BY ALL),
    rates_{feature} AS (SELECT value, day, {rates_} FROM daily_{feature})"""


@query(
    "target_rate_windows",
    f"""WITH {LOG}, {_rates_sql('user_id', (1, 7, 30), '')}
    SELECT value AS user_id, strftime(day, '%Y%m%d') AS dt, round(rate_1, 9) AS rate_1, round(rate_7, 9) AS rate_7,
      round(rate_30, 9) AS rate_30 FROM rates_user_id""",
)
def target_rate_windows(spark, sf_dir):
    daily = rates.daily_counts(impressions(spark, sf_dir), ["user_id"], "day", click())
    windowed = rates.trailing_rates(daily, "day")
    return windowed.select(
        F.col("value").alias("user_id"),
        F.date_format("day", "yyyyMMdd").alias("dt"),
        *[rounded(F.col(f"rate_{k}")).alias(f"rate_{k}") for k in rates.WINDOWS],
    )


@query(
    "target_rate_past_days",
    f"""WITH {LOG}, {_rates_sql('user_id', (1, 7), '', -1)}
    SELECT value AS user_id, strftime(day, '%Y%m%d') AS dt, round(rate_1, 9) AS rate_1, round(rate_7, 9) AS rate_7
    FROM rates_user_id""",
)
def target_rate_past_days(spark, sf_dir):
    """Leak-free variant: the row's own day is not counted."""
    daily = rates.daily_counts(impressions(spark, sf_dir), ["user_id"], "day", click())
    windowed = rates.trailing_rates(daily, "day", (1, 7), include_current=False)
    return windowed.select(
        F.col("value").alias("user_id"),
        F.date_format("day", "yyyyMMdd").alias("dt"),
        *[rounded(F.col(f"rate_{k}")).alias(f"rate_{k}") for k in (1, 7)],
    )


MULTI = ("user_id", "hour", "k")
MULTI_WINDOWS = (1, 7, 30)
MULTI_NAMES = [f"{f}_rate_{k}" for k in MULTI_WINDOWS for f in MULTI]
MULTI_CTES = ", ".join(_rates_sql(f, MULTI_WINDOWS, f"{f}_") for f in MULTI)
MULTI_SELECT = "SELECT event_id, " + ", ".join(f"round({n}, 9) AS {n}" for n in MULTI_NAMES) + " FROM log l"
MULTI_JOINS = " ".join(
    f"LEFT JOIN rates_{f} ON rates_{f}.value = CAST(l.{f} AS VARCHAR) AND rates_{f}.day = l.day" for f in MULTI
)


@query("target_rate_multi", f"WITH {LOG}, {MULTI_CTES} {MULTI_SELECT} {MULTI_JOINS}")
def target_rate_multi(spark, sf_dir):
    log = impressions(spark, sf_dir)
    daily = rates.daily_counts(log, list(MULTI), "day", click())
    windowed = rates.trailing_rates(daily, "day", MULTI_WINDOWS)
    rows = log.select("event_id", "day", *MULTI)
    joined = rates.attach_rates(rows, windowed, list(MULTI), "day", "event_id", MULTI_WINDOWS)
    return joined.select("event_id", *[rounded(F.col(n)).alias(n) for n in MULTI_NAMES])


KEEP = 0.1
KEEP_SQL = f"(clk = 1 OR {md5_sql("'0:' || event_id")} % 1000000 < {int(KEEP * 1_000_000)})"


@query("daily_preparation", f"WITH {LOG}, {MULTI_CTES} {MULTI_SELECT} {MULTI_JOINS} WHERE {KEEP_SQL}")
def daily_preparation(spark, sf_dir):
    """The whole job: trailing rates from the full log, attached to the down-sampled rows."""
    log = impressions(spark, sf_dir)
    job = Preparation(features=MULTI, windows=MULTI_WINDOWS, keep=KEEP)
    done = prepare(log, "clk", "day", "event_id", job)
    return done.select("event_id", *[rounded(F.col(n)).alias(n) for n in MULTI_NAMES])


@query("downsample", f"WITH {LOG} SELECT event_id, clk FROM log WHERE {KEEP_SQL}")
def downsample(spark, sf_dir):
    return sampling.downsample(impressions(spark, sf_dir), "clk", "event_id", KEEP).select("event_id", "clk")


@query(
    "downsample_rand",
    f"""WITH {LOG}, ranked AS (
      SELECT event_id, clk, row_number() OVER (PARTITION BY clk ORDER BY {md5_sql("'0:' || event_id")}, event_id) AS place,
             count(*) OVER (PARTITION BY clk) AS n FROM log)
    SELECT event_id, clk FROM ranked WHERE clk = 1 OR place <= round(n * {KEEP}::DOUBLE)""",
)
def downsample_rand(spark, sf_dir):
    """All clicks and a random sample of the other rows with an exact size."""
    return sampling.downsample_exact(impressions(spark, sf_dir).select("event_id", "clk"), "clk", "event_id", KEEP, seed=0)


@query(
    "seeded_shuffle",
    f"""SELECT event_id, row_number() OVER (ORDER BY {md5_sql("'123:' || event_id")}) - 1 AS position FROM events""",
)
def seeded_shuffle(spark, sf_dir):
    return batches.seeded_shuffle(table(spark, sf_dir, "events").select("event_id"), "event_id", seed=123)


INDEXED = "SELECT event_id, row_number() OVER (ORDER BY event_id) - 1 AS row_index FROM events"


@query("shard", f"SELECT event_id, row_index FROM ({INDEXED}) WHERE row_index % 4 = 1")
def shard(spark, sf_dir):
    indexed = order.with_row_index(table(spark, sf_dir, "events").select("event_id"), "event_id")
    return batches.shard(indexed, workers=4, index=1).select("event_id", "row_index")


@query("batch_ids", f"SELECT event_id, row_index // 64 AS batch_id FROM ({INDEXED})")
def batch_ids(spark, sf_dir):
    indexed = order.with_row_index(table(spark, sf_dir, "events").select("event_id"), "event_id")
    return batches.batch_ids(indexed, 64).select("event_id", "batch_id")


@query(
    "padded_batch",
    """WITH t AS (SELECT page_id, list_filter(string_split(url, '/'), lambda t: t <> '') AS tokens,
      (row_number() OVER (ORDER BY page_id) - 1) // 32 AS batch_id FROM pages),
    m AS (SELECT batch_id, max(len(tokens)) AS longest FROM t GROUP BY batch_id)
    SELECT page_id, batch_id, longest AS n_padded,
      array_to_string(list_concat(tokens, list_transform(range(longest - len(tokens)), lambda i: '')), '|') AS padded
    FROM t JOIN m USING (batch_id)""",
)
def padded_batch(spark, sf_dir):
    pages = table(spark, sf_dir, "pages").select("page_id", split_multivalue(F.col("url"), "/").alias("tokens"))
    batched = batches.batch_ids(order.with_row_index(pages, "page_id"), 32)
    padded = batches.padded_batch(batched, {"tokens": ""})
    return padded.select(
        "page_id", "batch_id", F.size("tokens").cast("bigint").alias("n_padded"), F.array_join("tokens", "|").alias("padded")
    )


@query("first_row", "SELECT event_id, event_type, value FROM events ORDER BY event_id LIMIT 1")
def first_row(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", "event_type", "value").orderBy("event_id").limit(1)


@query(
    "class_balance",
    f"""WITH {LOG} SELECT count(*) AS n, CAST(sum(clk) AS BIGINT) AS n_pos, CAST(count(*) - sum(clk) AS BIGINT) AS n_neg,
      round((count(*) - sum(clk)) / CAST(count(*) AS DOUBLE), 9) AS pos_weight,
      round(sum(clk) / CAST(count(*) AS DOUBLE), 9) AS neg_weight FROM log""",
)
def class_balance(spark, sf_dir):
    balance = profile.class_balance(impressions(spark, sf_dir), click())
    return balance.withColumns({c: rounded(F.col(c)) for c in ("pos_weight", "neg_weight")})


ADVICE = ("user_id", "hour", "k", "event_type", "dt", "event_id")


@query(
    "bucket_size_advice",
    f"""WITH {LOG}, counts AS ({' UNION ALL '.join(
        f"SELECT '{f}' AS feature, count(DISTINCT {f}) AS n FROM log" for f in ADVICE)})
    SELECT feature, n AS n_values,
      CAST(ceil(CASE WHEN n <= 100 THEN 3.0 WHEN n > 10000 THEN 1.5 ELSE 2.0 END * n) AS BIGINT) AS size_low,
      CAST(ceil(CASE WHEN n <= 100 THEN 4.0 WHEN n > 10000 THEN 2.0 ELSE 3.0 END * n) AS BIGINT) AS size_high FROM counts""",
)
def bucket_size_advice(spark, sf_dir):
    return profile.bucket_size_advice(impressions(spark, sf_dir), list(ADVICE))


@query(
    "cross_size_advice",
    f"""WITH {LOG}, n AS (SELECT count(DISTINCT user_id) AS u, count(DISTINCT hour) AS h, count(DISTINCT event_type) AS t,
      count(DISTINCT user_id || '&' || hour) AS uh, count(DISTINCT user_id || '&' || hour || '&' || event_type) AS uht FROM log)
    SELECT 'user_id&hour' AS "cross", uh AS n_values, u * h AS product_size, uh * 2 AS double_size FROM n
    UNION ALL SELECT 'user_id&hour&event_type', uht, u * h * t, uht * 2 FROM n""",
)
def cross_size_advice(spark, sf_dir):
    return profile.cross_size_advice(impressions(spark, sf_dir), [("user_id", "hour"), ("user_id", "hour", "event_type")])


COLLIDING = ("l_orderkey", "l_partkey", "l_suppkey")


@query(
    "hash_collisions",
    f"""WITH v AS ({' UNION '.join(
        f"SELECT DISTINCT '{f}' AS feature, CAST({f} AS VARCHAR) AS value FROM lineitem" for f in COLLIDING)}),
    s AS (SELECT feature, count(*) AS n_values FROM v GROUP BY feature)
    SELECT feature, n_values, count(DISTINCT {md5_sql('value')} % n_values) AS n_buckets,
      round(count(DISTINCT {md5_sql('value')} % n_values) / CAST(n_values AS DOUBLE), 9) AS bucket_ratio
    FROM v JOIN s USING (feature) GROUP BY feature, n_values""",
)
def hash_collisions(spark, sf_dir):
    found = profile.hash_collisions(table(spark, sf_dir, "lineitem"), list(COLLIDING), method="md5")
    return found.withColumn("bucket_ratio", rounded(F.col("bucket_ratio")))


@query(
    "zero_fraction",
    """SELECT round(avg(CASE WHEN l_discount = 0 THEN 1.0 ELSE 0.0 END), 9) AS l_discount,
      round(avg(CASE WHEN l_tax = 0 THEN 1.0 ELSE 0.0 END), 9) AS l_tax,
      round(avg(CASE WHEN l_quantity = 0 THEN 1.0 ELSE 0.0 END), 9) AS l_quantity FROM lineitem""",
)
def zero_fraction(spark, sf_dir):
    columns = ["l_discount", "l_tax", "l_quantity"]
    found = profile.zero_fraction(table(spark, sf_dir, "lineitem"), columns)
    return found.select(*[rounded(F.col(c)).alias(c) for c in columns])


@query(
    "value_histogram",
    """SELECT CAST(CASE WHEN l_extendedprice < 5000 THEN 0 WHEN l_extendedprice >= 100000 THEN 20
      ELSE floor((l_extendedprice - 5000) / 5000) + 1 END AS BIGINT) AS bin, count(*) AS n,
      min(l_extendedprice) AS min_value, max(l_extendedprice) AS max_value FROM lineitem GROUP BY bin""",
)
def value_histogram(spark, sf_dir):
    return profile.value_histogram(table(spark, sf_dir, "lineitem"), "l_extendedprice", 5000, 100000, 19)


SKETCHED = ("user_id", "k", "event_id")
# Four standard errors of the sketches.
NEAR = 4 * 1.04 / 2 ** (sketches.REGISTERS / 2)
SPANS = (("whole", None, None), ("first_week", "2024-01-01", "2024-01-07"), ("one_day", "2024-01-03", "2024-01-03"))


def _span_sql(name, first, last) -> str:
    days = "true" if first is None else f"day BETWEEN DATE '{first}' AND DATE '{last}'"
    return " UNION ALL ".join(f"SELECT '{name}' AS span, '{f}' AS feature, count(DISTINCT {f}) AS n_exact, count({f}) AS n_rows, true AS near FROM log WHERE {days}" for f in SKETCHED)


@query("distinct_sketches", f"WITH {LOG} {' UNION ALL '.join(_span_sql(*s) for s in SPANS)}")
def distinct_sketches(spark, sf_dir):
    """Distinct counts of several spans of days from sketches stored by day, next to the exact ones."""
    log, path = impressions(spark, sf_dir), scratch_path(spark, "sketches")
    sketches.store(sketches.daily_sketches(log, list(SKETCHED), F.col("day")), path)
    kept = sketches.stored(spark, path)
    parts = []
    for name, first, last in SPANS:
        days = log if first is None else log.where(F.col("day").between(first, last))
        exact = profile.distinct_values(days, list(SKETCHED)).groupBy("feature").agg(F.count(F.lit(1)).alias("n_exact"))
        estimated = sketches.distinct_counts(kept, first, last)
        near = F.abs(F.col("n_values") - F.col("n_exact")) <= F.lit(NEAR) * F.col("n_exact")
        parts.append(exact.join(estimated, "feature", "left").select(F.lit(name).alias("span"), "feature", "n_exact", F.col("n").alias("n_rows"), near.alias("near")))
    return reduce(DataFrame.unionByName, parts)

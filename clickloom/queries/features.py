"""Feature transforms and model inputs."""

from __future__ import annotations

from pyspark.sql import functions as F

from clickloom.functions import categorical as cat
from clickloom.functions.clean import split_multivalue
from clickloom.functions.numeric import ACTIVATIONS, activation, embedding_width, scale
from clickloom.operators import profile, sparse, vocabulary
from clickloom.queries.base import (
    EVENT_IDS,
    EVENT_SPEC,
    LOG,
    VALUE_BOUNDS,
    VALUE_BUCKET,
    bucket_sql,
    impressions,
    md5_sql,
    query,
    rounded,
    table,
    vector_ids,
)
from clickloom.sinks.models import feature_spec_rows
from clickloom.spec import Continuous, Cross, HashBucket, Identity, ModelSpec, Vocab


@query(
    "hash_bucket",
    f"""SELECT o_orderkey, {md5_sql('o_orderpriority')} % 20 AS priority_id, {md5_sql('CAST(o_custkey AS VARCHAR)')} % 1000 AS customer_id
    FROM orders""",
)
def hash_bucket(spark, sf_dir):
    return table(spark, sf_dir, "orders").select(
        "o_orderkey",
        cat.hash_bucket(F.col("o_orderpriority"), 20, "md5").alias("priority_id"),
        cat.hash_bucket(F.col("o_custkey").cast("string"), 1000, "md5").alias("customer_id"),
    )


# PROMO is left out on purpose: it is out of vocabulary.
PART_TYPES = ["ECONOMY", "LARGE", "MEDIUM", "SMALL", "STANDARD"]
PART_TYPES_SQL = "['ECONOMY', 'LARGE', 'MEDIUM', 'SMALL', 'STANDARD']"


@query(
    "vocab_id",
    f"SELECT p_partkey, CAST(coalesce(list_position({PART_TYPES_SQL}, p_type), 0) - 1 AS BIGINT) AS type_id FROM part",
)
def vocab_id(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", cat.vocab_id(F.col("p_type"), PART_TYPES).alias("type_id"))


@query(
    "vocab_table",
    """WITH t AS (SELECT p_partkey, string_split(p_name, ' ') AS words, [p_type] AS types FROM part),
    v AS (SELECT list_sort(list_distinct(flatten(list(words)))) AS names, list_sort(list_distinct(list(types[1]))) AS kinds FROM t),
    ids AS (
      SELECT p_partkey, 'name' AS feature, unnest(range(len(words))) AS pos, unnest(list_transform(words, lambda w: list_position(names, w) - 1)) AS id FROM t, v
      UNION ALL SELECT p_partkey, 'type', 0, list_position(kinds, types[1]) - 1 FROM t, v)
    SELECT p_partkey, feature, CAST(pos AS INTEGER) AS pos, CAST(id AS BIGINT) AS id FROM ids""",
)
def vocab_table(spark, sf_dir):
    """Ids of all words of names and of all types, from one dictionary table that is built from the parts."""
    parts = table(spark, sf_dir, "part")
    tokens = {"name": split_multivalue(F.col("p_name"), " "), "type": F.array("p_type")}
    dictionary = vocabulary.build(parts, tokens)
    ids = vocabulary.with_vocabulary_ids(parts, "p_partkey", tokens, dictionary)
    long = [ids.select("p_partkey", F.lit(f).alias("feature"), F.posexplode(f).alias("pos", "id")) for f in tokens]
    return long[0].unionByName(long[1])


@query(
    "identity_id",
    "SELECT p_partkey, CAST(CASE WHEN p_size BETWEEN 0 AND 39 THEN p_size ELSE 0 END AS BIGINT) AS size_id FROM part",
)
def identity_id(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", cat.identity_id(F.col("p_size"), 40).alias("size_id"))


LINE_KEYS = ["l_orderkey", "l_linenumber", "l_partkey"]


def _lines(spark, sf_dir, **columns):
    lines = table(spark, sf_dir, "lineitem")
    return lines.select(*LINE_KEYS, *[c.alias(n) for n, c in columns.items()])


def _scaled_sql(name: str, expression: str) -> str:
    return f"SELECT l_orderkey, l_linenumber, l_partkey, round({expression}, 9) + 0.0 AS {name} FROM lineitem"


@query("scale_min_max", _scaled_sql("scaled", "(l_extendedprice - 900.0) / (105000.0 - 900.0)"))
def scale_min_max(spark, sf_dir):
    return _lines(spark, sf_dir, scaled=rounded(scale(F.col("l_extendedprice"), "min_max", (900.0, 105000.0))))


@query("scale_standard", _scaled_sql("scaled", "(l_quantity - 25.5) / 14.43"))
def scale_standard(spark, sf_dir):
    return _lines(spark, sf_dir, scaled=rounded(scale(F.col("l_quantity"), "standard", (25.5, 14.43))))


@query("scale_log", _scaled_sql("scaled", "ln(l_quantity)"))
def scale_log(spark, sf_dir):
    return _lines(spark, sf_dir, scaled=rounded(scale(F.col("l_quantity"), "log")))


@query("scale_none", _scaled_sql("scaled", "l_discount"))
def scale_none(spark, sf_dir):
    return _lines(spark, sf_dir, scaled=rounded(scale(F.col("l_discount"), None)))


PRICE_BOUNDS = (5000.0, 10000.0, 20000.0, 40000.0, 80000.0)


@query(
    "bucketize",
    f"""SELECT l_orderkey, l_linenumber, l_partkey, CAST({bucket_sql('l_extendedprice', PRICE_BOUNDS)} AS BIGINT) AS price_bucket,
      CAST({bucket_sql('l_quantity', (10.0, 20.0, 30.0))} AS BIGINT) AS quantity_bucket FROM lineitem""",
)
def bucketize(spark, sf_dir):
    return _lines(
        spark,
        sf_dir,
        price_bucket=cat.bucketize(F.col("l_extendedprice"), list(PRICE_BOUNDS)),
        quantity_bucket=cat.bucketize(F.col("l_quantity"), [10.0, 20.0, 30.0]),
    )


@query(
    "cross_hash",
    f"SELECT o_orderkey, {md5_sql("o_orderpriority || chr(1) || o_orderstatus")} % 5000 AS cross_id FROM orders",
)
def cross_hash(spark, sf_dir):
    members = [F.col("o_orderpriority"), F.col("o_orderstatus")]
    return table(spark, sf_dir, "orders").select("o_orderkey", cat.cross_hash(members, 5000, "md5").alias("cross_id"))


@query(
    "cross_multivalue",
    f"""WITH t AS (SELECT page_id, list_filter(string_split(string_split(url, '/')[3], '.'), lambda t: t <> '') AS hosts,
      list_filter(string_split(url, '/'), lambda t: t <> '') AS parts FROM pages),
    h AS (SELECT page_id, parts, unnest(hosts) AS host FROM t),
    p AS (SELECT page_id, host, unnest(parts) AS part FROM h)
    SELECT page_id, {md5_sql("host || chr(1) || part")} % 10000 AS cross_id FROM p""",
)
def cross_multivalue(spark, sf_dir):
    hosts = split_multivalue(F.get(F.split("url", "/"), 2), ".")
    parts = split_multivalue(F.col("url"), "/")
    crossed = cat.cross_hash_tokens([hosts, parts], 10000, "md5")
    return table(spark, sf_dir, "pages").select("page_id", F.explode(crossed).alias("cross_id"))


@query(
    "cross_mixed",
    f"""WITH {LOG} SELECT event_id,
      {md5_sql(f"user_id || chr(1) || {VALUE_BUCKET} || chr(1) || (CASE WHEN hour BETWEEN 0 AND 11 THEN hour ELSE 0 END)")} % 3000 AS cross_id
    FROM log""",
)
def cross_mixed(spark, sf_dir):
    spec = ModelSpec(
        fields=("clk", "user_id", "hour", "value"),
        features=(HashBucket("user_id", 1000), Identity("hour", 12), Continuous("value", None, None, VALUE_BOUNDS)),
        crosses=(Cross(("user_id", "value", "hour"), 3000),),
    )
    crossed = sparse.with_column_ids(impressions(spark, sf_dir), spec, {"cross_ids": spec.crosses[0]}, "md5")
    return crossed.select("event_id", F.explode_outer("cross_ids").alias("cross_id"))


NAME_WORDS = "blue cold hot large new old red anvil bolt gear gizmo plate ring rod widget".split()


@query(
    "multi_hot",
    f"""WITH t AS (SELECT p_partkey, string_split(p_name, ' ') AS words FROM part),
    v AS (SELECT unnest(range({len(NAME_WORDS)})) AS dim, unnest({NAME_WORDS!r}) AS word)
    SELECT p_partkey, CAST(dim AS INTEGER) AS dim, CAST(len(list_filter(words, lambda w: w = word)) AS DOUBLE) AS n FROM t, v""",
)
def multi_hot(spark, sf_dir):
    ids = cat.vocab_id_tokens(split_multivalue(F.col("p_name"), " "), NAME_WORDS)
    hot = table(spark, sf_dir, "part").select("p_partkey", cat.multi_hot(ids, len(NAME_WORDS)).alias("hot"))
    return hot.select("p_partkey", F.posexplode("hot").alias("dim", "n"))


def part_spec(n_vectors: int) -> ModelSpec:
    """Names are the embedded column, with an id for each vector of the table."""
    return ModelSpec(
        fields=("label", "p_retailprice", "p_type", "p_size", "p_name"),
        features=(
            Continuous("p_retailprice", "min_max", (900.0, 1000.0)),
            Vocab("p_type", tuple(PART_TYPES)),
            Identity("p_size", 51),
            HashBucket("p_name", n_vectors),
        ),
    )


@query(
    "deep_input",
    f"""WITH tokens AS (SELECT p_partkey, unnest(string_split(p_name, ' ')) AS t FROM part),
    shape AS (SELECT n, CAST(pow(2, ceil(ln(pow(CAST(n AS DOUBLE), 0.25)))) AS BIGINT) AS width
      FROM (SELECT max(vec_id) + 1 AS n FROM embeddings)),
    ids AS (SELECT p_partkey, {md5_sql('t')} % n AS idx FROM tokens, shape),
    vectors AS (SELECT vec_id AS idx, unnest(range(width)) AS dim, CAST(unnest(embedding[1:width]) AS DOUBLE) AS v
      FROM embeddings, shape),
    means AS (SELECT p_partkey, dim + 57 AS pos, avg(v) AS v FROM ids JOIN vectors USING (idx) GROUP BY ALL),
    types AS (SELECT unnest(range(5)) AS i, unnest({PART_TYPES_SQL}) AS t), sizes AS (SELECT unnest(range(51)) AS i),
    dense AS (
      SELECT p_partkey, 0 AS pos, (p_retailprice - 900.0) / 100.0 AS v FROM part
      UNION ALL SELECT p_partkey, 1 + i, CASE WHEN p_type = t THEN 1.0 ELSE 0.0 END FROM part, types
      UNION ALL SELECT p_partkey, 6 + i, CASE WHEN p_size = i THEN 1.0 ELSE 0.0 END FROM part, sizes
      UNION ALL SELECT * FROM means)
    SELECT p_partkey, CAST(pos AS INTEGER) AS pos, round(v, 9) + 0.0 AS value FROM dense""",
)
def deep_input(spark, sf_dir):
    exploded = part_dense(spark, sf_dir).select("p_partkey", F.posexplode("deep").alias("pos", "v"))
    return exploded.select("p_partkey", "pos", rounded(F.col("v")).alias("value"))


def part_dense(spark, sf_dir):
    """The dense input of every part."""
    parts = table(spark, sf_dir, "part").withColumn("p_name", F.translate("p_name", " ", ","))
    spec = part_spec(vector_ids(spark, sf_dir))
    width = spec.deep_slots()[-1].width
    vectors = table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("idx"), F.slice("embedding", 1, width).alias("vector")
    )
    return sparse.deep_input(parts, spec, "p_partkey", {"p_name": vectors}, "md5")


@query("wide_input", f"WITH {LOG}, {EVENT_IDS} SELECT event_id, idx, CAST(count(*) AS DOUBLE) AS value FROM ids GROUP BY event_id, idx")
def wide_input(spark, sf_dir):
    return sparse.wide_input(impressions(spark, sf_dir), EVENT_SPEC, ["event_id"], "md5")


def fitted_spec(spark, sf_dir) -> ModelSpec:
    """A spec whose sizes come from the data: recommended hash sizes and the observed values of k.

    The report needs the number of values alone, so k's values are numbered and not collected.
    """
    log = impressions(spark, sf_dir)
    counts = profile.bucket_size_advice(log, ["user_id", "event_type"]).collect()  # one row per feature
    sizes = {r["feature"]: r["size_high"] for r in counts}
    n_values = profile.distinct_values(log, ["k"]).count()
    return ModelSpec(
        fields=EVENT_SPEC.fields,
        features=(
            HashBucket("user_id", sizes["user_id"]),
            HashBucket("event_type", sizes["event_type"]),
            Vocab("k", range(n_values)),
            Identity("hour", 24),
            Continuous("value", None, None, VALUE_BOUNDS),
        ),
        crosses=(Cross(("user_id", "hour"), 24 * sizes["user_id"]),),
    )


SIZE_HIGH = "CAST(ceil(CASE WHEN n <= 100 THEN 4.0 WHEN n > 10000 THEN 2.0 ELSE 3.0 END * n) AS BIGINT)"


def _width_sql(size: str) -> str:
    return f"CAST(pow(2, ceil(ln(pow(CAST({size} AS DOUBLE), 0.25)))) AS BIGINT)"


@query(
    "dimension_report",
    f"""WITH {LOG}, u AS (SELECT {SIZE_HIGH} AS s FROM (SELECT count(DISTINCT user_id) AS n FROM log)),
    e AS (SELECT {SIZE_HIGH} AS s FROM (SELECT count(DISTINCT event_type) AS n FROM log)),
    k AS (SELECT count(DISTINCT k) AS s FROM log)
    SELECT 'user_id' AS "column", s AS wide_width, {_width_sql('s')} AS deep_width FROM u
    UNION ALL SELECT 'event_type', s, {_width_sql('s')} FROM e
    UNION ALL SELECT 'k', s, s FROM k
    UNION ALL SELECT 'hour', 24, 24 UNION ALL SELECT 'value', 6, 1
    UNION ALL SELECT 'user_id&hour', 24 * s, {_width_sql('24 * s')} FROM u""",
)
def dimension_report(spark, sf_dir):
    return sparse.dimension_report(spark, fitted_spec(spark, sf_dir))


WIDTH_FEATURES = ("user_id", "hour", "k", "event_type", "dt", "event_id")


@query(
    "embedding_dim",
    f"""WITH {LOG}, counts AS ({' UNION ALL '.join(
        f"SELECT '{f}' AS feature, count(DISTINCT {f}) AS n FROM log" for f in WIDTH_FEATURES)})
    SELECT feature, {SIZE_HIGH} AS size, {_width_sql(SIZE_HIGH)} AS width FROM counts""",
)
def embedding_dim(spark, sf_dir):
    advice = profile.bucket_size_advice(impressions(spark, sf_dir), list(WIDTH_FEATURES))
    size = F.col("size_high")
    return advice.select("feature", size.alias("size"), embedding_width(size).alias("width"))


@query(
    "feature_spec",
    """WITH parts AS (SELECT max(len(list_filter(string_split(p_name, ' '), lambda t: t <> ''))) AS n FROM part)
    SELECT 'p_retailprice' AS feature, 'fixed' AS length, 'float' AS type, CAST(1 AS BIGINT) AS longest
    UNION ALL SELECT 'p_type', 'variable', 'string', 1
    UNION ALL SELECT 'p_size', 'variable', 'int', 1
    UNION ALL SELECT 'p_name', 'variable', 'string', n FROM parts""",
)
def feature_spec(spark, sf_dir):
    """The parse spec with the most values that any row has."""
    spec = part_spec(500)
    parts = table(spark, sf_dir, "part").withColumn("p_name", F.translate("p_name", " ", ","))
    longest = {
        n: F.max(F.size(split_multivalue(F.col(n))) if spec.field_type(n) == "string" else F.lit(1)) for n in spec.names("used")
    }
    observed = parts.agg(*[c.cast("bigint").alias(n) for n, c in longest.items()])
    rows = [
        F.struct(
            F.lit(name).alias("feature"), F.lit(length).alias("length"), F.lit(kind).alias("type"), F.col(name).alias("longest")
        )
        for name, length, kind in feature_spec_rows(spec)
    ]
    return observed.select(F.inline(F.array(*rows)))


X = "((l_quantity - 25.0) / 4.0 + l_discount)"
ACTIVATION_SQL = {
    "sigmoid": f"1.0 / (1.0 + exp(-{X}))",
    "tanh": f"(exp({X}) - exp(-{X})) / (exp({X}) + exp(-{X}))",
    "relu": f"greatest({X}, 0.0)",
    "relu6": f"least(greatest({X}, 0.0), 6.0)",
    "leaky_relu": f"CASE WHEN {X} < 0 THEN 0.2 * {X} ELSE {X} END",
    "crelu_pos": f"greatest({X}, 0.0)",
    "crelu_neg": f"greatest(-{X}, 0.0)",
    "elu": f"CASE WHEN {X} < 0 THEN exp({X}) - 1 ELSE {X} END",
    "selu": f"1.0507009873554805 * CASE WHEN {X} < 0 THEN 1.6732632423543772 * (exp({X}) - 1) ELSE {X} END",
    "softplus": f"ln(1 + exp({X}))",
    "softsign": f"{X} / (1 + abs({X}))",
}


@query(
    "activations",
    "SELECT l_orderkey, l_linenumber, l_partkey, "
    + ", ".join(f"round({e}, 7) + 0.0 AS {n}" for n, e in ACTIVATION_SQL.items())
    + " FROM lineitem",
)
def activations(spark, sf_dir):
    x = (F.col("l_quantity") - 25.0) / 4.0 + F.col("l_discount")
    columns = {n: rounded(activation(x, n), 7) for n in ACTIVATIONS if n != "crelu"}
    both = activation(x, "crelu")
    columns |= {"crelu_pos": rounded(F.get(both, 0), 7), "crelu_neg": rounded(F.get(both, 1), 7)}
    return _lines(spark, sf_dir, **columns)

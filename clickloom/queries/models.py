"""Training, scoring and evaluation queries."""

from __future__ import annotations

import numpy as np
from pyspark.ml.classification import MultilayerPerceptronClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from clickloom.functions import heads
from clickloom.functions.clean import class_weight
from clickloom.functions.numeric import sigmoid
from clickloom.operators import deep_training, ftrl, metrics, networks, solver, sparse
from clickloom.plans import scoring, training
from clickloom.queries.base import EVENT_IDS, EVENT_SPEC, LOG, impressions, md5_sql, query, rounded, table, vector_ids
from clickloom.queries.features import part_dense, part_spec
from clickloom.session import scratch_path, staged
from clickloom.sinks.models import export_model

# --- sparse linear model -------------------------------------------------------------------------


def _examples(spark, sf_dir, *keep):
    log = sparse.with_wide_ids(impressions(spark, sf_dir), EVENT_SPEC, "md5", "_ids")
    return ftrl.examples(log, "event_id", F.col("clk"), F.col("_ids"), keep=list(keep))


# The spec allows this many ids, and the bias is one more.
MAX_IDS = EVENT_SPEC.wide_dimension + 1

FTRL_INPUT = f"""WITH {LOG}, {EVENT_IDS},
  pairs AS (SELECT event_id, clk, day, idx FROM ids UNION ALL SELECT event_id, clk, day, -1 FROM log),
  s0 AS (SELECT DISTINCT idx, 0.0::DOUBLE AS z, 0.1::DOUBLE AS n, 0.0::DOUBLE AS w FROM pairs)"""


def _ftrl_step_sql(step: int, rows: str = "true", weight: str = "1.0::DOUBLE") -> str:
    """Common table expressions that turn state s<step-1> into s<step> with the chosen rows and their weights."""
    return f"""p{step} AS (SELECT event_id, any_value(clk) AS clk, 1.0 / (1.0 + exp(-sum(w))) AS p
      FROM pairs JOIN s{step - 1} USING (idx) WHERE {rows} GROUP BY event_id),
    g{step} AS (SELECT idx, sum({weight} * (p - p{step}.clk)) AS g FROM pairs JOIN p{step} USING (event_id) GROUP BY idx),
    u{step} AS (SELECT idx, z + coalesce(g, 0.0) - (sqrt(n + coalesce(g * g, 0.0)) - sqrt(n)) / 0.1 * w AS z,
      n + coalesce(g * g, 0.0) AS n FROM s{step - 1} LEFT JOIN g{step} USING (idx)),
    s{step} AS (SELECT idx, z, n, CASE WHEN abs(z) > 0.5
      THEN (sign(z) * 0.5 - z) / (sqrt(n) / 0.1 + 2.0) ELSE 0.0 END AS w FROM u{step})"""


# All evaluation metrics of the rows r<name>(z, y, p), as (metric, value) rows m<name>.
def _evaluation_sql(name, digits: int = 6) -> str:
    metrics_ = {
        "accuracy": "avg(CASE WHEN (z > 0) = (y = 1) THEN 1.0 ELSE 0.0 END)",
        "accuracy_baseline": "greatest(avg(y), 1 - avg(y))",
        "average_loss": "avg(loss)",
        "label_mean": "avg(y)",
        "loss": "sum(loss)",
        "n_rows": "CAST(count(*) AS DOUBLE)",
        "prediction_mean": "avg(p)",
    }
    rows = f"(SELECT *, greatest(z, 0.0) - z * y + ln(1 + exp(-abs(z))) AS loss FROM r{name})"
    plain = [f"SELECT '{m}' AS metric, round({e}, {digits}) AS value FROM {rows}" for m, e in metrics_.items()]
    curves = [
        f"SELECT 'auc', round(sum(neg * (tp - pos + tp) / 2) / (sum(pos) * sum(neg)), {digits}) FROM d{name}",
        f"SELECT 'auc_precision_recall', round(sum(pos * (here + before) / 2) / sum(pos), {digits}) FROM d{name}",
    ]
    return f"""b{name} AS (SELECT least(greatest(ceil(p * 199) - 1, 0), 198) AS bin, sum(y)::DOUBLE AS pos,
      sum(1 - y)::DOUBLE AS neg FROM r{name} GROUP BY bin),
    c{name} AS (SELECT *, sum(pos) OVER (ORDER BY bin DESC) AS tp, sum(neg) OVER (ORDER BY bin DESC) AS fp FROM b{name}),
    d{name} AS (SELECT *, tp / (tp + fp) AS here, CASE WHEN tp + fp - pos - neg = 0 THEN tp / (tp + fp)
      ELSE (tp - pos) / (tp + fp - pos - neg) END AS before FROM c{name}),
    m{name} AS ({' UNION ALL '.join([*plain, *curves])})"""


def _scored_sql(name, state: int, rows: str) -> str:
    return f"""r{name} AS (SELECT z, y, 1.0 / (1.0 + exp(-z)) AS p FROM (
      SELECT sum(w) AS z, any_value(clk) AS y FROM pairs JOIN s{state} USING (idx) WHERE {rows} GROUP BY event_id))"""


DAY_NUMBER = "datediff('day', DATE '2024-01-01', day)"


def _walk_forward_sql(weeks: int = 5) -> str:
    ctes, results = [FTRL_INPUT], []
    for week in range(weeks - 1):
        here, following = (f"{DAY_NUMBER} // 7 = {w}" for w in (week, week + 1))
        ctes += [_ftrl_step_sql(week + 1, here), _scored_sql(week, week + 1, following), _evaluation_sql(week)]
        results.append(f"SELECT {week} AS train_part, {week + 1} AS test_part, 1 AS epoch, metric, value FROM m{week}")
    return f"{', '.join(ctes)} {' UNION ALL '.join(results)}"


def _epochs_sql(epochs: int = 2, parts: int = 2, epochs_per_test: int = 2) -> str:
    ctes, results, step = [FTRL_INPUT], [], 0
    for epoch in range(1, epochs + 1):
        for part in range(parts):
            step += 1
            ctes += [_ftrl_step_sql(step, f"{DAY_NUMBER} // 12 = {part}"), _scored_sql(step, step, f"{DAY_NUMBER} // 12 = 2")]
            ctes.append(_evaluation_sql(step))
            results.append(f"SELECT {epoch} AS epoch, '{part}' AS part, metric, value FROM m{step}")
        if epoch % epochs_per_test == 0:
            results.append(f"SELECT {epoch} AS epoch, 'test' AS part, metric, value FROM m{step}")
    return f"{', '.join(ctes)} {' UNION ALL '.join(results)}"


STATE_SQL = "round(z, 7) + 0.0 AS z, round(n, 4) AS n, round(w, 7) + 0.0 AS w"


def _ftrl_sql(steps: int) -> str:
    chain = ", ".join(_ftrl_step_sql(s) for s in range(1, steps + 1))
    return f"{FTRL_INPUT}, {chain} SELECT idx, {STATE_SQL} FROM s{steps}"


# The bias sums up to 1e9 and more in n, where a double has no seventh decimal.
STATE_DIGITS = {"z": 7, "n": 4, "w": 7}


def _rounded_state(state, *more):
    return state.select("idx", *[rounded(F.col(c), digits).alias(c) for c, digits in STATE_DIGITS.items()], *more)


@query("ftrl_step", _ftrl_sql(1))
def ftrl_step(spark, sf_dir):
    return _rounded_state(ftrl.step(_examples(spark, sf_dir), ftrl.empty_state(spark), max_ids=MAX_IDS))


@query("ftrl_train", _ftrl_sql(3))
def ftrl_train(spark, sf_dir):
    return _rounded_state(ftrl.train(_examples(spark, sf_dir), steps=3, max_ids=MAX_IDS))


@query("ftrl_resume", _ftrl_sql(2))
def ftrl_resume(spark, sf_dir):
    """One step, stored and read again, then one more: the same as two steps."""
    data, base = _examples(spark, sf_dir), scratch_path(spark, "resume")
    export_model(ftrl.train(data, steps=1, max_ids=MAX_IDS), base, 1, EVENT_SPEC)
    saved = spark.read.schema(ftrl.STATE_SCHEMA).parquet(f"{base}/version=1")
    return _rounded_state(ftrl.train(data, saved, steps=1, max_ids=MAX_IDS))


def _batches_sql(steps: int, batches: int) -> str:
    number = md5_sql("CAST(event_id AS VARCHAR)")
    rows = [f"{number} % {batches} = {batch}" for _ in range(steps) for batch in range(batches)]
    chain = ", ".join(_ftrl_step_sql(s, r) for s, r in enumerate(rows, 1))
    return f"{FTRL_INPUT}, {chain} SELECT idx, {STATE_SQL} FROM s{len(rows)}"


@query("ftrl_batches", _batches_sql(2, 3))
def ftrl_batches(spark, sf_dir):
    """Two passes with three updates each."""
    return _rounded_state(ftrl.train(_examples(spark, sf_dir), steps=2, max_ids=MAX_IDS, batches=3))


POSITIVE, NEGATIVE = 2.0, 0.5
CLASS_WEIGHT_SQL = f"(CASE WHEN p{{step}}.clk = 1 THEN {POSITIVE} ELSE {NEGATIVE} END)::DOUBLE"


@query(
    "ftrl_weighted",
    f"""{FTRL_INPUT}, {_ftrl_step_sql(1, weight=CLASS_WEIGHT_SQL.format(step=1))},
    {_ftrl_step_sql(2, weight=CLASS_WEIGHT_SQL.format(step=2))} SELECT idx, {STATE_SQL} FROM s2""",
)
def ftrl_weighted(spark, sf_dir):
    """Two passes in which clicks weigh more than other rows."""
    data = _weighted_examples(spark, sf_dir)
    return _rounded_state(ftrl.train(data, steps=2, max_ids=MAX_IDS))


@query(
    "wide_salted_logit",
    f"""{FTRL_INPUT}, {_ftrl_step_sql(1)} SELECT event_id, round(sum(w), 7) + 0.0 AS logit
    FROM pairs JOIN s1 USING (idx) GROUP BY event_id""",
)
def wide_salted_logit(spark, sf_dir):
    """Scoring without a bound on the weight table: the lookup that salts hot ids."""
    data = _examples(spark, sf_dir)
    state = ftrl.train(data, steps=1, max_ids=MAX_IDS)
    return ftrl.score(data, state, None, []).select(F.col("id").alias("event_id"), rounded(F.col("logit"), 7).alias("logit"))


REG, MIX = 0.001, 0.3


def _weighted_examples(spark, sf_dir):
    log = sparse.with_wide_ids(impressions(spark, sf_dir), EVENT_SPEC, "md5", "_ids")
    weight = class_weight(F.col("clk"), POSITIVE, NEGATIVE)
    return ftrl.examples(log, "event_id", F.col("clk"), F.col("_ids"), weight)


@query("wide_lr")
def wide_lr(spark, sf_dir):
    """All features and crosses of the spec with class weights, fitted by the library's elastic-net solver."""
    data = _weighted_examples(spark, sf_dir)
    weights = solver.fit(data, EVENT_SPEC.wide_dimension, REG, MIX)
    scored = ftrl.score(data, weights, MAX_IDS, [])
    return scored.select(F.col("id").alias("event_id"), F.round(sigmoid(F.col("logit")), 4).alias("probability"))


@query(
    "wide_lr_optimum",
    f"{FTRL_INPUT} SELECT count(DISTINCT idx) AS n_ids, true AS at_minimum, true AS beats_prior FROM pairs",
)
def wide_lr_optimum(spark, sf_dir):
    """Whether the solver's weights are a minimum of the objective, and better than a bias alone."""
    data = _weighted_examples(spark, sf_dir)
    weights = solver.fit(data, EVENT_SPEC.wide_dimension, REG, MIX)
    report = solver.excess(data, weights, MAX_IDS, REG, MIX).agg(
        F.count(F.lit(1)).alias("n_ids"), (F.max("excess") < 1e-5).alias("at_minimum")
    )
    better = solver.gain(data, weights, MAX_IDS) > 1e-9
    return report.withColumn("beats_prior", F.lit(better))


@query("walk_forward", _walk_forward_sql())
def walk_forward(spark, sf_dir):
    """Train on one week, evaluate on the next."""
    week = F.floor(F.datediff(F.col("day"), F.lit("2024-01-01").cast("date")) / 7).cast("int").alias("week")
    results, _ = training.walk_forward(_examples(spark, sf_dir, week), "week", max_ids=MAX_IDS)
    return results.select("train_part", "test_part", "epoch", "metric", F.round("value", 6).alias("value"))


@query("epoch_metrics", _epochs_sql())
def epoch_metrics(spark, sf_dir):
    """Two epochs over two files with the last days held out."""
    part = F.floor(F.datediff(F.col("day"), F.lit("2024-01-01").cast("date")) / 12).cast("int").alias("part")
    data = _examples(spark, sf_dir, part)
    results, _ = training.epoch_metrics(data, "part", F.col("part") == 2, epochs=2, epochs_per_test=2, max_ids=MAX_IDS)
    return results.select("epoch", "part", "metric", F.round("value", 6).alias("value"))


@query(
    "score_version",
    f"""{FTRL_INPUT}, {_ftrl_step_sql(1)}, {_ftrl_step_sql(2)},
    l AS (SELECT event_id AS id, sum(w) AS z FROM pairs JOIN s1 USING (idx) GROUP BY event_id)
    SELECT id, CASE WHEN z > 0 THEN 1 ELSE 0 END AS class_id, round(1 / (1 + exp(-z)), 7) AS probability FROM l""",
)
def score_version(spark, sf_dir):
    """Two versions are stored; the first one is asked for."""
    data, base = _examples(spark, sf_dir), scratch_path(spark, "versions")
    state = ftrl.train(data, steps=1, max_ids=MAX_IDS)
    export_model(state, base, 1)
    export_model(ftrl.train(data, state, steps=1, max_ids=MAX_IDS), base, 2)
    scored = scoring.score_version(data, base, version=1, max_ids=MAX_IDS)
    return scored.select("id", "class_id", rounded(F.col("probability"), 7).alias("probability"))


# --- networks ------------------------------------------------------------------------------------

HIDDEN = [6, 5, 4]


def _weight(i, j, layer, net):
    """A fixed kernel value; the same arithmetic works on numbers, arrays and in SQL."""
    return ((i * 7 + j * 13 + layer * 5 + net * 3) % 17 - 8) / 32.0


def make_network(mode, hidden, n_inputs, net=0, units=1, activation="relu", norm=False):
    widths = networks.layer_inputs(mode, n_inputs, hidden)
    pairs = []
    for layer, (rows, cols) in enumerate(zip(widths, [*hidden, units], strict=True)):
        i, j = np.meshgrid(np.arange(rows), np.arange(cols), indexing="ij")
        pairs.append((_weight(i, j, layer, net), ((np.arange(cols) * 3 + layer + net) % 5 - 2) / 16.0))
    norms = None
    if norm:
        norms = []
        for cols in hidden:
            j = np.arange(cols)
            norms.append(networks.Norm(j % 3 / 8.0, 1 + j % 2 / 2.0, 1 + j % 4 / 8.0, (j % 5 - 2) / 16.0))
    return networks.Network(mode, pairs[:-1], pairs[-1], activation, norms)


def _network_sql(mode, hidden, net=0, norm=False, units=1, n_inputs=64) -> str:
    """Common table expressions of a network's forward pass; the last one is z<net>(vec_id, i, v)."""
    n, ctes, blocks = len(hidden), [], {}
    blocks["x"] = ("x0", n_inputs)

    def concat(name, parts):
        offset, selects = 0, []
        for part in parts:
            source, width = blocks[part]
            selects.append(f"SELECT vec_id, i + {offset} AS i, v FROM {source}")
            offset += width
        ctes.append(f"{name}_{net} AS ({' UNION ALL '.join(selects)})")
        blocks[name] = (f"{name}_{net}", offset)

    def dense(name, source, layer, width, hidden_layer):
        kernel = f"(((i * 7 + j * 13 + {layer * 5 + net * 3}) % 17 - 8) / 32.0::DOUBLE)"
        bias = f"(((j * 3 + {layer + net}) % 5 - 2) / 16.0::DOUBLE)"
        value = f"sum(v * {kernel}) + {bias}"
        if hidden_layer:
            value = f"greatest({value}, 0.0)"
            if norm:
                value = (
                    f"({value} - j % 3 / 8.0::DOUBLE) / sqrt(1 + j % 2 / 2.0::DOUBLE + 0.001) * (1 + j % 4 / 8.0::DOUBLE)"
                    " + (j % 5 - 2) / 16.0::DOUBLE"
                )
        ctes.append(
            f"{name}_{net} AS (SELECT vec_id, j AS i, {value} AS v FROM {blocks[source][0]}, (SELECT unnest(range({width})) AS j)"
            " GROUP BY vec_id, j)"
        )
        blocks[name] = (f"{name}_{net}", width)

    links = None if isinstance(mode, str) else networks.parse_links(mode, n)
    blocks["o0"] = blocks["x"]
    for layer, width in enumerate(hidden):
        h, o = f"h{layer + 1}", f"o{layer + 1}"
        dense(h, f"o{layer}", layer, width, True)
        earlier = [f"h{i}" for i in range(1, layer + 2)]
        parts = {
            "first_dense": [h, "x"],
            "dense": ["x", *earlier],
            "resnet": [h, f"o{layer}"],
        }.get(mode if isinstance(mode, str) else "", [h])
        if links is not None:
            parts = [*[f"o{i}" for i in links[layer + 1]], h]
        concat(o, parts)
    last = f"o{n}"
    if mode == "last_dense":
        concat("all", ["x", *[f"h{i}" for i in range(1, n + 1)]])
        last = "all"
    dense("z", last, n, units, False)
    return ", ".join(ctes)


X0 = "x0 AS (SELECT vec_id, CAST(unnest(range(64)) AS BIGINT) AS i, CAST(unnest(embedding) AS DOUBLE) AS v FROM embeddings)"
LINKS = ["0-1", "0-3", "1-2"]


def _score_sql(mode, norm=False):
    return f"WITH {X0}, {_network_sql(mode, HIDDEN, norm=norm)} SELECT vec_id, round(v, 7) + 0.0 AS logit FROM z_0"


def _score(spark, sf_dir, nets):
    scored = networks.score_networks(table(spark, sf_dir, "embeddings"), nets, "embedding", ["vec_id"])
    return scored.select("vec_id", rounded(F.get("logits", 0), 7).alias("logit"))


@query("deep_simple", _score_sql("simple", norm=True))
def deep_simple(spark, sf_dir):
    return _score(spark, sf_dir, [make_network("simple", HIDDEN, 64, norm=True)])


@query("deep_first_dense", _score_sql("first_dense"))
def deep_first_dense(spark, sf_dir):
    return _score(spark, sf_dir, [make_network("first_dense", HIDDEN, 64)])


@query("deep_last_dense", _score_sql("last_dense"))
def deep_last_dense(spark, sf_dir):
    return _score(spark, sf_dir, [make_network("last_dense", HIDDEN, 64)])


@query("deep_dense", _score_sql("dense"))
def deep_dense(spark, sf_dir):
    return _score(spark, sf_dir, [make_network("dense", HIDDEN, 64)])


@query("deep_resnet", _score_sql("resnet"))
def deep_resnet(spark, sf_dir):
    return _score(spark, sf_dir, [make_network("resnet", HIDDEN, 64)])


@query("deep_links", _score_sql(LINKS))
def deep_links(spark, sf_dir):
    return _score(spark, sf_dir, [make_network(LINKS, HIDDEN, 64)])


MULTI_HIDDEN = [[6, 5], [4]]


@query(
    "deep_multi",
    f"""WITH {X0}, {_network_sql('simple', MULTI_HIDDEN[0], 0)}, {_network_sql('simple', MULTI_HIDDEN[1], 1)}
    SELECT vec_id, round(z_0.v + z_1.v, 7) + 0.0 AS logit FROM z_0 JOIN z_1 USING (vec_id)""",
)
def deep_multi(spark, sf_dir):
    """Two networks with one mode for both; their logits are added."""
    nets = networks.broadcast_modes(MULTI_HIDDEN, "simple")
    return _score(spark, sf_dir, [make_network(mode, hidden, 64, net) for net, (hidden, mode) in enumerate(nets)])


# Dense input of EVENT_SPEC: user 4, k 100, hour 24, value 1, user&hour 8, k&hour 4. Zeros are left out.
DEEP_EVENTS = f"""f AS (SELECT event_id, value, CAST(k AS BIGINT) AS k, hour, {md5_sql('user_id')} % 1000 AS u,
    {md5_sql("user_id || chr(1) || hour")} % 5000 AS uh, {md5_sql("k || chr(1) || hour")} % 2000 AS kh FROM log),
  x0 AS (SELECT event_id AS vec_id, 128 AS i, value / 500.0 AS v FROM f
    UNION ALL SELECT event_id, 4 + k, 1.0 FROM f UNION ALL SELECT event_id, 104 + hour, 1.0 FROM f
    UNION ALL SELECT event_id, unnest(range(4)), unnest(embedding[1:4])::DOUBLE FROM f JOIN embeddings ON u = vec_id
    UNION ALL SELECT event_id, 129 + unnest(range(8)), unnest(embedding[1:8])::DOUBLE FROM f JOIN embeddings ON uh = vec_id
    UNION ALL SELECT event_id, 137 + unnest(range(4)), unnest(embedding[1:4])::DOUBLE FROM f JOIN embeddings ON kh = vec_id)"""


@query(
    "joint_predict",
    f"""{FTRL_INPUT}, {_ftrl_step_sql(1)}, {DEEP_EVENTS}, {_network_sql('first_dense', [6, 4], n_inputs=141)},
    wide AS (SELECT event_id, sum(w) AS z FROM pairs JOIN s1 USING (idx) GROUP BY event_id)
    SELECT event_id, CASE WHEN z + v > 0 THEN 1 ELSE 0 END AS class_id, round(1.0 / (1.0 + exp(-(z + v))), 7) AS probability
    FROM wide JOIN z_0 ON event_id = vec_id""",
)
def joint_predict(spark, sf_dir):
    """Raw features to predictions: sparse weights of one training step plus a network."""
    rows = impressions(spark, sf_dir)
    state = ftrl.train(_examples(spark, sf_dir), steps=1, max_ids=MAX_IDS)
    vectors = table(spark, sf_dir, "embeddings")
    tables = {
        slot.name: vectors.select(F.col("vec_id").alias("idx"), F.slice("embedding", 1, slot.width).alias("vector"))
        for slot in EVENT_SPEC.deep_slots()
        if slot.how == "embedding"
    }
    nets = [make_network("first_dense", [6, 4], EVENT_SPEC.deep_dimension)]
    logits = scoring.joint_logits(rows, EVENT_SPEC, "event_id", "joint", state, nets, tables, "md5")
    return scoring.predict(logits, "logit", ["event_id"]).select(
        "event_id", "class_id", rounded(F.col("probability"), 7).alias("probability")
    )


@query("deep_train")
def deep_train(spark, sf_dir):
    """Train the simple topology with the library's perceptron (sigmoid hidden units)."""
    data = table(spark, sf_dir, "embeddings").select(
        "vec_id", F.col("label").cast("double").alias("label"), array_to_vector("embedding").alias("features")
    )
    model = MultilayerPerceptronClassifier(layers=[64, 12, 10], maxIter=20, seed=123).fit(data)
    return model.transform(data).select("vec_id", F.col("label").cast("int"), F.col("prediction").cast("int").alias("class_id"))


SMALL_PART = 20


@query("deep_fit", "SELECT count(*) AS n_rows, true AS loss_falls, true AS beats_prior, true AS beats_majority FROM part")
def deep_fit(spark, sf_dir):
    """Train the plain topology on the spec's dense input of parts: does the loss fall, and does it beat constants?

    Small parts are asked for, and weigh twice as much as others in the loss.
    """
    dense = part_dense(spark, sf_dir)
    label = (F.col("p_size") < SMALL_PART).cast("double")
    parts = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), label.alias("label"))
    data = dense.withColumnRenamed("p_partkey", "id").join(parts, "id").select("id", "label", class_weight(F.col("label"), 2.0, 1.0).alias("weight"), F.col("deep").alias("features"))
    data = staged(data, "dense")
    width = part_spec(vector_ids(spark, sf_dir)).deep_dimension
    trained = deep_training.fit(data, deep_training.start(width, [16, 8], seed=7), epochs=8, batches=2, opt=deep_training.Adagrad(0.2))
    scored = networks.score_networks(data, [trained.network], "features", ["id", "label", "weight"])
    z = F.get("logits", 0)
    share = F.sum(F.col("weight") * F.col("label")) / F.sum("weight")
    prior = -(share * F.log(share) + (1 - share) * F.log(1 - share))
    loss = F.sum(heads.log_loss(z, F.col("label"), F.col("weight"))) / F.sum("weight")
    right = F.avg(((z > 0) == (F.col("label") == 1)).cast("double"))
    majority = F.greatest(F.avg("label"), 1 - F.avg("label"))
    told = scored.agg(F.count(F.lit(1)).alias("n_rows"), (loss < prior).alias("beats_prior"), (right > majority).alias("beats_majority"))
    falls = trained.losses[-1] < trained.losses[0]
    return told.select("n_rows", F.lit(falls).alias("loss_falls"), "beats_prior", "beats_majority")


# --- heads ---------------------------------------------------------------------------------------

# Three logits per line item; the deep one is missing for some rows, the image one for most.
WIDE = "((l_quantity - 25.0) / 10.0)"
DEEP = "(CASE WHEN l_linenumber % 3 <> 0 THEN l_discount * 20.0 - 1.0 END)"
IMAGE = "(CASE WHEN l_suppkey % 5 = 0 THEN l_tax * 30.0 END)"
JOINT = f"({WIDE} + coalesce({DEEP}, 0.0) + coalesce({IMAGE}, 0.0))"
LINE_KEYS = "l_orderkey, l_linenumber, l_partkey, l_suppkey"
LABEL = "(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END)"


def _scored_lines(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem")
    wide = (F.col("l_quantity") - 25.0) / 10.0
    deep = F.when(F.col("l_linenumber") % 3 != 0, F.col("l_discount") * 20.0 - 1.0)
    image = F.when(F.col("l_suppkey") % 5 == 0, F.col("l_tax") * 30.0)
    return lines.select(
        *LINE_KEYS.split(", "),
        (F.col("l_returnflag") == "R").cast("int").alias("label"),
        wide.alias("wide"),
        deep.alias("deep"),
        image.alias("image"),
        heads.joint_logit("joint", wide, deep, image).alias("logit"),
    )


@query(
    "joint_logit",
    f"""SELECT {LINE_KEYS}, round({JOINT}, 9) + 0.0 AS joint, round({WIDE}, 9) + 0.0 AS wide_only,
      round(coalesce({DEEP}, 0.0), 9) + 0.0 AS deep_only FROM lineitem""",
)
def joint_logit(spark, sf_dir):
    lines = _scored_lines(spark, sf_dir)
    wide, deep, image = F.col("wide"), F.col("deep"), F.col("image")
    return lines.select(
        *LINE_KEYS.split(", "),
        rounded(heads.joint_logit("joint", wide, deep, image)).alias("joint"),
        rounded(heads.joint_logit("wide", wide, deep)).alias("wide_only"),
        rounded(heads.joint_logit("deep", wide, deep)).alias("deep_only"),
    )


P = f"(1.0 / (1.0 + exp(-{JOINT})))"


@query(
    "binary_head",
    f"""SELECT {LINE_KEYS}, CASE WHEN {JOINT} > 0 THEN 1 ELSE 0 END AS class_id, round({P}, 7) AS p1, round(1 - {P}, 7) AS p0
    FROM lineitem""",
)
def binary_head(spark, sf_dir):
    z = F.col("logit")
    both = heads.binary_probabilities(z)
    return _scored_lines(spark, sf_dir).select(
        *LINE_KEYS.split(", "),
        heads.binary_class(z).alias("class_id"),
        rounded(F.get(both, 1), 7).alias("p1"),
        rounded(F.get(both, 0), 7).alias("p0"),
    )


@query(
    "softmax_head",
    """WITH x AS (SELECT vec_id, unnest(range(64)) AS i, CAST(unnest(embedding) AS DOUBLE) * 10 AS z FROM embeddings),
    s AS (SELECT vec_id, sum(exp(z)) AS total, max(z) AS top, arg_max(i, z) AS best FROM x GROUP BY vec_id)
    SELECT vec_id, CAST(best AS INTEGER) AS class_id, CAST(i AS INTEGER) AS class, round(exp(z) / total, 7) AS probability
    FROM x JOIN s USING (vec_id)""",
)
def softmax_head(spark, sf_dir):
    scores = F.transform("embedding", lambda v: v.cast("double") * 10)
    rows = table(spark, sf_dir, "embeddings").select("vec_id", scores.alias("scores"))
    predicted = rows.select(
        "vec_id", heads.argmax(F.col("scores")).alias("class_id"), F.posexplode(heads.softmax(F.col("scores"))).alias("class", "p")
    )
    return predicted.select("vec_id", "class_id", "class", rounded(F.col("p"), 7).alias("probability"))


@query(
    "predict",
    f"""SELECT {LINE_KEYS}, CASE WHEN {JOINT} > 0 THEN 1 ELSE 0 END AS class_id,
      round(100 * greatest(round({P}, 9), round(1 - {P}, 9)), 1) AS percent FROM lineitem""",
)
def predict(spark, sf_dir):
    return scoring.predict(_scored_lines(spark, sf_dir), "logit", LINE_KEYS.split(", ")).select(
        *LINE_KEYS.split(", "), "class_id", "percent"
    )


ROW_LOSS = f"(greatest({JOINT}, 0.0) - {JOINT} * {LABEL} + ln(1 + exp(-abs({JOINT}))))"


@query(
    "log_loss",
    f"""SELECT round(sum({ROW_LOSS} * w), 4) AS loss_sum, round(sum({ROW_LOSS} * w) / sum(w), 9) AS average_loss
    FROM (SELECT *, CASE WHEN {LABEL} = 1 THEN 2.0 ELSE 0.5 END::DOUBLE AS w FROM lineitem)""",
)
def log_loss(spark, sf_dir):
    lines = _scored_lines(spark, sf_dir).withColumn("w", F.when(F.col("label") == 1, 2.0).otherwise(0.5))
    summary = metrics.loss_summary(lines, "logit", "label", "w")
    return summary.select(rounded(F.col("loss_sum"), 4).alias("loss_sum"), rounded(F.col("average_loss")).alias("average_loss"))


@query(
    "accuracy_metrics",
    f"""SELECT round(avg(CASE WHEN ({JOINT} > 0) = ({LABEL} = 1) THEN 1.0 ELSE 0.0 END), 9) AS accuracy,
      round(greatest(avg({LABEL}), 1 - avg({LABEL})), 9) AS accuracy_baseline, round(avg({LABEL}), 9) AS label_mean,
      round(avg({P}), 9) AS prediction_mean FROM lineitem""",
)
def accuracy_metrics(spark, sf_dir):
    found = metrics.accuracy_metrics(_scored_lines(spark, sf_dir), "logit", "label")
    return found.select(*[rounded(F.col(c)).alias(c) for c in found.columns])


CURVE = f"""WITH s AS (SELECT {JOINT} AS score, sum({LABEL}) AS pos, sum(1 - {LABEL}) AS neg FROM lineitem GROUP BY score),
  c AS (SELECT *, sum(pos) OVER (ORDER BY score DESC) AS tp, sum(neg) OVER (ORDER BY score DESC) AS fp FROM s)"""


@query("auc", f"{CURVE} SELECT round(sum(neg * (tp - pos + pos / 2.0::DOUBLE)) / (sum(pos)::DOUBLE * sum(neg)), 9) AS auc FROM c")
def auc(spark, sf_dir):
    found = metrics.auc(_scored_lines(spark, sf_dir), "logit", "label")
    return found.select(rounded(F.col("auc")).alias("auc"))


@query(
    "auc_pr",
    f"""{CURVE}, d AS (SELECT pos, tp / CAST(tp + fp AS DOUBLE) AS here,
      CASE WHEN tp + fp - pos - neg = 0 THEN tp / CAST(tp + fp AS DOUBLE)
      ELSE (tp - pos) / CAST(tp + fp - pos - neg AS DOUBLE) END AS before FROM c)
    SELECT round(sum(pos * (here + before) / 2) / sum(pos), 9) AS auc_pr FROM d""",
)
def auc_pr(spark, sf_dir):
    found = metrics.auc_pr(_scored_lines(spark, sf_dir), "logit", "label")
    return found.select(rounded(F.col("auc_pr")).alias("auc_pr"))


@query(
    "evaluation",
    f"WITH r0 AS (SELECT {JOINT} AS z, {LABEL} AS y, {P} AS p FROM lineitem), {_evaluation_sql(0, 4)} SELECT * FROM m0",
)
def evaluation(spark, sf_dir):
    """All metrics in one pass, with curves over 200 thresholds."""
    found = metrics.evaluate(_scored_lines(spark, sf_dir), "logit", "label")
    return found.select("metric", rounded(F.col("value"), 4).alias("value"))


@query(
    "error_rate",
    """WITH x AS (SELECT vec_id, label, unnest(range(64)) AS i, unnest(embedding) AS z FROM embeddings),
    s AS (SELECT vec_id, any_value(label) AS label, arg_max(i, z) AS best FROM x GROUP BY vec_id)
    SELECT round(avg(CASE WHEN best <> label THEN 1.0 ELSE 0.0 END), 9) AS error_rate, count(*) AS n FROM s""",
)
def error_rate(spark, sf_dir):
    found = metrics.error_rate(table(spark, sf_dir, "embeddings"), F.col("embedding"), "label")
    return found.select(rounded(F.col("error_rate")).alias("error_rate"), "n")

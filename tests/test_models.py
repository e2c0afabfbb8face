import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from clickloom.functions.numeric import ACTIVATIONS, activation
from clickloom.operators import ftrl, lookup, metrics, networks, sparse
from clickloom.plans import scoring, training
from clickloom.sinks.models import export_model, load_model, network_from_table, network_table
from clickloom.spec import Continuous, Cross, HashBucket, Identity, ModelSpec, Vocab


def relu(x):
    return np.maximum(x, 0)


def random_network(mode, hidden, n_inputs, units=1, activation="relu", norm=False, seed=0):
    rng = np.random.default_rng(seed)
    widths = networks.layer_inputs(mode, n_inputs, hidden)
    pairs = [(rng.normal(size=(w, c)), rng.normal(size=c)) for w, c in zip(widths, [*hidden, units], strict=True)]
    norms = [networks.Norm(*rng.uniform(0.5, 2, size=(4, c))) for c in hidden] if norm else None
    return networks.Network(mode, pairs[:-1], pairs[-1], activation, norms)


def by_hand(net, x):
    """Each topology written out for three hidden layers."""
    (k1, b1), (k2, b2), (k3, b3) = net.layers
    ko, bo = net.output
    h1 = relu(x @ k1 + b1)
    cat = lambda *parts: np.concatenate(parts, axis=1)
    if net.mode == "simple":
        return relu(relu(h1 @ k2 + b2) @ k3 + b3) @ ko + bo
    if net.mode == "first_dense":
        h2 = relu(cat(h1, x) @ k2 + b2)
        h3 = relu(cat(h2, x) @ k3 + b3)
        return cat(h3, x) @ ko + bo
    if net.mode == "last_dense":
        h2 = relu(h1 @ k2 + b2)
        h3 = relu(h2 @ k3 + b3)
        return cat(x, h1, h2, h3) @ ko + bo
    if net.mode == "dense":
        h2 = relu(cat(x, h1) @ k2 + b2)
        h3 = relu(cat(x, h1, h2) @ k3 + b3)
        return cat(x, h1, h2, h3) @ ko + bo
    if net.mode == "resnet":
        o1 = cat(h1, x)
        o2 = cat(relu(o1 @ k2 + b2), o1)
        return cat(relu(o2 @ k3 + b3), o2) @ ko + bo
    # links 0-1, 0-3, 1-3
    o1 = cat(x, h1)
    h2 = relu(o1 @ k2 + b2)
    return cat(x, o1, relu(h2 @ k3 + b3)) @ ko + bo


@pytest.mark.parametrize("mode", [*networks.TOPOLOGIES, ["0-3", "0-1", "1-3"]], ids=str)
def test_topologies(spark, mode):
    x = np.random.default_rng(5).normal(size=(40, 6))
    net = random_network(mode, [5, 4, 3], 6, units=2)
    df = spark.createDataFrame([(i, row.tolist()) for i, row in enumerate(x)], "id long, f array<double>").repartition(3)
    got = {r["id"]: r["logits"] for r in networks.score_networks(df, [net], "f", ["id"]).collect()}
    np.testing.assert_allclose([got[i] for i in range(40)], by_hand(net, x))


def test_several_networks_add_up(spark):
    x = np.random.default_rng(6).normal(size=(10, 3))
    nets = [random_network(m, h, 3, seed=i) for i, (h, m) in enumerate(networks.broadcast_modes([[4], [5, 2]], "dense"))]
    df = spark.createDataFrame([(i, row.tolist()) for i, row in enumerate(x)], "id long, f array<float>")
    got = {r["id"]: r["logits"][0] for r in networks.score_networks(df, nets, "f", ["id"]).collect()}
    want = sum(networks.forward(n, x.astype(np.float32).astype(float)) for n in nets)[:, 0]
    np.testing.assert_allclose([got[i] for i in range(10)], want)


def test_normalisation_follows_the_activation():
    net = random_network("simple", [3], 2, norm=True)
    x = np.random.default_rng(7).normal(size=(4, 2))
    n = net.norms[0]
    h = (relu(x @ net.layers[0][0] + net.layers[0][1]) - n.mean) / np.sqrt(n.variance + 1e-3) * n.gamma + n.beta
    np.testing.assert_allclose(networks.forward(net, x), h @ net.output[0] + net.output[1])


def test_modes_for_several_networks():
    assert networks.broadcast_modes([4, 3], "simple") == [([4, 3], "simple")]
    assert networks.broadcast_modes([[4], [3]], ["simple", "dense"]) == [([4], "simple"), ([3], "dense")]
    assert networks.broadcast_modes([[4], [3]], ["0-1"]) == [([4], ["0-1"]), ([3], ["0-1"])]
    with pytest.raises(ValueError):
        networks.broadcast_modes([[4], [3]], ["simple", "dense", "resnet"])
    with pytest.raises(ValueError):
        networks.check_mode("lase_dense")
    with pytest.raises(ValueError):
        networks.parse_links(["2-1"], 3)
    assert networks.parse_links(["1-3", "0-3"], 3) == {1: [], 2: [], 3: [0, 1]}


@pytest.mark.parametrize("name", [a for a in ACTIVATIONS if a != "crelu"])
def test_activation_columns_equal_the_network_ones(spark, name):
    xs = [-30.0, -2.5, -0.1, 0.0, 0.1, 3.0, 7.5, 30.0]
    df = spark.createDataFrame([(x,) for x in xs], "x double")
    got = [r[0] for r in df.select(activation(F.col("x"), name)).collect()]
    np.testing.assert_allclose(got, networks._NUMPY_ACTIVATIONS[name](np.array(xs)), rtol=1e-9, atol=1e-12)


def test_unknown_activation(spark):
    with pytest.raises(ValueError, match="swish"):
        activation(F.lit(1.0), "swish")


def test_network_weight_table(spark):
    net = random_network("resnet", [3, 2], 4)
    again = network_from_table(network_table(spark, net), "resnet")
    x = np.random.default_rng(8).normal(size=(5, 4))
    np.testing.assert_allclose(networks.forward(again, x), networks.forward(net, x))


# --- sparse model ---------------------------------------------------------------------------------


def numpy_ftrl(rows, steps, rate=0.1, l1=0.5, l2=1.0, n0=0.1):
    z, n, w = {}, {}, {}
    for _ in range(steps):
        g = {}
        for label, weight, ids in rows:
            p = 1 / (1 + math.exp(-sum(w.get(i, 0.0) for i in ids)))
            for i in ids:
                g[i] = g.get(i, 0.0) + weight * (p - label)
        for i, gi in g.items():
            old = n.get(i, n0)
            new = old + gi * gi
            z[i] = z.get(i, 0.0) + gi - (math.sqrt(new) - math.sqrt(old)) / rate * w.get(i, 0.0)
            n[i] = new
            w[i] = 0.0 if abs(z[i]) <= l1 else (math.copysign(l1, z[i]) - z[i]) / (math.sqrt(new) / rate + 2 * l2)
    return {i: (z[i], n[i], w[i]) for i in z}


@pytest.fixture(scope="module")
def clicks(spark):
    """Clicks that depend on one of the two ids; one id is in a third of all rows, some rows have none."""
    rng = np.random.default_rng(9)
    rows = []
    for i in range(600):
        a, b = (0 if i % 3 == 0 else int(rng.integers(1, 12))), 100 + int(rng.integers(0, 5))
        label = int(rng.random() < (0.8 if a % 2 else 0.15))
        rows.append((i, float(label), 1.0 + (i % 4) / 4, [] if i % 97 == 0 else [-1, a, b, b] if i % 13 == 0 else [-1, a, b]))
    return spark.createDataFrame(rows, "id long, label double, weight double, ids array<bigint>").persist()


def state_of(df):
    return {r["idx"]: (r["z"], r["n"], r["w"]) for r in df.collect()}


def close(got, want):
    assert got.keys() == want.keys()
    for k in want:
        np.testing.assert_allclose(got[k], want[k], rtol=1e-9, atol=1e-9)


@pytest.mark.parametrize("way", ["proven", "counted", "salted"])
def test_training_equals_the_formula(spark, clicks, way, no_broadcast, monkeypatch):
    if way == "salted":
        monkeypatch.setattr("clickloom.operators.lookup.BROADCAST_ROWS", 0)
    rows = [(r["label"], r["weight"], r["ids"]) for r in clicks.collect()]
    trained = ftrl.train(clicks, steps=3, max_ids=200 if way == "proven" else None)
    close(state_of(trained), numpy_ftrl(rows, 3))
    scored = {r["id"]: r["logit"] for r in ftrl.score(clicks, trained, None, ["label"]).collect()}
    joined = {r["id"]: r["logit"] for r in ftrl.logits(clicks, trained, 200).collect()}
    assert scored == pytest.approx(joined) and len(scored) == len(rows)


def test_resuming_equals_training_on(spark, clicks, tmp_path):
    export_model(ftrl.train(clicks, steps=1, max_ids=200), str(tmp_path / "m"), 1)
    resumed = ftrl.train(clicks, load_model(spark, str(tmp_path / "m")), steps=1, max_ids=200)
    close(state_of(resumed), state_of(ftrl.train(clicks, steps=2, max_ids=200)))


def metrics_of(df):
    return {r["metric"]: r["value"] for r in df.collect()}


def test_training_improves_every_metric(spark, clicks):
    first = ftrl.train(clicks, steps=1, max_ids=200)
    trained = ftrl.train(clicks, first, steps=6, max_ids=200, batches=2)
    start = metrics_of(training.evaluation(clicks, ftrl.empty_state(spark), 200))
    end = metrics_of(training.evaluation(clicks, trained, 200))
    assert end["loss"] < start["loss"] and end["average_loss"] < start["average_loss"]
    assert start["auc"] == pytest.approx(0.5)
    for name in ("auc", "auc_precision_recall", "accuracy"):
        assert end[name] > start[name]


def test_walk_forward_trains_before_it_evaluates(spark, clicks):
    data = clicks.withColumn("day", (F.col("id") % 3).cast("string"))
    results, state = training.walk_forward(data, "day", epochs=2, max_ids=200)
    rows = results.collect()
    assert {(r["train_part"], r["test_part"], r["epoch"]) for r in rows} == {
        ("0", "1", 1), ("0", "1", 2), ("1", "2", 1), ("1", "2", 2),
    }
    want = None
    for day in ("0", "0", "1", "1"):
        want = ftrl.train(data.where(F.col("day") == day).drop("day"), want, 1, max_ids=200)
    close(state_of(state), state_of(want))
    last = metrics_of(training.evaluation(data.where("day = '2'").drop("day"), want, 200))
    got = {r["metric"]: r["value"] for r in rows if r["train_part"] == "1" and r["epoch"] == 2}
    assert got == pytest.approx(last)
    with pytest.raises(ValueError):
        training.walk_forward(data.where("day = '0'"), "day")


def test_epochs_report_every_file_and_the_test(spark, clicks):
    data = clicks.withColumn("file", (F.col("id") % 3).cast("string"))
    held_out = F.col("file") == "2"
    results, state = training.epoch_metrics(data, "file", held_out, epochs=2, epochs_per_test=2, max_ids=200)
    rows = results.collect()
    close(state_of(state), state_of(training.train_parts(data.where(~held_out), "file", epochs=2, max_ids=200)))
    assert {(r["epoch"], r["part"]) for r in rows} == {(1, "0"), (1, "1"), (2, "0"), (2, "1"), (2, "test")}
    losses = {(r["epoch"], r["part"]): r["value"] for r in rows if r["metric"] == "loss"}
    assert losses[2, "1"] == losses[2, "test"] < losses[1, "0"]


def test_versions(spark, clicks, tmp_path):
    base = str(tmp_path / "m")
    one = ftrl.train(clicks, steps=1, max_ids=200)
    export_model(one, base, 1)
    export_model(ftrl.train(clicks, one, steps=3, max_ids=200), base, 7)
    with pytest.raises(ValueError):
        export_model(one, base, 0)
    scored = {v: scoring.score_version(clicks, base, v, 200).collect() for v in (1, 7, None)}
    p = {v: {r["id"]: r["probability"] for r in rows} for v, rows in scored.items()}
    assert p[7] == pytest.approx(p[None]) and p[1] != pytest.approx(p[7])
    for r in scored[1]:
        assert r["probabilities"][1] == pytest.approx(r["probability"]) and sum(r["probabilities"]) == pytest.approx(1)
        assert r["class_id"] == int(r["probability"] > 0.5) and 50 <= r["percent"] <= 100


def test_joint_logits_add_what_the_model_type_uses(spark):
    spec = ModelSpec(
        ("clk", "u", "age"), (HashBucket("u", 30), Continuous("age", "min_max", (0.0, 10.0), (3.0, 6.0))), (Cross(("u", "age"), 64),)
    )
    rows = spark.createDataFrame([(0, "a", 1.0), (1, "b", 4.0), (2, "", 9.0), (3, "a,b", None)], "id long, u string, age double")
    state = spark.range(-1, spec.wide_dimension).select(
        F.col("id").alias("idx"), F.lit(0.0).alias("z"), F.lit(0.1).alias("n"), (F.col("id") % 5 / 4.0).alias("w")
    )
    tables = {
        s.name: spark.range(64).select(F.col("id").alias("idx"), F.array(*[F.col("id") * (d + 1) / 9.0 for d in range(s.width)]).alias("vector"))
        for s in spec.deep_slots()
        if s.how == "embedding"
    }
    nets = [random_network("dense", [4, 3], spec.deep_dimension)]
    image = spark.createDataFrame([(0, 2.5)], "id long, logit double")

    def logits(model_type, **parts):
        got = scoring.joint_logits(rows, spec, "id", model_type, **parts).collect()
        return np.array([r["logit"] for r in sorted(got, key=lambda r: r["id"])])

    wide, deep = logits("wide", state=state), logits("deep", networks=nets, tables=tables)
    assert len(wide) == len(deep) == 4 and (deep != 0).all()
    both = logits("joint", state=state, networks=nets, tables=tables, image=image)
    np.testing.assert_allclose(both, wide + deep + [2.5, 0, 0, 0])
    np.testing.assert_allclose(logits("wide", state=state, networks=nets, tables=tables), wide)


def test_joint_logits_like_its_parts(spark, monkeypatch):
    """One pass gives what the dense input, the networks and the sparse model give on their own, with any lookup."""
    spec = ModelSpec(
        ("clk", "u", "os", "h", "age"),
        (HashBucket("u", 30), Vocab("os", ("x", "y")), Identity("h", 4), Continuous("age", "standard", (1.0, 2.0), (3.0,))),
        (Cross(("u", "age"), 64), Cross(("os", "h"), 16, deep=False)),
    )
    rows = [(0, "a", "x", 1, 1.0), (1, "a,b,a", "y,x,x", 9, None), (2, None, None, None, None), (3, "", "z", 3, -2.0), (None, "b", "x", 0, 5.0)]
    rows = spark.createDataFrame(rows, "id long, u string, os string, h int, age double")
    state = spark.range(-1, spec.wide_dimension).select(F.col("id").alias("idx"), F.lit(0.0).alias("z"), F.lit(0.1).alias("n"), (F.col("id") % 5 / 4.0).alias("w"))
    tables = {
        s.name: spark.range(0, 64, 2).select(F.col("id").alias("idx"), F.array(*[F.col("id") * (d + 1) / 9.0 for d in range(s.width)]).alias("vector"))
        for s in spec.deep_slots()
        if s.how == "embedding"
    }
    nets = [random_network("dense", [4, 3], spec.deep_dimension), random_network("simple", [2], spec.deep_dimension)]
    dense = sparse.deep_input(rows, spec, "id", tables, "md5")
    deep = {r["id"]: r["logits"][0] for r in networks.score_networks(dense, nets, "deep", ["id"]).collect()}
    ids = ftrl.examples(sparse.with_wide_ids(rows, spec, "md5"), "id", F.lit(0), F.col("ids"))
    wide = {r["id"]: r["logit"] for r in ftrl.score(ids, state, 1000, []).collect()}
    for bound in (2_000_000, 0):
        monkeypatch.setattr(lookup, "BROADCAST_ROWS", bound)
        got = {r["id"]: r["logit"] for r in scoring.joint_logits(rows, spec, "id", "joint", state, nets, tables, "md5").collect()}
        assert set(got) == set(wide) and all(got[i] == pytest.approx(wide[i] + deep[i]) for i in (0, 1, 2, 3))


def test_network_tables_have_a_row_per_input(spark, tmp_path):
    net = random_network("last_dense", [300, 7], 40, units=3)
    stored = network_table(spark, net)
    assert stored.columns == ["layer", "input", "units"] and stored.count() == sum(k.shape[0] + 1 for k, _ in [*net.layers, net.output])
    stored.repartition(5).write.parquet(f"{tmp_path}/net")
    again = network_from_table(spark.read.parquet(f"{tmp_path}/net"), "last_dense")
    x = np.random.default_rng(1).normal(size=(9, 40))
    np.testing.assert_array_equal(networks.forward(again, x), networks.forward(net, x))
    bare = network_from_table(stored.where("input <> -1 and not (layer = 1 and input = 2)"), "last_dense")
    assert not bare.layers[0][1].any() and not bare.layers[1][0][2].any()


def test_networks_of_any_size_can_be_stored_and_sent(spark):
    """Sixty million weights, beyond what rows of single weights allowed."""
    n = 60_000
    net = networks.Network("simple", [(np.ones((n, 1000)) / n, np.zeros(1000))], (np.ones((1000, 1)) / 1000, np.zeros(1)))
    df = spark.range(3).select("id", F.array_repeat((F.col("id") + 1).cast("double"), n).alias("x"))
    got = {r["id"]: r["logits"][0] for r in networks.score_networks(df, [net], "x", ["id"]).collect()}
    assert got == {i: pytest.approx(i + 1.0) for i in range(3)}


# --- metrics --------------------------------------------------------------------------------------


def scored_rows(spark, n=400):
    rng = np.random.default_rng(10)
    scores = np.where(np.arange(n) % 3 == 0, 0.25, np.round(rng.normal(size=n), 1))
    labels = (rng.random(n) < 1 / (1 + np.exp(-scores))).astype(int)
    rows = [(float(s), int(y)) for s, y in zip(scores, labels, strict=True)]
    return spark.createDataFrame(rows, "z double, y int").repartition(4), scores, labels


def test_auc_counts_pairs(spark):
    df, scores, labels = scored_rows(spark)
    pos, neg = scores[labels == 1], scores[labels == 0]
    wins = (pos[:, None] > neg[None, :]).sum() + 0.5 * (pos[:, None] == neg[None, :]).sum()
    assert metrics.auc(df, "z", "y").first()[0] == pytest.approx(wins / (len(pos) * len(neg)))


def test_exact_curves_of_one_class_are_null(spark):
    for y in (0, 1):
        df = spark.createDataFrame([(0.1, y), (0.7, y)], "z double, y int")
        assert metrics.auc(df, "z", "y").first()[0] is None
        assert (metrics.auc_pr(df, "z", "y").first()[0] is None) == (y == 0)


def test_auc_pr_by_hand(spark):
    df, scores, labels = scored_rows(spark)
    area, before_tp, before_p = 0.0, 0, None
    for s in sorted(set(scores), reverse=True):
        tp, seen = labels[scores >= s].sum(), (scores >= s).sum()
        p = tp / seen
        area += (tp - before_tp) * (p + (p if before_p is None else before_p)) / 2
        before_tp, before_p = tp, p
    assert metrics.auc_pr(df, "z", "y").first()[0] == pytest.approx(area / labels.sum())


def test_binned_curves_are_close_to_the_exact_ones(spark):
    df, scores, labels = scored_rows(spark)
    found = metrics_of(metrics.evaluate(df, "z", "y"))
    assert found["auc"] == pytest.approx(metrics.auc(df, "z", "y").first()[0], abs=0.01)
    assert found["auc_precision_recall"] == pytest.approx(metrics.auc_pr(df, "z", "y").first()[0], abs=0.01)
    loss = np.log1p(np.exp(-scores)) + (1 - labels) * scores
    assert found["average_loss"] == pytest.approx(loss.mean())
    assert found["accuracy"] == pytest.approx(((scores > 0) == (labels == 1)).mean())


def test_one_class_has_no_curve(spark):
    df = spark.createDataFrame([(0.5, 1), (1.5, 1)], "z double, y int")
    assert metrics_of(metrics.evaluate(df, "z", "y"))["auc"] is None

"""Gradients against differences, training against a plain loop, and odd rows."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from clickloom.operators import deep_training as deep
from clickloom.operators import networks

RNG = np.random.default_rng(8)
X = RNG.normal(size=(60, 5))
Y = ((X[:, 0] > 0) != (X[:, 1] > 0)).astype(float)
W = np.where(Y == 1, 2.0, 0.5)


def table(spark, rows=range(60)):
    return spark.createDataFrame([(int(i), float(Y[i]), float(W[i]), X[i].tolist()) for i in rows], "id long, label double, weight double, features array<double>")


def loss(network, x=X, y=Y, w=W):
    z = networks.forward(network, x)[:, 0]
    return float((w * (np.logaddexp(0, z) - y * z)).sum())


@pytest.mark.parametrize("activation", ["relu", "sigmoid", "tanh"])
def test_gradient_is_the_slope_of_the_loss(activation):
    network = deep.start(5, [4, 3], activation, seed=2)
    values = deep.flat(network) + 0.05
    network = deep.shaped(network, values)
    found, slope = deep.gradient(network, X, Y, W)
    assert found == pytest.approx(loss(network))
    for i in range(0, len(values), 7):
        step = np.zeros(len(values))
        step[i] = 1e-6
        higher, lower = (loss(deep.shaped(network, values + s)) for s in (step, -step))
        assert slope[i] == pytest.approx((higher - lower) / 2e-6, abs=1e-4)


def test_one_update_an_epoch_like_a_plain_loop(spark):
    network, opt = deep.start(5, [4], seed=3), deep.Adagrad(0.3)
    told = deep.fit(table(spark).repartition(5), network, epochs=4, opt=opt)
    values, squares, losses = deep.flat(network), np.full(network.n_weights, opt.initial), []
    for _ in range(4):
        now = deep.shaped(network, values)
        total, slope = deep.gradient(now, X, Y, W)
        losses.append(total / W.sum())
        step = slope / W.sum()
        squares = squares + step**2
        values = values - opt.rate * step / np.sqrt(squares)
    np.testing.assert_allclose(deep.flat(told.network), values)
    np.testing.assert_allclose(told.losses, losses)
    np.testing.assert_allclose(told.squares, squares)


def test_training_again_gives_the_same_weights_and_goes_on(spark):
    network = deep.start(5, [6], seed=4)
    data = table(spark)
    whole = deep.fit(data, network, epochs=3, batches=3)
    again = deep.fit(data, network, epochs=3, batches=3)
    assert np.array_equal(deep.flat(whole.network), deep.flat(again.network))
    first = deep.fit(data, network, epochs=1, batches=3)
    rest = deep.fit(data, first.network, epochs=2, batches=3, squares=first.squares)
    np.testing.assert_allclose(deep.flat(rest.network), deep.flat(whole.network))


def test_hidden_units_learn_what_no_linear_model_can(spark):
    told = deep.fit(table(spark), deep.start(5, [16], seed=5), epochs=40, opt=deep.Adagrad(0.5))
    z = networks.forward(told.network, X)[:, 0]
    assert told.losses[-1] < 0.5 * told.losses[0] and ((z > 0) == (Y == 1)).mean() > 0.9


def test_odd_rows(spark):
    network = deep.start(5, [3], seed=6)
    odd = spark.createDataFrame([(1, 1.0, 1.0, None), (None, None, 2.0, X[0].tolist()), (2, 1.0, None, X[1].tolist())], table(spark).schema)
    told = deep.fit(odd, network)  # the row without a label counts as negative, the one without a weight not at all
    assert told.losses == [pytest.approx(loss(network, X[:1], np.zeros(1), np.ones(1)))]
    empty = deep.fit(odd.where(F.lit(False)), network, epochs=2)
    assert empty.losses == [] and np.array_equal(deep.flat(empty.network), deep.flat(network))
    with pytest.raises(ValueError, match="plain"):
        deep.fit(odd, networks.Network("dense", network.layers, network.output))

"""The recurrent autoencoder: its gradient, its training and its flags."""

import numpy as np
import pytest

from cellsight.operators.recurrent import Network, RecurrentAutoencoder


@pytest.mark.parametrize("steps", [1, 3])
def test_gradient_is_that_of_small_steps(steps):
    net, rng = Network(2, [3, 2], [2, 3]), np.random.default_rng(0)
    flat = net.start(1) + rng.normal(0, 0.1, len(net.start(1)))
    x = rng.normal(size=(4, steps, 2))
    loss, grad = net.gradient(flat, x)
    assert loss == pytest.approx(((net.run(flat, x)[0] - x) ** 2).mean((1, 2)).sum())
    for i in range(0, len(flat), 3):
        step = np.zeros(len(flat))
        step[i] = 1e-6
        assert grad[i] == pytest.approx((net.gradient(flat + step, x)[0] - net.gradient(flat - step, x)[0]) / 2e-6, abs=1e-6)


def _records(spark, n=400, planted=(17, 230)):
    rng = np.random.default_rng(3)
    a = rng.normal(size=n)
    rows = [(int(i), float(a[i]), float(2 * a[i] + 0.05 * rng.normal()), float(-a[i])) for i in range(n)]
    for i in planted:
        rows[i] = (i, 3.0, -9.0, 4.0)
    return spark.createDataFrame(rows, "id long, x double, y double, z double")


@pytest.mark.parametrize("window, rounds", [(1, 25), (4, 40)])
def test_loss_falls_and_planted_records_are_flagged(spark, window, rounds):
    df = _records(spark)
    model = RecurrentAutoencoder(["x", "y", "z"], "id", window, encoder=[8], decoder=[8], dropout=0.0, rounds=rounds, rate=0.03).fit(df)
    out = model.transform(df)
    assert model.history[-1][1] < 0.8 * model.history[0][1]
    assert {r["id"] for r in out.where("flag = 1").collect()} >= {17, 230}
    assert out.count() == 400 and set(out.columns) == {"id", "x", "y", "z", "reconstruction", "flag"}


def test_a_short_window_nulls_and_dropout(spark):
    df = spark.createDataFrame([(i, None if i == 3 else float(i), 1.0) for i in range(7)], "id long, x double, y double")
    model = RecurrentAutoencoder(["x", "y"], "id", 3, encoder=[2], decoder=[2], rounds=2).fit(df)
    assert {r["id"] for r in model.transform(df).where("reconstruction IS NOT NULL").collect()} == set(range(7))


def test_an_empty_table(spark):
    df = spark.createDataFrame([], "id long, x double")
    model = RecurrentAutoencoder(["x"], "id", encoder=[2], decoder=[2], rounds=2).fit(df)
    assert model.history == [] and model.transform(df).count() == 0

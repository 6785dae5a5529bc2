"""The network's slopes against differences, its fit on planted classes, and odd rows."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillframe.operators import network as nw
from quillframe.operators.evaluation import classification_accuracy


def test_slopes_are_those_of_the_loss():
    rng = np.random.default_rng(1)
    net = nw.Network.seeded([5, 7, 4, 3], 2)
    net = net.moved(net.flat() + rng.normal(size=len(net.flat())) * 0.1)
    x, label = rng.normal(size=(11, 5)), rng.integers(0, 3, 11)
    slope, loss = net.slopes(x, label)
    logs = x
    for i, (w, b) in enumerate(zip(net.weights, net.biases)):
        logs = logs @ w + b
        logs = np.maximum(logs, 0) if i < 2 else logs
    p = np.exp(logs) / np.exp(logs).sum(axis=1, keepdims=True)
    assert np.isclose(loss, -np.log(p[np.arange(11), label]).sum())
    for i in rng.choice(len(slope), 40, replace=False):
        step = np.zeros(len(slope))
        step[i] = 1e-6
        by_difference = (net.moved(net.flat() + step).slopes(x, label)[1] - net.moved(net.flat() - step).slopes(x, label)[1]) / 2e-6
        assert abs(by_difference - slope[i]) < 1e-4


@pytest.fixture(scope="module")
def planted(spark):
    rng = np.random.default_rng(3)
    centre = rng.normal(size=(4, 12)) * 2
    rows = [(i, i % 4, (centre[i % 4] + rng.normal(size=12)).tolist()) for i in range(600)]
    return spark.createDataFrame(rows, "id long, label int, features array<float>").repartition(40).cache()


def test_sums_go_up_a_tree(planted):
    """Forty partitions, more than one level: the same slopes as from all rows at once."""
    net = nw.Network.seeded([12, 6, 4])
    slope, loss, n = nw.step_slopes(planted.select("features", "label"), net)
    rows = planted.collect()
    want, cost = net.slopes(np.array([r["features"] for r in rows], dtype=np.float64), np.array([r["label"] for r in rows]))
    assert n == 600 and np.allclose(slope, want) and np.isclose(loss, cost)


def test_fit_learns_planted_classes(planted):
    losses = []
    held = F.col("id") >= 400
    net = nw.fit(planted.where(~held).coalesce(2), (16,), 12, 4, epochs=6, batches=2, losses=losses)
    assert losses[-1] < 0.2 * losses[0]
    out = nw.predict(planted.where(held), net)
    assert classification_accuracy(out, "label", "predicted").first()["accuracy"] > 0.95
    for r in out.limit(20).collect():
        assert 0.25 <= r["probability"] <= 1.0
    again = nw.fit(planted.where(~held).coalesce(2), (16,), 12, 4, epochs=6, batches=2)
    assert np.allclose(again.flat(), net.flat())


def test_odd_rows(spark):
    rows = [(1, None, [1.0, 2.0]), (2, 0, None), (3, 1, [1.0, None]), (4, 9, [1.0, 2.0]), (5, 1, [1.0]), (None, 0, [0.5, 0.5])]
    df = spark.createDataFrame(rows, "id long, label int, features array<double>")
    net = nw.fit(df, (3,), 2, 2, epochs=1, batches=1)
    assert np.isfinite(net.flat()).all()
    nothing = nw.fit(df.where("false"), (3,), 2, 2, epochs=1, batches=1)
    assert np.allclose(nothing.flat(), nw.Network.seeded([2, 3, 2]).flat())
    assert nw.predict(df.where("false"), net).count() == 0

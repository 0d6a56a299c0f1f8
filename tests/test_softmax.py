"""Boosting for several classes: probabilities, losses, weights, held-out rows, saving."""

import math

import numpy as np
import pytest

from packetloom.operators import models as ml
from packetloom.operators.softmax import SoftmaxBoosting


@pytest.fixture(scope="module")
def frames(spark):
    rng = np.random.default_rng(1)
    x = rng.integers(0, 20, (6000, 3)).astype(float)
    y = np.where(x[:, 0] >= 14, 2, np.where(x[:, 1] >= 8, 1, 0))
    y = np.where(rng.random(6000) < 0.05, rng.integers(0, 3, 6000), y)
    rows = [(*map(float, a), int(b), 5.0 if b == 2 else 1.0) for a, b in zip(x, y)]
    df = spark.createDataFrame(rows, "a double, b double, c double, y int, w double")
    return spark.createDataFrame(rows[:4500], df.schema), spark.createDataFrame(rows[4500:], df.schema)


NAMES = ["a", "b", "c"]


def test_losses_fall_probabilities_sum_to_one_and_held_out_rows_are_right(spark, frames, tmp_path):
    train, test = frames
    model = ml.train(train, NAMES, "y", SoftmaxBoosting(trees=8, depth=3, step=0.4))
    losses = model.stages[-1].losses
    assert len(losses) == 9 and all(a > b for a, b in zip(losses, losses[1:]))
    counts = [r["count"] for r in train.groupBy("y").count().collect()]
    assert losses[0] == pytest.approx(-sum(n * math.log(n / 4500) for n in counts) / 4500, rel=1e-6)
    scored = model.transform(test).select("y", "prediction", "probability").collect()
    assert all(abs(sum(r["probability"]) - 1) < 1e-9 and r["prediction"] == int(np.argmax(r["probability"])) for r in scored)
    right = sum(r["y"] == r["prediction"] for r in scored) / len(scored)
    most = max(r["count"] for r in test.groupBy("y").count().collect()) / len(scored)
    assert right > 0.92 > most + 0.3
    loss = -sum(math.log(r["probability"][r["y"]]) for r in scored) / len(scored)
    assert loss < 0.45 < losses[0]
    importance = {r["feature"]: r["importance"] for r in ml.feature_importance(model, NAMES, spark).collect()}
    assert min(importance["a"], importance["b"]) > 10 * importance["c"] and sum(importance.values()) == pytest.approx(1)
    ml.save_model(model, str(tmp_path / "m"))
    again = ml.load_model(str(tmp_path / "m"))
    assert again.stages[-1].losses == losses
    told = [r["probability"] for r in again.transform(test).select("probability").collect()]
    assert all(np.allclose(a, r["probability"], atol=1e-12) for a, r in zip(told, scored))


def test_weights_and_subsamples(frames):
    train, test = frames
    plain = ml.train(train, NAMES, "y", SoftmaxBoosting(trees=2, depth=2, step=0.5, rows=0.7, columns="2"))
    heavy = ml.train(train, NAMES, "y", SoftmaxBoosting(trees=2, depth=2, step=0.5).setWeightCol("w"))
    share = [ml.score(m, test).filter("pred = 2").count() for m in (plain, heavy)]
    assert 0 < share[0] <= share[1]
    mean = [m.transform(test).select("probability").rdd.map(lambda r: float(r[0][2])).mean() for m in (plain, heavy)]
    assert mean[1] > mean[0] + 0.1


def test_odd_labels(spark):
    rows = spark.createDataFrame([(float(i), 2 if i > 5 else 0) for i in range(12)], "a double, y int")
    model = ml.train(rows, ["a"], "y", SoftmaxBoosting(trees=3, depth=1, step=0.5))
    got = ml.score(model, rows).collect()
    assert all(r["pred"] == r["y"] for r in got)  # class 1 has no row and is never named
    one = ml.train(rows.filter("y = 0"), ["a"], "y", SoftmaxBoosting(trees=2, depth=1))
    assert {r["pred"] for r in ml.predict(one, rows).collect()} == {0}
    with pytest.raises(ValueError, match="from 0"):
        ml.train(rows.selectExpr("a", "y - 1 as y"), ["a"], "y", SoftmaxBoosting(trees=1))

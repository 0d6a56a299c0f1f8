"""Boosting of registered queries learns each row of binned features and label once; attributions by the grid of its scores."""

import pytest
from pyspark.ml.classification import GBTClassifier
from pyspark.sql import functions as F

import __spark_entry__ as entry
from packetloom.operators import models as ml

SF = "/root/testdata/sf0.001"
FOLDED = ["train_gbt_small", "score_confidence", "batch_score", "attribution_rank", "learning_curve", "unified_experiment", "model_comparison"]


@pytest.mark.parametrize("name", FOLDED)
def test_learners_see_folded_rows_that_stand_for_all(spark, monkeypatch, name):
    seen = []
    real = GBTClassifier.fit

    def fit(self, df, params=None):
        told = df.agg(F.count("*"), F.countDistinct(*self_inputs(df), self.getLabelCol()), F.sum("__rows"), F.sum("__weight")).first()
        seen.append(tuple(told))
        return real(self, df, params)

    def self_inputs(df):
        return [c for c in df.columns if c.endswith("__binned")]

    monkeypatch.setattr(GBTClassifier, "fit", fit)
    entry.queries()[name](spark, SF).collect()
    assert seen
    for n, distinct, rows, weight in seen:
        assert n == distinct < rows == weight


@pytest.fixture(scope="module")
def flows(spark):
    rows = [(i % 900, float(i * 7 % 50), float(i * 13 % 1001), (i * 11 % 13) / 100, int(i * 11 % 13 > 5 and i * 7 % 50 > 9)) for i in range(1000)]
    return spark.createDataFrame(rows, "id int, a double, b double, c double, y int")


def test_grid_gives_the_attributions_of_scored_mixes(spark, flows):
    names = ["c", "a", "b"]
    model = ml.train(flows, names, "y", ml.boosted_trees(4, 3), folded=True)
    grid = ml.score_grid(model, spark)
    assert grid.sizes == [13, 32, 32] and len(grid.scores) == 13 * 32 * 32
    ways = [ml.attribution(lambda df: ml.score(model, df), flows, names, ["id"], draws=5, grid=g) for g in (None, grid)]
    plain, looked = ({(r["id"], r["feature"]): (r["attribution"], r["error"]) for r in w.collect()} for w in ways)
    assert len(plain) == 2700 and plain.keys() == looked.keys()
    assert all(looked[k] == pytest.approx(v, abs=1e-9) for k, v in plain.items())


def test_no_grid_for_too_many_mixes(spark, flows, monkeypatch):
    monkeypatch.setattr(ml, "GRID", 13 * 32 * 32 - 1)
    model = ml.train(flows, ["a", "b", "c"], "y", ml.boosted_trees(1, 2), folded=True)
    assert ml.score_grid(model, spark) is None

"""Samples of counted rows: as drawn from the rows themselves."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from packetloom.functions.draws import _law, _units, drawn, draws
from packetloom.operators import models as ml
from packetloom.operators.softmax import SoftmaxBoosting


@pytest.mark.parametrize("n", [1, 7, 400])
def test_laws(n):
    for rate, again in ((0.8, False), (1.0, True), (0.3, True)):
        low, upto = _law(n, rate, again)
        mean = n * rate
        if again:
            want = [math.exp(k * math.log(mean) - mean - math.lgamma(k + 1)) for k in range(low, low + len(upto))]
        else:
            want = [math.comb(n, k) * rate**k * (1 - rate) ** (n - k) for k in range(low, low + len(upto))]
        assert np.allclose(np.diff(upto, prepend=0.0), want, atol=1e-12)


def test_draws_of_a_large_count_stay_near_their_mean():
    n = np.array([1, 1_000_000, 50] * 500)
    units = np.stack([_units(np.arange(1500), i) for i in (3, 4)], axis=1)
    got = drawn(units, n, 0.8, False)
    assert (got <= n[:, None]).all() and got[n == 1].max() == 1 and got[n == 1].min() == 0
    assert abs(got[n == 1_000_000] - 800_000).max() < 3000 and (got[n == 1_000_000] > 0).all()
    assert abs(got[n == 1].mean() - 0.8) < 0.05 and abs(got[n == 50].mean() - 40) < 0.5 and (got[:, 0] != got[:, 1]).any()


def test_draws_follow_from_the_row(spark):
    rows = spark.range(300).withColumn("n", F.col("id") % 9 + 1)
    told = rows.select("id", draws(F.xxhash64("id"), F.col("n"), [1, 2], 1.0, True).alias("d"))
    again = rows.repartition(7, F.rand(1)).select("id", draws(F.xxhash64("id"), F.col("n"), [1, 2], 1.0, True).alias("d"))
    assert sorted(map(tuple, told.collect())) == sorted(map(tuple, again.collect()))


def test_no_sample_leaves_out_a_row_that_stands_for_many(spark, monkeypatch):
    """Eight distinct rows, 4,000 of each: a sample of the rows misses none of the eight."""
    rows = spark.range(32_000).selectExpr("double(id % 2) AS a", "double(id div 2 % 2) AS b", "int(id div 4 % 2) AS y")
    seen = []
    real = ml.RandomForestClassifier.fit
    monkeypatch.setattr(ml.RandomForestClassifier, "fit", lambda self, df, *p: seen.append((self, df.count())) or real(self, df, *p))
    model = ml.train(rows, ["a", "b"], "y", ml.random_forest(6, 3), folded=True).stages[-1]
    assert model.getNumTrees == 6 and model.numClasses == 2 and [n for _, n in seen] == [8] * 6
    assert not any(e.getBootstrap() for e, _ in seen)
    heavy = ml.train(rows.withColumn("w", F.when(F.col("y") == 1, 3.0).otherwise(1.0)), ["a", "b"], "y", ml.random_forest(6, 3, weight="w"), folded=True)
    assert ml.score(heavy, rows).agg(F.min("score")).first()[0] == pytest.approx(0.75, abs=0.02)
    drawn_rows = []
    grow = SoftmaxBoosting._tree
    monkeypatch.setattr(SoftmaxBoosting, "_tree", lambda self, state, c, turn: drawn_rows.append(state.select(F.min(F.col("d")[c]), F.max(F.col("d")[c]), F.sum(F.col("d")[c])).first()) or grow(self, state, c, turn))
    ml.train(rows, ["a", "b"], "y", SoftmaxBoosting(trees=2, depth=2, rows=0.8), folded=True)
    assert len(drawn_rows) == 4 and len(set(drawn_rows)) == 4
    assert all(3000 < low <= high < 3400 and 25_200 < total < 26_000 for low, high, total in drawn_rows)

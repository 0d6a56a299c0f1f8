"""Evaluation by hand-made tables."""

import random

import pytest
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.sql import functions as F

from packetloom.operators import evaluate as ev


def test_report_with_an_unpredicted_class(spark):
    df = spark.createDataFrame([("a", "a"), ("a", "b"), ("b", "b"), ("c", "b")], "y string, pred string")
    r = {x["label"]: x for x in ev.classification_report(df).collect()}
    assert (r["a"]["precision"], r["a"]["recall"], r["a"]["support"]) == (1.0, 0.5, 2.0)
    assert (r["c"]["precision"], r["c"]["recall"], r["c"]["f1"]) == (0.0, 0.0, 0.0)
    assert r["b"]["precision"] == pytest.approx(1 / 3) and r["b"]["f1"] == pytest.approx(0.5)
    assert r["accuracy"]["f1"] == 0.5 and r["accuracy"]["support"] == 4.0 and r["accuracy"]["precision"] is None
    assert r["macro avg"]["precision"] == pytest.approx((1 + 1 / 3 + 0) / 3)
    assert r["weighted avg"]["recall"] == pytest.approx(0.5)
    flat = {x["label"]: x for x in ev.classification_report(df, accuracy_everywhere=True).collect()}["accuracy"]
    assert [flat[c] for c in ("precision", "recall", "f1", "support")] == [0.5] * 4


def test_confusion_matrix_has_all_labels(spark):
    df = spark.createDataFrame([(0, 0), (0, 1), (1, 1)], "y int, pred int")
    assert sorted(map(tuple, ev.confusion_matrix(df, [0, 1, 2]).collect())) == [(0, 1, 1, 0), (1, 0, 1, 0), (2, 0, 0, 0)]


def test_rates_of_one_class_only(spark):
    df = spark.createDataFrame([(0, 0), (0, 0)], "y int, pred int")
    r = ev.binary_rates(df).first()
    assert (r["tn"], r["fpr"], r["fnr"], r["f1"], r["accuracy"], r["fpr_ok"]) == (2, 0.0, None, 0.0, 1.0, True)


@pytest.mark.parametrize("digits", [1, 6])
def test_auc_with_ties(spark, digits):
    rnd = random.Random(11)
    rows = [(int(rnd.random() < 0.3), round(rnd.random(), digits), i % 2) for i in range(2000)]
    df = spark.createDataFrame(rows, "y int, score double, source int")
    want = BinaryClassificationEvaluator(rawPredictionCol="score", labelCol="y", numBins=0).evaluate(df)
    assert ev.roc_auc(df).first()["auc"] == pytest.approx(want, abs=1e-9)
    for r in ev.roc_auc(df, by=["source"]).collect():
        part = df.filter(F.col("source") == r["source"])
        assert r["auc"] == pytest.approx(BinaryClassificationEvaluator(rawPredictionCol="score", labelCol="y", numBins=0).evaluate(part), abs=1e-9)


def test_curves_and_best_threshold(spark):
    df = spark.createDataFrame([(1, 0.9), (1, 0.8), (0, 0.7), (1, 0.6), (0, 0.1)], "y int, score double")
    roc = sorted((r["threshold"], r["fpr"], round(r["tpr"], 6)) for r in ev.roc_curve(df).collect())
    assert roc[-1] == (float("inf"), 0.0, 0.0) and roc[0] == (0.1, 1.0, 1.0) and (0.7, 0.5, 0.666667) in roc
    pr = {r["threshold"]: (r["precision"], r["recall"]) for r in ev.pr_curve(df).collect()}
    assert pr[None] == (1.0, 0.0) and pr[0.6] == (0.75, 1.0)
    best = ev.best_threshold(df).first()
    assert best["threshold"] == 0.6 and best["f1"] == pytest.approx(6 / 7)
    at = {r["setting"]: r for r in ev.threshold_compare(df, {"default": 0.5, "high": 0.75}).collect()}
    assert at["high"]["fpr"] == 0.0 and at["high"]["fnr"] == pytest.approx(1 / 3) and at["default"]["fnr"] == 0.0


def test_perfect_score(spark):
    df = spark.createDataFrame([(1, 0.9, 1), (0, 0.2, 0)], "y int, score double, pred int")
    r = ev.metric_row(df).first()
    assert (r["accuracy"], r["f1"], r["auc"]) == (1.0, 1.0, 1.0)
    s = ev.score_summary(df).first()
    assert (s["total"], s["benign"], s["attack_pct"]) == (2, 1, 50.0)


def test_weights_count_rows_beforehand(spark):
    rows = [(1, 1, 0.9)] * 3 + [(0, 1, 0.8)] * 2 + [(0, 0, 0.3)] * 4 + [(1, 0, 0.2)]
    df = spark.createDataFrame(rows, "y int, pred int, score double")
    counted = df.groupBy("y", "pred", "score").agg(F.count("*").alias("n"))
    assert ev.binary_rates(counted, weight="n").first() == ev.binary_rates(df).first()
    assert ev.roc_auc(counted, weight="n").first() == ev.roc_auc(df).first()
    assert sorted(map(tuple, ev.confusion_counts(counted, weight="n").collect())) == sorted(map(tuple, ev.confusion_counts(df).collect()))
    key = lambda r: r["threshold"] or 0
    assert sorted(ev.roc_curve(counted, weight="n").collect(), key=key) == sorted(ev.roc_curve(df).collect(), key=key)
    assert sorted(ev.pr_curve(counted, weight="n").collect(), key=key) == sorted(ev.pr_curve(df).collect(), key=key)

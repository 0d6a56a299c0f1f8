"""Training, scoring and explaining: invariants, not numbers of a learner."""

import random

import pytest
from pyspark.sql import functions as F

from packetloom.operators import models as ml
from packetloom.operators.evaluate import binary_rates
from packetloom.operators.flows import flow_features, to_unified
from packetloom.operators.prep import Scaler, preprocess, with_class_weight
from packetloom.operators.schema import FEATURES, MissingColumns
from packetloom.plans.experiment import unified_experiment


@pytest.fixture(scope="module")
def rows(spark):
    rnd = random.Random(4)
    data = []
    for i in range(1500):
        a, b, c = rnd.gauss(0, 3), rnd.gauss(50, 10), rnd.random()
        data.append((i, a, b, c, int(a > 1), ["x", "y", "z"][(a > 1) + (a > 3)]))
    return spark.createDataFrame(data, "id bigint, a double, b double, c double, y int, cls string").repartition(4)


FEATS = ["a", "b", "c"]


def test_learns_scores_and_reloads(rows, tmp_path):
    p = preprocess(rows, FEATS, "y", ["id"], store=True)
    train = with_class_weight(p.train, "y")
    for est in (ml.random_forest(5, 4, weight="weight"), ml.boosted_trees(5, 3, weight="weight")):
        model = ml.train(train, FEATS, "y", est)
        scored = ml.score(model, p.test)
        assert binary_rates(scored, "y").first()["accuracy"] > 0.95
        assert scored.filter((F.col("score") < 0) | (F.col("score") > 1)).count() == 0
        ml.save_model(model, str(tmp_path / est.uid))
        labels = ml.predict(model, p.test)
        assert labels.columns == [*p.test.columns, "pred"]
        assert labels.select("id", "pred").exceptAll(scored.select("id", "pred")).count() == 0
        again = ml.score(ml.load_model(str(tmp_path / est.uid)), p.test)
        assert scored.select("id", "pred", "score").exceptAll(again.select("id", "pred", "score")).count() == 0
    top = ml.feature_importance(model, FEATS, rows.sparkSession).orderBy(F.desc("importance")).first()
    assert top["feature"] == "a"


def test_scaler_in_the_pipeline_is_applied_once(rows):
    scaler = Scaler.fit(rows, FEATS)
    inside = ml.train(rows, FEATS, "y", ml.boosted_trees(3, 3), scaler)
    outside = ml.train(scaler.transform(rows), FEATS, "y", ml.boosted_trees(3, 3))
    a = ml.score(inside, rows).select("id", "pred")
    b = ml.score(outside, scaler.transform(rows)).select("id", "pred")
    assert a.exceptAll(b).count() == 0
    with pytest.raises(MissingColumns):
        ml.score_table(inside, rows.drop("b"), FEATS)
    bad = rows.withColumn("a", F.when(F.col("id") < 10, F.lit(float("inf"))).otherwise(F.col("a")))
    assert ml.score_table(inside, bad, FEATS)[1].first()["total"] == 1490


def test_multiclass(rows):
    coded = rows.withColumn("code", F.when(F.col("cls") == "x", 0).when(F.col("cls") == "y", 1).otherwise(2))
    model = ml.train(coded, FEATS, "code", ml.multiclass(ml.boosted_trees(3, 3)))
    scored = ml.score(model, coded)
    assert "score" not in scored.columns
    assert ml.predict(model, coded).select("id", "pred").exceptAll(scored.select("id", "pred")).count() == 0
    assert scored.filter(F.col("pred") == F.col("code")).count() > 1400


def _linear(df):
    return df.withColumn("score", 2 * F.col("a") - F.col("b")).withColumn("pred", (F.col("a") > 1).cast("int"))


def test_folded_rows_are_learned_from_once(rows, monkeypatch):
    seen = []
    monkeypatch.setattr(ml, "spread_rows", lambda df: seen.append(df.count()) or df)
    many = rows.select(F.floor(F.col("a")).alias("a"), "b", "y").crossJoin(rows.sparkSession.range(40).select())
    for est in (ml.random_forest(5, 4), ml.boosted_trees(5, 3)):
        model = ml.train(many, ["a", "b"], "y", est, folded=True)
        assert binary_rates(ml.score(model, many), "y").first()["accuracy"] > 0.95
        assert ml.score(model, many).columns == ["a", "b", "y", "pred", "score"]
    # 60,000 rows, 1,500 of them distinct, in at most 32 x 32 ranges of either label
    assert max(seen) <= 1500


def test_permutation_importance(rows):
    got = {r["feature"]: r for r in ml.permutation_importance(_linear, rows, FEATS, "y", ["id"], repeats=3, rows=500).collect()}
    assert got["b"]["importance"] == 0 and got["c"]["importance"] == 0 and got["a"]["importance"] > 0.2


def test_attribution_adds_up(rows):
    vals = ml.attribution(_linear, rows, FEATS, ["id"], rows=100, draws=6)
    assert vals.count() == 300
    by = {r["feature"]: r["m"] for r in vals.groupBy("feature").agg(F.avg(F.abs("attribution")).alias("m")).collect()}
    assert by["c"] == pytest.approx(0, abs=1e-9) and by["b"] > by["a"] > 1
    assert [r["feature"] for r in ml.attribution_ranking(vals, 2).collect()] == ["b", "a"]


def test_attribution_of_a_bent_score_adds_up_exactly(rows):
    """Each draw mixes every row with another one, so the shares of all rows sum to nothing; each chain is scored once a mix."""
    seen = []

    def bent(df):
        seen.append(df)
        return df.withColumn("score", F.col("a") * F.col("b") + F.sqrt(F.abs("c")))

    vals = ml.attribution(bent, rows, FEATS, ["id"], rows=80, draws=4).cache()
    assert abs(vals.agg(F.sum("attribution")).first()[0]) < 1e-6 and vals.filter("error < 0").count() == 0
    assert seen[0].count() == 80 * 4 * 4  # draws, features and one more
    order = {(r["at"], r["draw"]): r["order"] for r in seen[0].select("at", "draw", "order").distinct().collect()}
    assert all(order[at, 2] == order[at, 1][::-1] for at in range(80)) and len({tuple(o) for o in order.values()}) == 6


def test_a_constant_verdict_is_not_sound(spark):
    from packetloom.plans.learning import _tested

    rows = spark.createDataFrame([(i % 3 and 1, 1) for i in range(300)], "y int, pred int")
    assert {r["sound"] for r in _tested(rows, "y").collect()} == {0}
    right = rows.withColumn("pred", F.col("y"))
    assert {r["sound"] for r in _tested(right, "y").collect()} == {1}


def test_compare_and_curve(rows):
    p = preprocess(rows, FEATS, "y", ["id"], store=True)
    table = ml.compare_models({"f": ml.random_forest(3, 3), "g": ml.boosted_trees(2, 2)}, p.train, {"t": p.test}, FEATS, "y", {"f": (["id"], 500)})
    assert sorted((r["model"], r["dataset"]) for r in table.collect()) == [("f", "t"), ("g", "t")]
    curve = ml.learning_curve(p.train, p.test, FEATS, "y", ["id"], [0.1, 1.0], lambda: ml.boosted_trees(2, 2)).collect()
    n = p.train.count()
    assert [r["fraction"] for r in curve] == [0.1, 1.0] and curve[1]["rows"] >= n - 2 and 100 <= curve[0]["rows"] + 2 <= n // 10 + 3


def test_verdict_per_flow(spark):
    rows = [(i, float(i), "1.1.1.1", 9, f"2.2.2.{i % 7}", 8, 6, 100 + i, 0) for i in range(70)]
    packets = spark.createDataFrame(rows, "pkt_seq bigint, ts double, src_ip string, src_port int, dst_ip string, dst_port int, proto int, length bigint, flags int")
    unified = to_unified(flow_features(packets), ["total_bytes"]).withColumn("y", (F.col("total_bytes") % 2 == 0).cast("int"))
    model = ml.train(unified, FEATURES, "y", ml.random_forest(3, 3), Scaler.fit(unified, FEATURES))
    out = ml.score_packets(model, packets)
    assert out.columns == ["flow_key", "duration_s", "pkt_count", "total_bytes", "pkts_per_sec", "prediction", "label"]
    assert out.count() == 7 and {r["prediction"] for r in out.collect()} <= {"ATTACK", "BENIGN"}


def test_unified_experiment(rows):
    shifted = rows.withColumn("a", F.col("a") + 20)
    run = unified_experiment({"here": rows, "there": shifted}, FEATS, "y", ["id"], lambda: ml.boosted_trees(4, 3), "here")
    got = {r["experiment"]: r for r in run.summary.collect()}
    assert set(got) == {"baseline here", "baseline there (unseen)", "unified here", "unified there"}
    assert got["baseline here"]["accuracy"] > 0.95 > got["baseline there (unseen)"]["accuracy"]
    assert got["unified there"]["accuracy"] > 0.9 and got["unified there"]["sources"] == "here,there"
    assert binary_rates(ml.score(run.deployable, rows), "y").first()["accuracy"] > 0.9

"""Quotas, running totals, quantiles and joins against brute force, with skew."""

import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from packetloom.functions import quantiles
from packetloom.functions.dims import attach
from packetloom.functions.ordering import mark_quota, repeat_rows, running_totals
from packetloom.functions.quantiles import exact_quantiles
from packetloom.functions.scratch import materialize
from packetloom.operators.sampling import hash_split, sample_capped, sample_fraction, sample_n, sample_proportional, stratified_split
from packetloom.operators.summaries import drop_warmup, quantiles_by


@pytest.fixture(scope="module")
def skewed(spark):
    rnd = random.Random(3)
    rows = [(i, rnd.choices(["big", "mid", "tiny", None], [900, 90, 5, 5])[0]) for i in range(3000)]
    return rows, spark.createDataFrame(rows, "id bigint, label string").repartition(6)


def _order(i, seed=42):
    return hashlib.md5(f"{i}:{seed}".encode()).hexdigest()


def test_quota_takes_the_first_by_digest(skewed):
    rows, df = skewed
    got = {r["id"] for r in mark_quota(df, ["label"], lambda n, _: F.floor(n * 0.3), ["id"]).filter("picked").collect()}
    want = set()
    for label in {r[1] for r in rows}:
        ids = sorted((r[0] for r in rows if r[1] == label), key=_order)
        want |= set(ids[: int(len(ids) * 0.3)])
    assert got == want


def test_quota_limits(skewed):
    _, df = skewed
    none = mark_quota(df, ["label"], lambda n, _: F.lit(0), ["id"])
    every = mark_quota(df, ["label"], lambda n, _: n + 5, ["id"])
    assert none.filter("picked").count() == 0 and none.count() == 3000
    assert every.filter("picked").count() == 3000


def test_quota_counts_copies_of_a_hot_key(spark):
    rows = [(1, "a", 5)] * 500 + [(1, "a", 6)] * 50 + [(i, "a", 0) for i in range(2, 300)]
    df = spark.createDataFrame(rows, "id bigint, label string, x int").repartition(4)
    for quota in (10, 200, 400, 840):
        out = mark_quota(df, ["label"], lambda n, _, q=quota: F.lit(q), ["id"], unique_key=False)
        assert out.count() == len(rows)
        assert out.filter("picked").count() == quota
        assert sorted(map(tuple, out.drop("picked").collect())) == sorted(rows)


def test_split_is_a_partition(skewed):
    rows, df = skewed
    train, test = stratified_split(df, "label", ["id"])
    a, b = {r["id"] for r in train.collect()}, {r["id"] for r in test.collect()}
    assert not a & b and len(a | b) == len(rows)
    tr, te = hash_split(df, ["id"], 0.2)
    assert tr.count() + te.count() == len(rows) and abs(te.count() - 600) < 100


def test_samples(skewed):
    rows, df = skewed
    size = {k: sum(1 for r in rows if r[1] == k) for k in {r[1] for r in rows}}
    count = lambda d: {r["label"]: r["count"] for r in d.groupBy("label").count().collect()}
    assert count(sample_capped(df, "label", ["id"], 50)) == {k: min(n, 50) for k, n in size.items()}
    assert count(sample_proportional(df, "label", ["id"], 1000)) == {k: m for k, n in size.items() if (m := 1000 * n // 3000)}
    assert count(sample_fraction(df, "label", ["id"], 0.01)) == {k: max(1, 100 * n // 3000) for k, n in size.items()}
    assert {r["id"] for r in sample_n(df, ["id"], 77).collect()} == set(sorted((r[0] for r in rows), key=_order)[:77])
    assert sample_n(df, ["id"], 10_000).count() == 3000


def test_repeat_rows(spark):
    df = spark.createDataFrame([("a", 0), ("b", 3), ("c", 5000)], "k string, n bigint")
    got = repeat_rows(df, "n", "no").groupBy("k").agg(F.count("*").alias("c"), F.min("no").alias("lo"), F.max("no").alias("hi")).collect()
    assert sorted(map(tuple, got)) == [("b", 3, 1, 3), ("c", 5000, 1, 5000)]


@pytest.mark.parametrize("parts", [1, 2, 64])
@pytest.mark.parametrize("descending", [True, False])
def test_running_totals(spark, parts, descending):
    rnd = random.Random(5)
    scores = sorted({round(rnd.random() ** 4, 5) for _ in range(500)})
    rows = [(g, s, rnd.randint(0, 9)) for g in ("x", "y") for s in scores]
    df = spark.createDataFrame(rows, "g string, s double, n bigint").repartition(4)
    got = {(r["g"], r["s"]): r["cum_n"] for r in running_totals(df, ["g"], "s", ["n"], descending, parts).collect()}
    for g in ("x", "y"):
        total = 0
        for r in sorted((r for r in rows if r[0] == g), key=lambda r: r[1], reverse=descending):
            total += r[2]
            assert got[(g, r[1])] == total


@pytest.mark.parametrize("limit", [1_000_000, 5])
def test_exact_quantiles(spark, monkeypatch, limit):
    monkeypatch.setattr(quantiles, "_MAX_BRACKET", limit)
    rnd = random.Random(7)
    xs = [rnd.choice([1.0, 1.0, rnd.gauss(0, 100)]) for _ in range(4001)]  # a hot value
    ys = [float(i * i % 977) for i in range(4000)] + [float("inf")]
    df = spark.createDataFrame(list(zip(xs, ys)), "x double, y double").repartition(7)
    got = exact_quantiles(df, ["x", "y"], [0.0, 0.01, 0.5, 0.99, 1.0])
    for name, data in (("x", xs), ("y", ys[:-1])):
        for q, v in got[name].items():
            assert v == pytest.approx(np.percentile(data, q * 100), rel=1e-12, abs=1e-12)
    empty = spark.createDataFrame([(None,)], "x double")
    assert exact_quantiles(empty, ["x"], [0.5]) == {"x": {0.5: None}}


def test_quantiles_by_group_and_warmup(spark):
    rows = [(b, i, float((i * 37 + b) % 101)) for b, n in ((1, 300), (2, 25), (3, 1)) for i in range(n)]
    df = spark.createDataFrame(rows, "b int, i int, ms double")
    for r in quantiles_by(df, ["b"], "ms", [0.5, 0.99]).collect():
        data = [x[2] for x in rows if x[0] == r["b"]]
        assert (r["q0"], r["q1"]) == pytest.approx(tuple(np.percentile(data, [50, 99])))
    left = drop_warmup(df, ["b"], ["i"], 20).groupBy("b").count().collect()
    assert sorted(map(tuple, left)) == [(1, 280), (2, 5)]


@pytest.mark.parametrize("bound", [100, 1])
def test_attach_past_its_bound(spark, bound):
    df = spark.createDataFrame([("a", 1), (None, 2), ("c", 3)], "k string, v int")
    dim = spark.createDataFrame([("a", 10), (None, 20), ("b", 30)], "k string, d int")
    got = attach(df, dim, ["k"], "left", max_rows=bound).select("v", "d").collect()
    assert sorted((tuple(r) for r in got)) == [(1, 10), (2, 20), (3, None)]


def test_scratch_without_a_checkpoint_folder():
    """A stand-in for a session: local ones get one folder an application, others an error."""
    from types import SimpleNamespace as S

    from packetloom.functions.scratch import scratch_path

    def session(master):
        return S(conf=S(get=lambda k, d: d), sparkContext=S(master=master, applicationId=f"app-{master}", getConf=lambda: S(get=lambda k, d=None: d)))

    a, b = (scratch_path(session("local[8]"), "x") for _ in range(2))
    assert a != b and a.rsplit("/", 2)[0] == b.rsplit("/", 2)[0]
    for master in ("yarn", "local-cluster[2,1,1024]"):
        with pytest.raises(ValueError, match="checkpoint"):
            scratch_path(session(master), "x")


def test_synthetic_rows_are_made_by_many_tasks(spark):
    from packetloom.sources.tables import synthetic_flows

    stats = spark.createDataFrame([("x", 900, 1.0, 2.0), ("y", 100, 5.0, 0.0)], "label string, n bigint, a_mean double, a_sd double")
    out = synthetic_flows(stats, "n", ["a"], ["label"], chunk=50).withColumn("task", F.spark_partition_id())
    got = materialize(out, "synthetic")
    assert got.select("task").distinct().count() > 5
    assert {(r["label"], r["count"]) for r in got.groupBy("label").count().collect()} == {("x", 900), ("y", 100)}

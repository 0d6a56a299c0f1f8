"""Numbers handed on along an order in blocks, and what is made of them."""

import math
import random
import statistics

import pytest
from pyspark.sql import functions as F

from packetloom.functions import scratch
from packetloom.functions.ordering import BLOCK_ROWS, handed_across, handed_round, in_blocks
from packetloom.functions.scratch import materialize
from packetloom.operators import models as ml


@pytest.mark.parametrize("n", [1, 2, BLOCK_ROWS - 1, BLOCK_ROWS, BLOCK_ROWS + 3, 5 * BLOCK_ROWS + 77])
def test_each_row_gets_the_row_so_many_places_on(spark, n):
    rows = spark.range(n).select(F.col("id").alias("at"), (F.col("id") * 3.5).alias("a"), (F.col("id") + 7).cast("int").alias("b"))
    steps = [0, 1, n // 2, n - 1, 40]
    out = handed_round(materialize(in_blocks(rows, "at"), "t"), n, [(s, ["a", "b"] if i % 2 else ["b"]) for i, s in enumerate(steps)])
    got = {r["row"]["at"]: r for r in out.collect()}
    assert len(got) == out.count() == n and got[0]["row"]["b"] == 7
    for at, r in got.items():
        for i, s in enumerate(steps):
            j = (at + s) % n
            assert r[f"h{i}"] == ([j * 3.5, j + 7.0] if i % 2 else [j + 7.0])


@pytest.mark.parametrize("n", [1, 2, BLOCK_ROWS + 3, 5 * BLOCK_ROWS + 77])
def test_each_row_gets_the_row_its_number_is_sent_to(spark, n):
    number = F.when(F.col("id") % 7 == 3, None).when(F.col("id") % 7 == 4, float("nan")).otherwise(F.col("id") * 3.5)
    rows = spark.range(n).select(F.col("id").alias("at"), number.alias("a"), F.concat(F.lit("k"), "id").alias("key")).repartition(5)
    hands = [(a, b % n, "a") for a in (1, 5, n - 1) for b in (0, 11) if math.gcd(a, n) == 1]
    got = {r["at"]: r for r in handed_across(materialize(rows, "t"), "at", n, hands).collect()}
    assert len(got) == n and all(r["key"] == f"k{at}" for at, r in got.items())
    for at, r in got.items():
        for (a, b, _), x in zip(hands, r["handed"]):
            j = (a * at + b) % n
            assert x is None if j % 7 == 3 else math.isnan(x) if j % 7 == 4 else x == j * 3.5


def test_shuffled_copies_are_made_without_a_row_moving(spark):
    rows = materialize(spark.range(2000).select("id", (F.col("id") % 10).cast("double").alias("a"), (F.col("id") % 2).cast("int").alias("y")), "t")
    seen = []
    score = lambda df: seen.append(df) or df.withColumn("pred", (F.col("a") % 2).cast("int"))
    ml.permutation_importance(score, rows, ["a"], "y", ["id"], repeats=3).collect()
    plan = seen[-1]._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and plan.count("Exchange hashpartitioning(other") == 0


def _exchanges(df):
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")


def test_mixes_are_folded_where_they_are_made(spark):
    rnd = random.Random(1)
    rows = spark.createDataFrame([(i % 900, rnd.random(), rnd.random()) for i in range(1000)], "id bigint, a double, b double")
    seen = []

    def linear(df):
        seen.append(df)
        return df.withColumn("score", 2 * F.col("a") - F.col("b"))

    with_mixes = ml.attribution(linear, rows, ["a", "b"], ["id"], draws=5)
    assert _exchanges(with_mixes) - _exchanges(seen[0]) == 1  # only one row a key moves after the mixes
    got = {(r["id"], r["feature"]): r for r in with_mixes.collect()}
    assert len(got) == 1800
    mixes = seen[0].filter("joined IN (0, 2)").collect()
    full = {(r["id"], r["at"], r["draw"]): (r["a"], r["b"]) for r in mixes if r["joined"] == 2}
    gains = {}
    for r in mixes:
        if r["joined"] == 0:
            own = full[r["id"], r["at"], r["draw"]]
            gains.setdefault((r["id"], "a"), []).append(2 * (own[0] - r["a"]))
            gains.setdefault((r["id"], "b"), []).append(r["b"] - own[1])
    for k, g in gains.items():  # ids below 100 are those of two rows
        assert len(g) == (10 if k[0] < 100 else 5)
        assert got[k]["attribution"] == pytest.approx(statistics.mean(g)) and got[k]["error"] == pytest.approx(statistics.stdev(g) / len(g) ** 0.5)


def test_a_learner_gets_rows_by_their_number(spark, monkeypatch):
    rows = materialize(spark.range(20_000, numPartitions=1).select((F.col("id") % 3).cast("double").alias("a")), "t")
    assert scratch.spread_rows(rows) is rows
    monkeypatch.setattr(scratch, "TASK_ROWS", 500)
    sizes = [r["count"] for r in scratch.spread_rows(rows).groupBy(F.spark_partition_id()).count().collect()]
    assert len(sizes) == 40 and sum(sizes) == 20_000 and max(sizes) < 650

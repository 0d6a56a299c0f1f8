"""Shares by quota without ranking all rows: the same rows as by full ranks."""

from pyspark.sql import functions as F

from packetloom.functions import ordering
from packetloom.functions.ordering import below_quotas, digest, numbered


def test_same_rows_as_by_full_ranks(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(ordering, "RANGE_ROWS", 20)
    # keys repeat, and one class is large
    spark.range(3000).selectExpr("id % 1700 AS k", "double(id) AS a", "int(id % 11 = 0) AS y").write.parquet(str(tmp_path / "t"))
    rows = spark.read.parquet(str(tmp_path / "t"))
    quotas = {"few": F.lit(1), "part": F.floor(F.col("n") / 3), "most": F.col("n") - 1, "all": F.col("n")}
    got = below_quotas(rows, digest(["k"], 42), ["k", "a"], ["y"], quotas)
    assert got.columns == ["k", "a", "y", *quotas]
    n = F.count("*").over(ordering.W.partitionBy("y"))
    full = numbered(rows, digest(["k"], 42), ["k", "a"], "rank", ["y"]).withColumn("n", n)
    want = full.select("k", "a", "y", *[(F.col("rank") < q).alias(c) for c, q in quotas.items()])
    assert got.exceptAll(want).count() == 0 and got.count() == 3000


def test_rows_without_a_quota_inside_are_not_ranked(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(ordering, "RANGE_ROWS", 20)
    spark.range(2000).selectExpr("id AS k", "int(id % 2) AS y").write.parquet(str(tmp_path / "t"))
    rows = spark.read.parquet(str(tmp_path / "t"))
    none = below_quotas(rows, digest(["k"], 42), ["k"], ["y"], {"all": F.col("n")})
    assert none.filter("all").count() == 2000

"""Summaries of measurements, metric tables and rankings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from packetloom.functions.dims import attach
from packetloom.functions.ordering import running_totals
from packetloom.functions.quantiles import exact_quantiles
from packetloom.functions.scratch import materialize


def latency_summary(df: DataFrame, value: str) -> DataFrame:
    """Mean, median, p99 (exact, interpolated), minimum and rows per second of latencies in ms."""
    q = exact_quantiles(df, [value], [0.5, 0.99])[value]
    return df.agg(
        F.count(value).alias("runs"),
        F.avg(value).alias("mean_ms"),
        F.lit(q[0.5]).cast("double").alias("median_ms"),
        F.lit(q[0.99]).cast("double").alias("p99_ms"),
        F.min(value).alias("min_ms"),
        F.try_divide(F.lit(1000.0), F.avg(value)).alias("throughput"),
    )


def quantiles_by(df: DataFrame, by: list[str], value: str, qs: list[float]) -> DataFrame:
    """Exact interpolated quantiles per group: (by, q0, q1, ...).

    Values are counted per (group, value) first and ranked through two-level
    running totals, so no group is sorted by one task.
    """
    counts = df.filter(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count("*").alias("n"))
    counts = materialize(counts, "values")  # one scan of the rows
    ranks = running_totals(counts, by, value, ["n"], descending=False)
    sizes = counts.groupBy(*by).agg(F.sum("n").alias("size"))
    ranks = attach(ranks, sizes, by)
    found = []
    for i, q in enumerate(qs):
        pos = (F.col("size") - 1) * F.lit(q)
        for name, k in (("lo", F.floor(pos)), ("hi", F.least(F.floor(pos) + 1, F.col("size") - 1))):
            hit = (F.col("cum_n") > k) & (F.col("cum_n") - F.col("n") <= k)
            found.append(F.max(F.when(hit, F.col(value))).alias(f"{name}{i}"))
    wide = ranks.groupBy(*by, "size").agg(*found)
    cols = []
    for i, q in enumerate(qs):
        pos = (F.col("size") - 1) * F.lit(q)
        cols.append((F.col(f"lo{i}") + (F.col(f"hi{i}") - F.col(f"lo{i}")) * (pos - F.floor(pos))).alias(f"q{i}"))
    return wide.select(*by, *cols)


def drop_warmup(df: DataFrame, by: list[str], order: list[str], runs: int) -> DataFrame:
    """Rows after the first ``runs`` of each group.

    Only the first ``runs`` rows of a group are ever ranked (a top-k per group);
    the rest is kept by comparing with the last of them.
    """
    top = W.partitionBy(*by).orderBy(*order)
    first = df.select(*by, *order).withColumn("__rn", F.row_number().over(top)).filter(F.col("__rn") <= runs)
    last = first.groupBy(*by).agg(F.max(F.struct(*order)).alias("__last"))
    return attach(df, last, by).filter(F.struct(*order) > F.col("__last")).drop("__last")


def latency_by_batch(df: DataFrame, batch: str, value: str, order: list[str], warmup: int = 20) -> DataFrame:
    """Mean and p99 latency and rows per second per batch size, warm-up runs dropped.

    ``order`` must tell all runs of a batch size apart.
    """
    kept = drop_warmup(df, [batch], order, warmup)
    base = kept.groupBy(batch).agg(F.count("*").alias("runs"), F.avg(value).alias("mean_ms"))
    p99 = quantiles_by(kept, [batch], value, [0.99]).withColumnRenamed("q0", "p99_ms")
    return base.join(p99, batch).withColumn("throughput", rows_per_second(F.col(batch), F.col("mean_ms")))


def rows_per_second(batch: Column, mean_ms: Column) -> Column:
    return F.try_divide(batch * 1000.0, mean_ms)


def metric_pivot(df: DataFrame, row: str, column: str, value: str, columns: list) -> DataFrame:
    """Mean of a metric, one row per model and one column per dataset."""
    return df.groupBy(row).pivot(column, columns).agg(F.avg(value))


def reduction_pct(df: DataFrame, name: str, size: str, base_name) -> DataFrame:
    """Percent saved against the named base row, one decimal."""
    base = df.filter(F.col(name) == base_name).agg(F.max(size).alias("b")).scalar()
    return df.withColumn("reduction_pct", F.round((1 - F.try_divide(F.col(size), base)) * 100, 1))


def top_features(ranked: DataFrame, k: int = 20, by: list[str] | None = None) -> DataFrame:
    """The ``k`` highest importances, by name where equal; with ``by`` per group."""
    order = [F.desc("importance"), F.asc("feature")]
    if not by:
        return ranked.orderBy(*order).limit(k)
    w = W.partitionBy(*by).orderBy(*order)
    return ranked.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def importance_vs_mean(ranked: DataFrame, by: list[str]) -> DataFrame:
    """Flags importances above the mean of their group."""
    mean = F.avg("importance").over(W.partitionBy(*by))
    return ranked.withColumn("mean_importance", mean).withColumn("above_mean", F.col("importance") > F.col("mean_importance"))


def mean_abs(df: DataFrame, features: list[str], by: list[str] | None = None) -> DataFrame:
    """(feature, importance): mean absolute value per column."""
    wide = df.groupBy(*(by or [])).agg(*[F.avg(F.abs(c)).alias(c) for c in features])
    return wide.unpivot(by or [], features, "feature", "importance")

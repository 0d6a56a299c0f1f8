"""Samples and splits with exact class sizes, repeatable on any cluster.

Which rows are taken follows from the md5 of the row key and the seed, so a retry
or another partitioning gives the same rows. See ``mark_quota`` for how exact
sizes come about without sorting a class.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from packetloom.functions.ordering import digest, mark_quota


def _take(df: DataFrame, *args, **kw) -> DataFrame:
    return mark_quota(df, *args, out="__take_row", **kw).filter("__take_row").drop("__take_row")


def mark_split(df: DataFrame, label: str, key: list[str], test_size: float = 0.2, seed: int = 42, out: str = "is_test", unique_key: bool = False) -> DataFrame:
    """Adds a test flag: ``round(test_size * n)`` rows of each class are test rows."""
    return mark_quota(df, [label], lambda n, _: F.round(n * test_size), key, seed, out, unique_key)


def stratified_split(df: DataFrame, label: str, key: list[str], test_size: float = 0.2, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """(train, test), exact per-class sizes."""
    marked = mark_split(df, label, key, test_size, seed, "__test")
    return marked.filter(~F.col("__test")).drop("__test"), marked.filter("__test").drop("__test")


def hash_split(df: DataFrame, key: list[str], test_size: float = 0.2, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """(train, test) with expected instead of exact sizes: one scan, no shuffle."""
    unit = F.conv(F.substring(digest(key, seed), 1, 8), 16, 10).cast("bigint") / F.lit(4294967296.0)
    return df.filter(unit >= test_size), df.filter(unit < test_size)


def sample_proportional(df: DataFrame, label: str, key: list[str], target: int = 500_000, seed: int = 42) -> DataFrame:
    """About ``target`` rows, each class by its share, rounded down."""
    return _take(df, [label], lambda n, total: F.least(n, F.floor(n * target / total)), key=key, seed=seed)


def sample_capped(df: DataFrame, label: str, key: list[str], cap: int = 400_000, seed: int = 42) -> DataFrame:
    """At most ``cap`` rows of each class."""
    return _take(df, [label], lambda n, _: F.least(n, F.lit(cap)), key=key, seed=seed)


def sample_n(df: DataFrame, key: list[str], n: int, seed: int = 42) -> DataFrame:
    """Exactly ``min(n, rows)`` rows, uniformly, without replacement."""
    return _take(df, [], lambda rows, _: F.least(rows, F.lit(n)), key=key, seed=seed)


def sample_fraction(df: DataFrame, label: str, key: list[str], fraction: float, min_rows: int = 100, seed: int = 42) -> DataFrame:
    """``fraction`` of the rows (at least ``min_rows``), each class by its share and at least one row."""

    def quota(n, total):
        rows = F.greatest(F.floor(total * fraction), F.lit(min_rows))
        return F.greatest(F.lit(1), F.floor(rows * n / total))

    return _take(df, [label], quota, key=key, seed=seed)

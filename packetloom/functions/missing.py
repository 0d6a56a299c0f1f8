"""One meaning of "missing" for every operator: NULL or NaN."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def float_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema if isinstance(f.dataType, (T.DoubleType, T.FloatType))]


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema if isinstance(f.dataType, T.NumericType)]


def text_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema if isinstance(f.dataType, T.StringType)]


def is_infinite(c: str) -> Column:
    return F.abs(F.col(c)) == F.lit(float("inf"))


def is_missing(df: DataFrame, c: str) -> Column:
    if isinstance(df.schema[c].dataType, (T.DoubleType, T.FloatType)):
        return F.col(c).isNull() | F.isnan(c)
    return F.col(c).isNull()


def finite_or_null(c: str) -> Column:
    """Infinite and NaN values become NULL."""
    return F.when(F.abs(F.col(c)) < F.lit(float("inf")), F.col(c)).alias(c)

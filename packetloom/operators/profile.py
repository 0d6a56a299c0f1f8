"""Data-quality and value profiles. Wide reports are one aggregate each."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from packetloom.functions.missing import float_columns, is_infinite, is_missing, numeric_columns

#: Columns per aggregate; wider tables go in groups to keep generated code small.
_GROUP = 64


def _per_column(df: DataFrame, columns: list[str], test, out: str) -> DataFrame:
    parts = []
    for i in range(0, len(columns), _GROUP):
        cols = columns[i : i + _GROUP]
        counts = df.agg(*[F.count_if(test(c)).alias(c) for c in cols])
        parts.append(counts.unpivot([], cols, "column", out))
    result = parts[0]
    for p in parts[1:]:
        result = result.unionByName(p)
    return result


def missing_profile(df: DataFrame) -> DataFrame:
    """(column, missing) with NULL and NaN counted."""
    return _per_column(df, df.columns, lambda c: is_missing(df, c), "missing")


def inf_profile(df: DataFrame) -> DataFrame:
    """(column, infinite) of every numeric column."""
    floats = set(float_columns(df))
    return _per_column(df, numeric_columns(df), lambda c: is_infinite(c) if c in floats else F.lit(False), "infinite")


def duplicate_count(df: DataFrame) -> DataFrame:
    """Rows beyond the first of each set of equal rows.

    Copies are counted before the shuffle, so a hot group of copies moves as one row.
    """
    return df.groupBy(*df.columns).agg(F.count("*").alias("__n")).agg(
        F.coalesce(F.sum(F.col("__n") - 1), F.lit(0)).alias("duplicates")
    )


def class_balance(df: DataFrame, label: str, normal: str) -> DataFrame:
    """Counts, percents and imbalance of normal versus attack rows."""
    normal_n = F.count_if(F.col(label) == normal)
    attack_n = F.count_if(F.col(label) != normal)
    return df.agg(
        F.count("*").alias("total"), normal_n.alias("normal"), attack_n.alias("attack")
    ).select(
        "*",
        (F.try_divide("normal", "total") * 100).alias("normal_pct"),
        (F.try_divide("attack", "total") * 100).alias("attack_pct"),
        F.try_divide("normal", "attack").alias("imbalance_ratio"),
    )


def quality_report(df: DataFrame, label: str, normal: str) -> DataFrame:
    """(metric, column, value) rows of the whole quality report.

    Missing and infinite values and the class counts come out of one scan; the
    duplicate count needs its own shuffle.
    """
    floats = set(float_columns(df))
    entries = [(F.lit("rows"), F.lit(None), F.count("*"))]
    entries += [(F.lit("missing"), F.lit(c), F.count_if(is_missing(df, c))) for c in df.columns]
    entries += [
        (F.lit("infinite"), F.lit(c), F.count_if(is_infinite(c)) if c in floats else F.lit(0).cast("bigint"))
        for c in numeric_columns(df)
    ]
    entries += [
        (F.lit("normal"), F.lit(label), F.count_if(F.col(label) == normal)),
        (F.lit("attack"), F.lit(label), F.count_if(F.col(label) != normal)),
    ]
    rows = F.array(
        *[F.struct(m.alias("metric"), c.cast("string").alias("column"), v.cast("double").alias("value")) for m, c, v in entries]
    )
    scan = df.agg(rows.alias("r")).select(F.inline("r"))
    dups = duplicate_count(df).select(
        F.lit("duplicates").alias("metric"), F.lit(None).cast("string").alias("column"), F.col("duplicates").cast("double").alias("value")
    )
    return scan.unionByName(dups)


def value_counts(df: DataFrame, column: str) -> DataFrame:
    """Frequency table, missing excluded, most frequent first."""
    counts = df.filter(~is_missing(df, column)).groupBy(column).agg(F.count("*").alias("count"))
    return counts.orderBy(F.desc("count"), column)


def distinct_counts(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column, distinct) for each column; NULL is no value."""
    rows = [
        df.filter(F.col(c).isNotNull()).select(c).distinct().agg(F.count("*").alias("distinct")).select(F.lit(c).alias("column"), "distinct")
        for c in columns
    ]
    out = rows[0]
    for r in rows[1:]:
        out = out.unionByName(r)
    return out


def shape(df: DataFrame) -> DataFrame:
    return df.agg(F.count("*").alias("rows"), F.lit(len(df.columns)).cast("bigint").alias("columns"))


def value_profile(df: DataFrame, columns: list[str]) -> DataFrame:
    """(feature, min, max, mean) per column."""
    rows = F.array(
        *[
            F.struct(
                F.lit(c).alias("feature"),
                F.min(c).cast("double").alias("min"),
                F.max(c).cast("double").alias("max"),
                F.avg(c).alias("mean"),
            )
            for c in columns
        ]
    )
    return df.agg(rows.alias("r")).select(F.inline("r"))


def first_rounded_values(df: DataFrame, column: str, digits: int = 4, n: int = 10) -> DataFrame:
    """The ``n`` smallest distinct rounded values."""
    return df.select(F.round(column, digits).alias("value")).distinct().orderBy("value").limit(n)

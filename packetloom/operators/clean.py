"""Repairing values and labels."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from packetloom.functions.dims import attach
from packetloom.functions.missing import finite_or_null, float_columns, is_missing, numeric_columns
from packetloom.functions.quantiles import exact_quantiles

# Label text with the bad dash byte -> repaired label.
LABEL_REPAIRS = {
    "Web Attack \x96 Brute Force": "Web Attack Brute Force",
    "Web Attack \x96 XSS": "Web Attack XSS",
    "Web Attack \x96 Sql Injection": "Web Attack Sql Injection",
}
# Substring -> label, first match wins.
LABEL_RULES = [("Brute", "Web Attack Brute Force"), ("XSS", "Web Attack XSS"), ("Sql", "Web Attack Sql")]
# Classes merged into one.
RARE_LABELS = ["Infiltration", "Web Attack Sql", "Heartbleed", "Other Attack"]
MERGED_LABEL = "Other Attack"


def inf_to_null(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Infinite and NaN values of floating-point columns become NULL."""
    cols = float_columns(df) if columns is None else [c for c in columns if c in float_columns(df)]
    return df.withColumns({c: finite_or_null(c) for c in cols}) if cols else df


def drop_missing(df: DataFrame, subset: list[str] | None = None) -> DataFrame:
    """Drop rows with NULL or NaN in any (or any listed) column."""
    for c in subset or df.columns:
        df = df.filter(~is_missing(df, c))
    return df


def keep_finite(df: DataFrame, subset: list[str]) -> DataFrame:
    """Rows whose listed columns are all present and finite.

    The same rows as ``inf_to_null`` then ``drop_missing``, as plain predicates
    the file reader can use.
    """
    floats = set(float_columns(df))
    inf = F.lit(float("inf"))
    for c in subset:
        # NaN sorts above infinity, so both bounds together leave only finite values
        df = df.filter((F.col(c) > -inf) & (F.col(c) < inf)) if c in floats else df.filter(F.col(c).isNotNull())
    return df


def median_impute(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Missing and infinite values replaced with the column's exact median."""
    cols = columns or numeric_columns(df)
    medians = exact_quantiles(df, cols, [0.5])
    fixed = {}
    for c in cols:
        m = medians[c][0.5]
        value = finite_or_null(c) if c in float_columns(df) else F.col(c)
        fixed[c] = value if m is None else F.coalesce(value, F.lit(m))
    return df.withColumns(fixed)


def normalize_label(df: DataFrame, label: str, repairs: dict[str, str] | None = None, upper: bool = False) -> DataFrame:
    """Trimmed label text, exact repairs applied, optionally upper-cased."""
    c = F.trim(F.col(label))
    if repairs:
        fixed = None
        for bad, good in repairs.items():
            fixed = F.when(c == bad, good) if fixed is None else fixed.when(c == bad, good)
        c = fixed.otherwise(c)
    return df.withColumn(label, F.upper(c) if upper else c)


def apply_label_rules(df: DataFrame, label: str, rules: list[tuple[str, str]]) -> DataFrame:
    """Label of the first rule whose text occurs in it; other labels stay."""
    out = None
    for needle, name in rules:
        hit = F.contains(F.col(label), F.lit(needle))
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return df.withColumn(label, out.otherwise(F.col(label)))


def merge_classes(df: DataFrame, label: str, rare: list[str], into: str = MERGED_LABEL) -> DataFrame:
    return df.withColumn(label, F.when(F.col(label).isin(rare), into).otherwise(F.col(label)))


def drop_rare_classes(df: DataFrame, label: str, min_rows: int = 10) -> DataFrame:
    """Keep rows of classes with at least ``min_rows`` rows; NULL labels go."""
    valid = (
        df.filter(F.col(label).isNotNull())
        .groupBy(label)
        .agg(F.count("*").alias("n"))
        .filter(F.col("n") >= min_rows)
        .select(label)
    )
    return attach(df, valid, [label], "left_semi")

"""Label codes, class weights, scaling and the reusable preparation step."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from packetloom.functions.dims import attach, bounded
from packetloom.functions.scratch import materialize, spread
from packetloom.operators.clean import keep_finite
from packetloom.operators.sampling import mark_split


def label_codes(df: DataFrame, label: str) -> DataFrame:
    """(label, code): codes from 0 in the order of the label text. One row per class."""
    classes = df.filter(F.col(label).isNotNull()).select(label).distinct()
    codes = classes.withColumn("code", F.row_number().over(W.orderBy(label)) - 1)
    return bounded(codes)[0]  # computed once, used by every encode and decode


def label_encode(df: DataFrame, label: str, codes: DataFrame, out: str = "label_code") -> DataFrame:
    """Adds the class code. Unknown and missing labels give NULL."""
    return attach(df, codes.withColumnRenamed("code", out), [label], "left")


def label_decode(df: DataFrame, code: str, codes: DataFrame, out: str = "label_text") -> DataFrame:
    label = next(c for c in codes.columns if c != "code")
    return attach(df, codes.select(F.col("code").alias(code), F.col(label).alias(out)), [code], "left")


def class_weights(df: DataFrame, label: str) -> DataFrame:
    """(label, class_rows, weight): rows / (classes * class rows)."""
    counts, _ = bounded(df.groupBy(label).agg(F.count("*").alias("class_rows")))
    totals = counts.agg(F.sum("class_rows").alias("rows"), F.count("*").alias("classes"))
    share = totals.select((F.col("rows") / F.col("classes")).alias("s")).scalar()
    return counts.withColumn("weight", share / F.col("class_rows"))


def with_class_weight(df: DataFrame, label: str, out: str = "weight") -> DataFrame:
    """Adds the balanced weight of the row's class."""
    w = class_weights(df, label).select(label, F.col("weight").alias(out))
    return attach(df, w, [label])


@dataclass
class Scaler:
    """Standardisation: population deviation, constant features divided by 1.

    ``stats`` has one row per group with ``<feature>_mean`` and ``<feature>_sd``;
    without ``by`` there is a single group.
    """

    features: list[str]
    stats: DataFrame
    by: list[str]

    @staticmethod
    def fit(df: DataFrame, features: list[str], by: list[str] | None = None) -> Scaler:
        aggs = [f(c).alias(f"{c}_{n}") for c in features for f, n in ((F.avg, "mean"), (F.stddev_pop, "sd"))]
        stats, _ = bounded(df.groupBy(*(by or [])).agg(*aggs))  # computed once
        return Scaler(features, stats, by or [])

    def transform(self, df: DataFrame) -> DataFrame:
        if self.by:
            df = attach(df, self.stats, self.by)
            cols = {c: self._scaled(F.col(c), F.col(f"{c}_mean"), F.col(f"{c}_sd")) for c in self.features}
            return df.withColumns(cols).drop(*[f"{c}_{n}" for c in self.features for n in ("mean", "sd")])
        row = self.stats.first()
        return df.withColumns(
            {c: self._scaled(F.col(c), F.lit(row[f"{c}_mean"]), F.lit(row[f"{c}_sd"])) for c in self.features}
        )

    @staticmethod
    def _scaled(x, mean, sd):
        return (x - mean) / F.when(sd == 0, 1.0).otherwise(sd)

    def save(self, path: str) -> None:
        self.stats.write.mode("overwrite").parquet(path)

    @staticmethod
    def load(spark: SparkSession, path: str) -> Scaler:
        stats = spark.read.parquet(path)
        feats = [c[: -len("_mean")] for c in stats.columns if c.endswith("_mean")]
        by = [c for c in stats.columns if not any(c in (f"{f}_mean", f"{f}_sd") for f in feats)]
        return Scaler(feats, stats, by)


@dataclass
class Prepared:
    """Clean, split and scaled rows; ``rows`` has the features, label, key and ``is_test``."""

    rows: DataFrame
    scaler: Scaler

    @property
    def train(self) -> DataFrame:
        return self.rows.filter(~F.col("is_test"))

    @property
    def test(self) -> DataFrame:
        return self.rows.filter("is_test")


def preprocess(
    df: DataFrame,
    features: list[str],
    label: str,
    key: list[str],
    test_size: float = 0.2,
    seed: int = 42,
    keep: list[str] | None = None,
    store: bool = False,
) -> Prepared:
    """Drop bad rows, keep the features, split per class, scale by the train rows.

    ``store`` writes the cleaned slim rows, which the passes for split and scale read,
    and the result to the shared folder, for learners that read it again and again.
    """
    if label in features:
        raise ValueError("the label is not a feature")
    cols = list(dict.fromkeys([*features, label, *key, *(keep or [])]))
    clean = keep_finite(df, [*features, label]).select(*cols)
    clean = materialize(clean, "clean") if store else clean
    marked = mark_split(clean, label, key, test_size, seed)
    scaler = Scaler.fit(marked.filter(~F.col("is_test")), features)
    rows = scaler.transform(marked)
    return Prepared(spread(materialize(rows, "prepared")) if store else rows, scaler)


def reduce_features(df: DataFrame, ranked: DataFrame, n: int = 20, keep: list[str] | None = None) -> DataFrame:
    """Columns of the ``n`` best features of a ranking (feature, importance)."""
    top = ranked.orderBy(F.desc("importance"), "feature").limit(n).collect()
    return df.select(*[r["feature"] for r in top], *(keep or []))

"""Evaluation of any scored table: truth, prediction and optionally a score.

Every report starts from counts per (truth, prediction) or per distinct score, so
rows are reduced before anything is shuffled and the rest works on small tables.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from packetloom.functions.dims import attach, bounded
from packetloom.functions.ordering import running_totals
from packetloom.functions.scratch import materialize


def _total(weight: str | None, test: Column | None = None) -> Column:
    """Rows, or the sum of their weights, that pass the test."""
    if weight is None:
        return F.count("*") if test is None else F.count_if(test)
    return F.sum(F.col(weight) if test is None else F.when(test, F.col(weight)).otherwise(0))


def confusion_counts(df: DataFrame, y: str = "y", pred: str = "pred", by: list[str] | None = None, weight: str | None = None) -> DataFrame:
    return df.groupBy(*(by or []), F.col(y).alias("y"), F.col(pred).alias("pred")).agg(_total(weight).alias("n"))


def confusion_matrix(df: DataFrame, labels: list, y: str = "y", pred: str = "pred") -> DataFrame:
    """One row per true class, one column ``pred_<label>`` per predicted class."""
    counts = confusion_counts(df, y, pred)
    cells = [F.coalesce(F.sum(F.when(F.col("pred") == v, F.col("n"))), F.lit(0)).alias(f"pred_{v}") for v in labels]
    found = counts.filter(F.col("y").isin(labels)).groupBy("y").agg(*cells)  # a row per listed label at most
    rows = df.sparkSession.createDataFrame([(v,) for v in labels], f"y {df.schema[y].dataType.simpleString()}")
    return rows.join(F.broadcast(found), "y", "left").na.fill(0, [f"pred_{v}" for v in labels])


def confusion_normalized(df: DataFrame, y: str = "y", pred: str = "pred") -> DataFrame:
    """(y, pred, n, share of the true class)."""
    counts = confusion_counts(df, y, pred)
    return counts.withColumn("share", F.col("n") / F.sum("n").over(W.partitionBy("y")))


def rates(tn: Column, fp: Column, fn: Column, tp: Column) -> dict[str, Column]:
    return {
        "tpr": F.try_divide(tp, tp + fn),
        "fpr": F.try_divide(fp, fp + tn),
        "fnr": F.try_divide(fn, fn + tp),
        "accuracy": F.try_divide(tp + tn, tp + tn + fp + fn),
        "f1": F.coalesce(F.try_divide(2 * tp, 2 * tp + fp + fn), F.lit(0.0)),
    }


def binary_rates(df: DataFrame, y: str = "y", pred: str = "pred", by: list[str] | None = None, max_fpr: float = 0.03, weight: str | None = None) -> DataFrame:
    """TN, FP, FN, TP, their rates, accuracy, F1, and whether the FPR target is met.

    ``weight`` counts a row as that many, also for rows counted beforehand.
    """
    y_, p_ = F.col(y), F.col(pred)
    cells = df.groupBy(*(by or [])).agg(
        _total(weight, (y_ == 0) & (p_ == 0)).alias("tn"),
        _total(weight, (y_ == 0) & (p_ == 1)).alias("fp"),
        _total(weight, (y_ == 1) & (p_ == 0)).alias("fn"),
        _total(weight, (y_ == 1) & (p_ == 1)).alias("tp"),
    )
    found = rates(*[F.col(c) for c in ("tn", "fp", "fn", "tp")])
    return cells.select("*", *[c.alias(n) for n, c in found.items()], (found["fpr"] < max_fpr).alias("fpr_ok"))


def accuracy(df: DataFrame, y: str = "y", pred: str = "pred", by: list[str] | None = None) -> DataFrame:
    return df.groupBy(*(by or [])).agg(F.avg((F.col(y) == F.col(pred)).cast("int")).alias("accuracy"), F.count("*").alias("rows"))


def _class_scores(df: DataFrame, y: str, pred: str, by: list[str]) -> DataFrame:
    """Precision, recall, F1 and support of every class that occurs on either side."""
    counts, _ = bounded(confusion_counts(df, y, pred, by))  # the rows are read once, for all report lines
    truth = counts.select(*by, F.col("y").alias("label"), F.col("n").alias("support"), F.lit(0).alias("predicted"), F.when(F.col("y") == F.col("pred"), F.col("n")).otherwise(0).alias("hit"))
    guess = counts.select(*by, F.col("pred").alias("label"), F.lit(0).alias("support"), F.col("n").alias("predicted"), F.lit(0).alias("hit"))
    per = truth.unionByName(guess).groupBy(*by, "label").agg(F.sum("support").alias("support"), F.sum("predicted").alias("predicted"), F.sum("hit").alias("hit"))
    zero = F.lit(0.0)
    return per.select(
        *by,
        "label",
        F.coalesce(F.try_divide("hit", "predicted"), zero).alias("precision"),
        F.coalesce(F.try_divide("hit", "support"), zero).alias("recall"),
        F.coalesce(F.try_divide(2 * F.col("hit"), F.col("predicted") + F.col("support")), zero).alias("f1"),
        "support",
        "hit",
    )


def f1_scores(df: DataFrame, y: str = "y", pred: str = "pred", positive=1) -> DataFrame:
    """F1 of the positive class, and F1 averaged over classes by support."""
    per = _class_scores(df, y, pred, [])
    return per.agg(
        F.coalesce(F.max(F.when(F.col("label") == positive, F.col("f1"))), F.lit(0.0)).alias("f1_positive"),
        (F.sum(F.col("f1") * F.col("support")) / F.sum("support")).alias("f1_weighted"),
    )


def classification_report(
    df: DataFrame, y: str = "y", pred: str = "pred", by: list[str] | None = None, accuracy_everywhere: bool = False
) -> DataFrame:
    """Per class and for accuracy, macro avg, weighted avg: precision, recall, F1, support.

    The accuracy row has its value in ``f1`` only; ``accuracy_everywhere`` fills
    all four columns like a flattened report dictionary does.
    """
    by = by or []
    per = _class_scores(df, y, pred, by)
    classes = per.select(*by, F.col("label").cast("string").alias("label"), "precision", "recall", "f1", F.col("support").cast("double").alias("support"))
    total = F.sum("support").cast("double")
    acc = F.sum("hit") / F.sum("support")
    measures = ["precision", "recall", "f1"]
    macro = per.groupBy(*by).agg(F.lit("macro avg").alias("label"), *[F.avg(m).alias(m) for m in measures], total.alias("support"))
    weighted = per.groupBy(*by).agg(
        F.lit("weighted avg").alias("label"), *[(F.sum(F.col(m) * F.col("support")) / F.sum("support")).alias(m) for m in measures], total.alias("support")
    )
    other = acc if accuracy_everywhere else F.lit(None).cast("double")
    summary = per.groupBy(*by).agg(
        F.lit("accuracy").alias("label"), other.alias("precision"), other.alias("recall"), acc.alias("f1"), (acc if accuracy_everywhere else total).alias("support")
    )
    return reduce(DataFrame.unionByName, [classes, summary, macro, weighted])


def score_counts(df: DataFrame, y: str = "y", score: str = "score", by: list[str] | None = None, weight: str | None = None) -> DataFrame:
    """Positives and negatives per distinct score."""
    return df.filter(F.col(score).isNotNull()).groupBy(*(by or []), F.col(score).cast("double").alias("score")).agg(
        _total(weight, F.col(y) == 1).alias("pos"), _total(weight, F.col(y) != 1).alias("neg")
    )


def _cumulated(df: DataFrame, y: str, score: str, by: list[str], weight: str | None = None) -> DataFrame:
    counts = materialize(score_counts(df, y, score, by, weight), "scores")  # one scan of the rows
    totals = counts.groupBy(*by).agg(F.sum("pos").alias("all_pos"), F.sum("neg").alias("all_neg"))
    cum = running_totals(counts, by, "score", ["pos", "neg"])
    if by:
        return attach(cum, totals, by)
    one = totals.first()
    return cum.withColumns({"all_pos": F.lit(one["all_pos"]), "all_neg": F.lit(one["all_neg"])})


def _end_point(cum: DataFrame, by: list[str], point: list[Column]) -> DataFrame:
    """The fixed point of each curve; the rows themselves are not read again."""
    return cum.select(*by).distinct().select(*by, *point) if by else cum.sparkSession.range(1).select(*point)


def roc_curve(df: DataFrame, y: str = "y", score: str = "score", by: list[str] | None = None, weight: str | None = None) -> DataFrame:
    """(threshold, fpr, tpr) for every distinct score, and the origin at infinity."""
    by = by or []
    cum = _cumulated(df, y, score, by, weight)
    points = cum.select(
        *by, F.col("score").alias("threshold"), F.try_divide("cum_neg", "all_neg").alias("fpr"), F.try_divide("cum_pos", "all_pos").alias("tpr")
    )
    start = [F.lit(float("inf")).alias("threshold"), F.lit(0.0).alias("fpr"), F.lit(0.0).alias("tpr")]
    return points.unionByName(_end_point(cum, by, start))


def roc_auc(df: DataFrame, y: str = "y", score: str = "score", by: list[str] | None = None, weight: str | None = None) -> DataFrame:
    """Area under the ROC curve by trapezoids.

    Each distinct score adds its negatives times the positives ranked above it
    plus half of its own, which is the trapezoid sum without a neighbour lookup.
    """
    by = by or []
    cum = _cumulated(df, y, score, by, weight)
    area = F.sum(F.col("neg") * (F.col("cum_pos") - F.col("pos") / 2.0))
    return cum.groupBy(*by).agg(F.try_divide(area, F.max("all_pos").cast("double") * F.max("all_neg")).alias("auc"))


def pr_curve(df: DataFrame, y: str = "y", score: str = "score", by: list[str] | None = None, weight: str | None = None) -> DataFrame:
    """(threshold, precision, recall) for every distinct score, and the end point (1, 0)."""
    by = by or []
    cum = _cumulated(df, y, score, by, weight)
    points = cum.select(
        *by,
        F.col("score").alias("threshold"),
        (F.col("cum_pos") / (F.col("cum_pos") + F.col("cum_neg"))).alias("precision"),
        F.try_divide("cum_pos", "all_pos").alias("recall"),
    )
    end = [F.lit(None).cast("double").alias("threshold"), F.lit(1.0).alias("precision"), F.lit(0.0).alias("recall")]
    return points.unionByName(_end_point(cum, by, end))


def best_threshold(df: DataFrame, y: str = "y", score: str = "score", by: list[str] | None = None, digits: int | None = None) -> DataFrame:
    """The smallest threshold among those of highest F1, ``2PR / (P + R + 1e-9)``."""
    by = by or []
    curve = pr_curve(df, y, score, by).filter(F.col("threshold").isNotNull())
    p, r = F.col("precision"), F.col("recall")
    f1 = 2 * p * r / (p + r + F.lit(1e-9))
    best = F.max(F.struct((F.round(f1, digits) if digits else f1).alias("f1"), (-F.col("threshold")).alias("t")))
    return curve.groupBy(*by).agg(best.alias("b")).select(*by, (-F.col("b.t")).alias("threshold"), F.col("b.f1").alias("f1"))


def threshold_compare(df: DataFrame, thresholds: dict[str, float], y: str = "y", score: str = "score", by: list[str] | None = None) -> DataFrame:
    """Rates at several named thresholds, one scan for all of them."""
    by = by or []
    aggs = []
    for name, t in thresholds.items():
        pos = F.col(score) >= t
        aggs += [
            F.count_if((F.col(y) == 0) & ~pos).alias(f"tn_{name}"),
            F.count_if((F.col(y) == 0) & pos).alias(f"fp_{name}"),
            F.count_if((F.col(y) == 1) & ~pos).alias(f"fn_{name}"),
            F.count_if((F.col(y) == 1) & pos).alias(f"tp_{name}"),
        ]
    wide = df.groupBy(*by).agg(*aggs)
    rows = []
    for name, t in thresholds.items():
        r = rates(*[F.col(f"{c}_{name}") for c in ("tn", "fp", "fn", "tp")])
        rows.append(F.struct(F.lit(name).alias("setting"), F.lit(float(t)).alias("threshold"), *[r[m].alias(m) for m in ("fpr", "fnr", "f1")]))
    return wide.select(*by, F.inline(F.array(*rows)))


def prediction_balance(df: DataFrame, y: str = "y", pred: str = "pred", by: list[str] | None = None) -> DataFrame:
    """Predicted against actual attacks."""
    return df.groupBy(*(by or [])).agg(
        F.sum(F.col(pred).cast("bigint")).alias("predicted"), F.sum(F.col(y).cast("bigint")).alias("actual"), F.count("*").alias("rows")
    )


def score_summary(df: DataFrame, pred: str = "pred", latency: str | None = None) -> DataFrame:
    """Rows scored, benign and attack counts and percents, mean latency."""
    n, attack = F.count("*"), F.count_if(F.col(pred) == 1)
    cols = [
        n.alias("total"),
        (n - attack).alias("benign"),
        attack.alias("attack"),
        (F.try_divide(n - attack, n) * 100).alias("benign_pct"),
        (F.try_divide(attack, n) * 100).alias("attack_pct"),
    ]
    if latency:
        cols.append(F.avg(latency).alias("mean_latency"))
    return df.agg(*cols)


def metric_row(df: DataFrame, y: str = "y", pred: str = "pred", score: str | None = "score", by: list[str] | None = None) -> DataFrame:
    """Accuracy, F1 and AUC, one row per group: the row of a model comparison table.

    Rows are scored and counted once, per truth, prediction and score.
    """
    by = by or []
    if score is None:
        base = binary_rates(df, y, pred, by).select(*by, "accuracy", "f1")
        return base.withColumn("auc", F.lit(None).cast("double"))
    counts = df.groupBy(*by, F.col(y).alias("y"), F.col(pred).alias("pred"), F.col(score).alias("score")).agg(F.count("*").alias("n"))
    counts = materialize(counts, "outcomes")
    base = binary_rates(counts, "y", "pred", by, weight="n").select(*by, "accuracy", "f1")
    area = roc_auc(counts, "y", "score", by, "n")
    if by:
        return attach(base, area, by)
    return base.withColumn("auc", area.select("auc").scalar())

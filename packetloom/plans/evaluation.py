"""Queries over the evaluation operators."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from packetloom.operators import evaluate as ev
from packetloom.operators import summaries
from packetloom.plans.registry import query
from packetloom.plans.views import RUNS, SCORED, Views, rounded

_S = f"WITH {SCORED}"
_CELLS = """cells AS (SELECT count(*) FILTER (WHERE y = 0 AND pred = 0) AS tn, count(*) FILTER (WHERE y = 0 AND pred = 1) AS fp,
  count(*) FILTER (WHERE y = 1 AND pred = 0) AS fn, count(*) FILTER (WHERE y = 1 AND pred = 1) AS tp FROM scored)"""
_TYPES = ["click", "error", "purchase", "signup", "view"]


def _report_sql(by: str = "") -> str:
    """Classification report over y_text / pred_text, optionally per group."""
    g = f"{by}, " if by else ""
    grp = f"GROUP BY {by}" if by else ""
    return f"""{_S}, sides AS (
  SELECT {g}y_text AS label, 1 AS sup, 0 AS prd, CASE WHEN y_text = pred_text THEN 1 ELSE 0 END AS hit FROM scored
  UNION ALL SELECT {g}pred_text, 0, 1, 0 FROM scored),
per AS (SELECT {g}label, sum(sup) AS support, sum(hit) AS hit, coalesce(sum(hit) / nullif(sum(prd), 0), 0) AS p,
  coalesce(sum(hit) / nullif(sum(sup), 0), 0) AS r, coalesce(2 * sum(hit) / nullif(sum(sup) + sum(prd), 0), 0) AS f FROM sides GROUP BY {g}label),
rows AS (
  SELECT {g}label, p, r, f, support::DOUBLE AS support FROM per
  UNION ALL SELECT {g}'accuracy', NULL, NULL, sum(hit) / sum(support), sum(support) FROM per {grp}
  UNION ALL SELECT {g}'macro avg', avg(p), avg(r), avg(f), sum(support) FROM per {grp}
  UNION ALL SELECT {g}'weighted avg', sum(p * support) / sum(support), sum(r * support) / sum(support), sum(f * support) / sum(support), sum(support) FROM per {grp})
SELECT {g}label, round(p, 6) AS precision, round(r, 6) AS recall, round(f, 6) AS f1, support FROM rows"""


@query(f"{_S} SELECT y_text AS y, " + ", ".join(f"count(*) FILTER (WHERE pred_text = '{t}') AS pred_{t}" for t in _TYPES) + " FROM scored GROUP BY y_text")
def confusion_matrix(v: Views):
    return ev.confusion_matrix(v.scored(), _TYPES, "y_text", "pred_text")


@query(f"{_S} SELECT y_text AS y, pred_text AS pred, count(*) AS n, round(count(*) / sum(count(*)) OVER (PARTITION BY y_text), 6) AS share FROM scored GROUP BY y_text, pred_text")
def confusion_normalized(v: Views):
    return rounded(ev.confusion_normalized(v.scored(), "y_text", "pred_text"))


@query(f"""{_S}, {_CELLS} SELECT tn, fp, fn, tp, round(tp / (tp + fn), 6) AS tpr, round(fp / (fp + tn), 6) AS fpr, round(fn / (fn + tp), 6) AS fnr,
  round((tp + tn) / (tn + fp + fn + tp), 6) AS accuracy, round(2 * tp / (2 * tp + fp + fn), 6) AS f1, fp / (fp + tn) < 0.03 AS fpr_ok FROM cells""")
def binary_rates(v: Views):
    return rounded(ev.binary_rates(v.scored()))


@query(f"{_S} SELECT source, round(avg(CASE WHEN y = pred THEN 1 ELSE 0 END), 6) AS accuracy, count(*) AS rows FROM scored GROUP BY source")
def accuracy(v: Views):
    return rounded(ev.accuracy(v.scored(), by=["source"]))


@query(f"""{_S}, c AS (SELECT k.label, count(*) FILTER (WHERE y = k.label) AS sup, count(*) FILTER (WHERE pred = k.label) AS prd, count(*) FILTER (WHERE y = k.label AND pred = k.label) AS hit
  FROM scored, (VALUES (0), (1)) k(label) GROUP BY k.label), f AS (SELECT label, sup, 2 * hit / (sup + prd) AS f1 FROM c)
SELECT round(max(f1) FILTER (WHERE label = 1), 6) AS f1_positive, round(sum(f1 * sup) / sum(sup), 6) AS f1_weighted FROM f""")
def f1_scores(v: Views):
    return rounded(ev.f1_scores(v.scored()))


@query(_report_sql())
def classification_report(v: Views):
    return rounded(ev.classification_report(v.scored(), "y_text", "pred_text"))


@query(_report_sql("source"))
def per_source_report(v: Views):
    return rounded(ev.classification_report(v.scored(), "y_text", "pred_text", ["source"]))


_CUM = """pts AS (SELECT score, count(*) FILTER (WHERE y = 1) AS pos, count(*) FILTER (WHERE y = 0) AS neg FROM scored GROUP BY score),
cum AS (SELECT score, pos, neg, sum(pos) OVER w AS tp, sum(neg) OVER w AS fp, sum(pos) OVER () AS p, sum(neg) OVER () AS n FROM pts WINDOW w AS (ORDER BY score DESC))"""


@query(f"{_S}, {_CUM} SELECT score AS threshold, round(fp / n, 6) AS fpr, round(tp / p, 6) AS tpr FROM cum UNION ALL SELECT 'Infinity'::DOUBLE, 0, 0")
def roc_curve(v: Views):
    return rounded(ev.roc_curve(v.scored()), 6, ["fpr", "tpr"])


@query(f"{_S}, {_CUM}, t AS (SELECT *, lag(tp, 1, 0) OVER (ORDER BY score DESC) AS tp0, lag(fp, 1, 0) OVER (ORDER BY score DESC) AS fp0 FROM cum) SELECT round(sum((fp - fp0) / n * (tp + tp0) / 2 / p), 6) AS auc FROM t")
def roc_auc(v: Views):
    return rounded(ev.roc_auc(v.scored()))


_CUM_BY = """pts AS (SELECT source, score, count(*) FILTER (WHERE y = 1) AS pos, count(*) FILTER (WHERE y = 0) AS neg FROM scored GROUP BY source, score),
cum AS (SELECT source, score, pos, neg, sum(pos) OVER w AS tp, sum(neg) OVER w AS fp, sum(pos) OVER a AS p, sum(neg) OVER a AS n FROM pts
  WINDOW w AS (PARTITION BY source ORDER BY score DESC), a AS (PARTITION BY source))"""


@query(f"{_S}, {_CUM_BY} SELECT source, round(sum(neg * (tp - pos / 2.0)) / max(p) / max(n), 6) AS auc FROM cum GROUP BY source")
def roc_auc_by_source(v: Views):
    return rounded(ev.roc_auc(v.scored(), by=["source"]))


@query(f"{_S}, {_CUM} SELECT score AS threshold, round(tp / (tp + fp), 6) AS precision, round(tp / p, 6) AS recall FROM cum UNION ALL SELECT NULL, 1, 0")
def pr_curve(v: Views):
    return rounded(ev.pr_curve(v.scored()), 6, ["precision", "recall"])


_BEST = f"""{_CUM}, f AS (SELECT score, round(2 * (tp / (tp + fp)) * (tp / p) / (tp / (tp + fp) + tp / p + 1e-9), 9) AS f1 FROM cum),
best AS (SELECT score AS threshold, f1 FROM f ORDER BY f1 DESC, score LIMIT 1)"""


@query(f"{_S}, {_BEST} SELECT round(threshold, 6) AS threshold, round(f1, 6) AS f1 FROM best")
def best_threshold(v: Views):
    return rounded(ev.best_threshold(v.scored(), digits=9))


@query(f"""{_S}, {_BEST}, t AS (SELECT 'default' AS setting, 0.5::DOUBLE AS threshold UNION ALL SELECT 'best', threshold FROM best),
c AS (SELECT setting, threshold, count(*) FILTER (WHERE y = 0 AND score < threshold) AS tn, count(*) FILTER (WHERE y = 0 AND score >= threshold) AS fp,
  count(*) FILTER (WHERE y = 1 AND score < threshold) AS fn, count(*) FILTER (WHERE y = 1 AND score >= threshold) AS tp FROM scored, t GROUP BY setting, threshold)
SELECT setting, round(threshold, 6) AS threshold, round(fp / (fp + tn), 6) AS fpr, round(fn / (fn + tp), 6) AS fnr, round(2 * tp / (2 * tp + fp + fn), 6) AS f1 FROM c""")
def threshold_compare(v: Views):
    best = ev.best_threshold(v.scored(), digits=9).first()["threshold"]
    return rounded(ev.threshold_compare(v.scored(), {"default": 0.5, "best": best}))


@query(f"{_S} SELECT source, sum(pred)::BIGINT AS predicted, sum(y)::BIGINT AS actual, count(*) AS rows FROM scored GROUP BY source")
def prediction_balance(v: Views):
    return ev.prediction_balance(v.scored(), by=["source"])


@query(f"""{_S} SELECT count(*) AS total, count(*) FILTER (WHERE pred <> 1) AS benign, count(*) FILTER (WHERE pred = 1) AS attack,
  round(count(*) FILTER (WHERE pred <> 1) / count(*) * 100, 6) AS benign_pct, round(count(*) FILTER (WHERE pred = 1) / count(*) * 100, 6) AS attack_pct,
  round(avg(score), 6) AS mean_latency FROM scored""")
def score_summary(v: Views):
    return rounded(ev.score_summary(v.scored(), latency="score"))


@query(f"""{_S}, {_CUM_BY}, auc AS (SELECT source, sum(neg * (tp - pos / 2.0)) / max(p) / max(n) AS auc FROM cum GROUP BY source),
models AS (SELECT 'rule' AS model, source, y, pred, score FROM scored UNION ALL SELECT 'strict', source, y, CASE WHEN score >= 0.8 THEN 1 ELSE 0 END, score FROM scored),
c AS (SELECT model, source, count(*) FILTER (WHERE y = pred) AS ok, count(*) AS n, count(*) FILTER (WHERE y = 1 AND pred = 1) AS tp, count(*) FILTER (WHERE y <> pred) AS wrong FROM models GROUP BY model, source)
SELECT model, source, round(ok / n, 6) AS accuracy, round(2 * tp / (2 * tp + wrong), 6) AS f1, round(auc, 6) AS auc FROM c JOIN auc USING (source)""")
def metric_matrix(v: Views):
    """Two models over every source."""
    models = {"rule": v.scored(), "strict": v.scored().withColumn("pred", (F.col("score") >= 0.8).cast("int"))}
    rows = [ev.metric_row(df, by=["source"]).select(F.lit(m).alias("model"), "source", "accuracy", "f1", "auc") for m, df in models.items()]
    return rounded(reduce(DataFrame.unionByName, rows))


@query(f"""{_S} SELECT 'Rule 0.5' AS experiment, round(avg(CASE WHEN y = pred THEN 1 ELSE 0 END), 4) AS accuracy, 1 AS features FROM scored
UNION ALL SELECT 'Text rule', round(avg(CASE WHEN y_text = pred_text THEN 1 ELSE 0 END), 4), 1 FROM scored""")
def experiment_summary(v: Views):
    runs = {"Rule 0.5": ("y", "pred", ["score"]), "Text rule": ("y_text", "pred_text", ["value"])}
    rows = [
        ev.accuracy(v.scored(), y, p).select(F.lit(n).alias("experiment"), F.round("accuracy", 4).alias("accuracy"), F.lit(len(f)).alias("features"))
        for n, (y, p, f) in runs.items()
    ]
    return reduce(DataFrame.unionByName, rows)


@query(f"WITH {RUNS} SELECT count(*) AS runs, round(avg(ms), 6) AS mean_ms, round(median(ms), 6) AS median_ms, round(quantile_cont(ms, 0.99), 6) AS p99_ms, round(min(ms), 6) AS min_ms, round(1000 / avg(ms), 6) AS throughput FROM runs")
def latency_summary(v: Views):
    return rounded(summaries.latency_summary(v.runs(), "ms"))


@query(f"""WITH {RUNS}, k AS (SELECT *, row_number() OVER (PARTITION BY batch ORDER BY l_orderkey, l_partkey, l_suppkey) AS rn FROM runs)
SELECT batch, count(*) AS runs, round(avg(ms), 6) AS mean_ms, round(quantile_cont(ms, 0.99), 6) AS p99_ms, round(batch * 1000 / avg(ms), 6) AS throughput FROM k WHERE rn > 20 GROUP BY batch""")
def latency_by_batch(v: Views):
    return rounded(summaries.latency_by_batch(v.runs(), "batch", "ms", ["l_orderkey", "l_partkey", "l_suppkey"], 20))

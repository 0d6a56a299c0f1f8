"""The whole experiment over aligned sources as one call."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from packetloom.operators import models as ml
from packetloom.operators.evaluate import metric_row
from packetloom.operators.prep import Scaler, preprocess
from packetloom.operators.schema import union_sources


@dataclass
class Experiment:
    """``summary``: experiment, accuracy, f1, auc, features, sources. ``deployable`` takes raw features."""

    summary: DataFrame
    baseline: PipelineModel
    unified: PipelineModel
    deployable: PipelineModel


def unified_experiment(
    sources: dict[str, DataFrame], features: list[str], label: str, key: list[str], estimator: Callable[[], object], home: str
) -> Experiment:
    """Baseline trained at ``home`` and tried on the unseen sources, then one model of all.

    Train parts are scaled per source and pooled for the unified model. The
    deployable model learns from the same train rows unscaled, with the pooled
    scaler inside its pipeline. Models learn folded rows (see ``train``).
    """
    # what is scaled later is kept as it came, for the deployable model
    raws = {f"__raw_{c}": F.col(c) for c in features}
    parts = {n: preprocess(df.withColumns(raws), features, label, key, keep=list(raws), store=True) for n, df in sources.items()}
    rows = []

    def note(name: str, scored: DataFrame, trained_on: list[str]) -> None:
        m = metric_row(scored, label).first()
        rows.append((name, m["accuracy"], m["f1"], m["auc"], len(features), ",".join(trained_on)))

    at_home = parts[home]
    baseline = ml.train(at_home.train, features, label, estimator(), stored=True, folded=True)
    note(f"baseline {home}", ml.score(baseline, at_home.test), [home])
    for n, df in sources.items():
        if n != home:  # every row of an unseen source, scaled as at home
            unseen = at_home.scaler.transform(ml.keep_finite(df, [*features, label]))
            note(f"baseline {n} (unseen)", ml.score(baseline, unseen), [home])

    pooled = union_sources({n: p.train.select(*features, label, *raws) for n, p in parts.items()})
    unified = ml.train(pooled, features, label, estimator(), stored=True, folded=True)
    for n, p in parts.items():
        note(f"unified {n}", ml.score(unified, p.test), list(sources))

    raw = pooled.select(*[F.col(r).alias(c) for r, c in zip(raws, features)], label)
    deployable = ml.train(raw, features, label, estimator(), Scaler.fit(raw, features), stored=True, folded=True)
    ddl = "experiment string, accuracy double, f1 double, auc double, features int, sources string"
    summary = raw.sparkSession.createDataFrame(rows, ddl)
    return Experiment(summary.withColumns({c: F.round(c, 4) for c in ("accuracy", "f1", "auc")}), baseline, unified, deployable)

"""Training, scoring and explaining tree classifiers with Spark ML."""

from __future__ import annotations

import hashlib
import math
import time
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, OneVsRest, OneVsRestModel, RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.feature import Bucketizer, SQLTransformer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from packetloom.functions.dims import attach
from packetloom.functions.draws import draws
from packetloom.functions.ordering import below_quotas, digest, handed_across, handed_round, in_blocks, numbered
from packetloom.functions.scratch import materialize, spread, spread_rows
from packetloom.operators.clean import keep_finite
from packetloom.operators.evaluate import accuracy, binary_rates, metric_row, score_summary
from packetloom.operators.flows import flow_features, to_unified
from packetloom.operators.prep import Scaler
from packetloom.operators.sampling import sample_n
from packetloom.operators.schema import FEATURES, require, trim_names
from packetloom.operators.softmax import SoftmaxBoosting

Scorer = Callable[[DataFrame], DataFrame]


def random_forest(trees: int = 100, depth: int = 20, min_leaf: int = 1, seed: int = 42, weight: str | None = None):
    est = RandomForestClassifier(numTrees=trees, maxDepth=depth, minInstancesPerNode=min_leaf, seed=seed, maxMemoryInMB=1024)
    return est.setWeightCol(weight) if weight else est


def boosted_trees(trees: int = 100, depth: int = 6, step: float = 0.1, rows: float = 1.0, columns: str = "all", seed: int = 42, weight: str | None = None):
    """Binary gradient-boosted trees. ``rows`` and ``columns`` subsample per tree and node."""
    est = GBTClassifier(maxIter=trees, maxDepth=depth, stepSize=step, subsamplingRate=rows, featureSubsetStrategy=columns, seed=seed, maxMemoryInMB=1024)
    return est.setWeightCol(weight) if weight else est


def multiclass(binary, weight: str | None = None, parallelism: int = 4) -> OneVsRest:
    """A binary learner for several classes, one against the rest each."""
    est = OneVsRest(classifier=binary, parallelism=parallelism)
    return est.setWeightCol(weight) if weight else est


def scaling_stage(scaler: Scaler) -> SQLTransformer:
    """The fitted scaler as part of a saved pipeline, so it is applied exactly once."""
    row = scaler.stats.first()
    cols = []
    for c in scaler.features:
        mean, sd = float(row[f"{c}_mean"]), float(row[f"{c}_sd"]) or 1.0
        cols.append(f"(`{c}` - double('{mean!r}')) / double('{sd!r}') AS `{c}__scaled`")
    return SQLTransformer(statement=f"SELECT *, {', '.join(cols)} FROM __THIS__")


#: Ranges of a feature that the tree learners tell apart.
BINS = 32


def binning_stage(df: DataFrame, columns: list[str]) -> Bucketizer:
    """``columns`` as numbers of ranges, in ``<column>__binned``: one a value where there are ``BINS`` values or fewer, else equally filled ones of all rows.

    Two passes over ``df``, whatever the number of columns.
    """
    marks = [i / BINS for i in range(1, BINS)]
    about = df.agg(*[x for i, c in enumerate(columns) for x in (F.approx_count_distinct(c).alias(f"n{i}"), F.percentile_approx(c, marks, 1000).alias(f"q{i}"))]).first()
    few = [i for i in range(len(columns)) if about[f"n{i}"] <= 2 * BINS]  # more than BINS values are told apart for sure
    seen = df.agg(*[F.collect_set(columns[i]).alias(f"v{i}") for i in few]).first() if few else {}
    splits = []
    for i in range(len(columns)):
        values = sorted({float(x) for x in seen[f"v{i}"]}) if i in few else []
        if i in few and len(values) <= BINS:
            inner = {(x + y) / 2 for x, y in zip(values, values[1:])} or {0.0}
        else:
            inner = {float(x) for x in about[f"q{i}"] or []}
        splits.append([-math.inf, *sorted(inner), math.inf])
    return Bucketizer(splitsArray=splits, inputCols=columns, outputCols=[f"{c}__binned" for c in columns], handleInvalid="error")


def _forest(rows: DataFrame, label: str, estimator: RandomForestClassifier, parallelism: int = 8) -> RandomForestClassificationModel:
    """A forest over rows that stand for ``__rows`` equal ones and weigh ``__weight`` together.

    Each tree's sample is drawn among the rows that are stood for, as from the unfolded
    table; Spark's own draws would take or leave all of them at once. Trees grow one by one.
    """
    trees, rate, again = estimator.getNumTrees(), estimator.getSubsamplingRate(), estimator.getBootstrap()
    strategy = estimator.getFeatureSubsetStrategy()
    strategy = "sqrt" if strategy == "auto" and trees > 1 else strategy
    classes = int(rows.agg(F.max(label)).first()[0]) + 1
    key = F.xxhash64("features", label, "__weight")
    told = draws(key, F.col("__rows"), [estimator.getSeed() + i for i in range(trees)], rate, again)
    seen = rows.withColumn("__draws", told)
    weights = [(F.col("__weight") * F.col("__draws")[i] / F.col("__rows")).alias(f"__w{i}") for i in range(trees)]
    nominal = {"ml_attr": {"type": "nominal", "num_vals": classes}}  # a tree need not see all classes
    seen = spread_rows(spread(materialize(seen.select("features", F.col(label).alias(label), *weights), "samples")))

    def grow(i: int):
        one = estimator.copy().setNumTrees(1).setBootstrap(False).setSubsamplingRate(1.0).setFeatureSubsetStrategy(strategy)
        one = one.setSeed(estimator.getSeed() + i).setLabelCol(label).setFeaturesCol("features").setWeightCol("__w")
        return one.fit(seen.select("features", F.col(label).alias(label, metadata=nominal), F.col(f"__w{i}").alias("__w")).filter("__w > 0")).trees[0]

    with ThreadPoolExecutor(parallelism) as pool:
        grown = list(pool.map(grow, range(trees)))
    jvm, gateway = rows.sparkSession._jvm, rows.sparkSession.sparkContext._gateway
    array = gateway.new_array(jvm.org.apache.spark.ml.classification.DecisionTreeClassificationModel, trees)
    for i, tree in enumerate(grown):
        array[i] = tree._java_obj
    features = max(t.numFeatures for t in grown)
    made = jvm.org.apache.spark.ml.classification.RandomForestClassificationModel(f"{estimator.uid}_folded", array, features, classes)
    made.set("numTrees", trees)
    return RandomForestClassificationModel(made).setFeaturesCol("features")


def _train_folded(df: DataFrame, inputs: list[str], label: str, estimator, before: list) -> PipelineModel:
    """Fit on each row of binned features and label once, weighed by the rows (or their weight) it stands for."""
    for stage in before:
        df = stage.transform(df)
    cut = binning_stage(df, inputs)
    binned = [f"{c}__binned" for c in inputs]
    weighted = estimator.isDefined("weightCol")
    weight = F.col(estimator.getWeightCol()) if weighted else F.lit(1)
    # rows of which some are drawn are equal in their weight, too
    equal = [*binned, label, *([estimator.getWeightCol()] if weighted and not isinstance(estimator, GBTClassifier) else [])]
    rows = cut.transform(df).groupBy(*equal).agg(F.sum(weight.cast("double")).alias("__weight"), F.count("*").alias("__rows"))
    rows = spread(materialize(rows, "train"))
    assembler = VectorAssembler(inputCols=binned, outputCol="features", handleInvalid="error")
    if isinstance(estimator, RandomForestClassifier):
        return PipelineModel([*before, cut, assembler, _forest(assembler.transform(rows), label, estimator)])
    learner = estimator.copy().setLabelCol(label).setFeaturesCol("features").setWeightCol("__weight")
    if isinstance(learner, SoftmaxBoosting):
        learner = learner.setCountCol("__rows")
    return PipelineModel([*before, cut, *Pipeline(stages=[assembler, learner]).fit(spread_rows(rows)).stages])


def train(df: DataFrame, features: list[str], label: str, estimator, scaler: Scaler | None = None, stored: bool = False, folded: bool = False) -> PipelineModel:
    """Fit a pipeline: scale (if a scaler is given), assemble, learn.

    The rows are read several times. They are written once first, unless ``stored``
    says that ``df`` is a plain read already. With ``folded`` features are cut into the
    ranges that trees tell apart first, by all rows, and rows equal in all ranges and the
    label are learned from once, with their number as the weight: what is learned from
    grows with the distinct rows. Samples of rows (of a forest's trees, say) are still
    drawn among all rows; only a leaf's least number counts the folded ones. Binary
    boosting that samples rows is not folded, since Spark draws its samples.
    """
    require(df, [*features, label])
    inputs = [f"{c}__scaled" for c in features] if scaler else features
    stages = [scaling_stage(scaler)] if scaler else []
    stages += [
        VectorAssembler(inputCols=inputs, outputCol="features", handleInvalid="error"),
        estimator.setLabelCol(label).setFeaturesCol("features"),
    ]
    weight = estimator.getWeightCol() if estimator.isDefined("weightCol") else None
    data = df.select(*features, F.col(label).cast("double").alias(label), *([weight] if weight else []))
    data = data if stored else spread(materialize(data, "train"))
    if folded and not (isinstance(estimator, GBTClassifier) and estimator.getSubsamplingRate() < 1):
        return _train_folded(data, inputs, label, estimator, stages[:-2])
    return Pipeline(stages=stages).fit(spread_rows(data))


def score(model: PipelineModel, df: DataFrame, confidence: bool = False, probabilities: str | None = None) -> DataFrame:
    """Adds ``pred`` and, where the model gives probabilities, ``score`` (of class 1).

    ``confidence`` is the probability of the predicted class, four decimals;
    ``probabilities`` names a column for those of all classes.
    """
    out = model.transform(df)
    extra = ["features", "rawPrediction", "probability", "prediction"]
    cols = [F.col("prediction").cast("int").alias("pred")]
    if "probability" in out.columns:
        p = vector_to_array("probability")
        cols.append(F.get(p, F.lit(1)).alias("score"))
        if probabilities:
            cols.append(p.alias(probabilities))
        if confidence:
            cols.append(F.round(F.get(p, F.col("prediction").cast("int")), 4).alias("confidence"))
    keep = [c for c in out.columns if c not in extra and not c.endswith(("__scaled", "__binned"))]
    return out.select(*keep, *cols)


def predict(model: PipelineModel, df: DataFrame) -> DataFrame:
    """Adds ``pred`` only: the same labels as ``score`` without building score vectors."""
    *before, learner = model.stages
    unused = [learner.getParam(n) for n in ("rawPredictionCol", "probabilityCol") if learner.hasParam(n)]
    if not isinstance(learner, OneVsRestModel):
        learner = learner.copy({p: "" for p in unused})
    out = df
    for stage in [*before, learner]:
        out = stage.transform(out)
    return out.select(*df.columns, F.col("prediction").cast("int").alias("pred"))


def verdict(pred: str = "pred"):
    return F.when(F.col(pred) == 1, "ATTACK").otherwise("BENIGN")


def save_model(model: PipelineModel, path: str) -> None:
    model.write().overwrite().save(path)


def load_model(path: str) -> PipelineModel:
    return PipelineModel.load(path)


def feature_importance(model: PipelineModel, features: list[str], spark: SparkSession) -> DataFrame:
    """(feature, importance) of a fitted forest or boosted model."""
    values = model.stages[-1].featureImportances.toArray()
    return spark.createDataFrame([(f, float(v)) for f, v in zip(features, values)], "feature string, importance double")


def score_table(model: PipelineModel, flows: DataFrame, features: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """(scored rows, summary) of a flow table read from files.

    Fails before any work if a feature is absent; rows with missing or infinite
    features are left out. One narrow job up to the final counts.
    """
    feats = features or FEATURES
    flows = trim_names(flows)
    require(flows, feats)
    scored = predict(model, keep_finite(flows, feats))
    return scored, score_summary(scored)


def score_packets(model: PipelineModel, packets: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Packets to one verdict per flow: key, duration, packets, bytes, rate, prediction, label."""
    return score_flow_rows(model, flow_features(packets, by), by)


def score_flow_rows(model: PipelineModel, flows: DataFrame, by: list[str] | None = None) -> DataFrame:
    """One verdict per row of flow features."""
    shown = ["flow_key", "duration", "pkt_count", "total_bytes", "pkts_per_sec"]
    rows = to_unified(flows, [*(by or []), *shown])
    scored = predict(model, rows)
    return scored.select(
        *(by or []),
        "flow_key",
        F.col("duration").alias("duration_s"),
        "pkt_count",
        "total_bytes",
        "pkts_per_sec",
        verdict().alias("prediction"),
        F.col("pred").alias("label"),
    )


def compare_models(
    estimators: dict[str, object],
    train_rows: DataFrame,
    tests: dict[str, DataFrame],
    features: list[str],
    label: str,
    row_limit: dict[str, tuple[list[str], int]] | None = None,
    folded: bool = False,
) -> DataFrame:
    """(model, dataset, accuracy, f1, auc, train_s): each model fitted once, scored on every test set.

    ``row_limit`` gives a model's key columns and the size of a uniform train
    sample, for a learner that is to be compared on fewer rows. ``folded`` lets the others
    learn folded rows (see ``train``), straight from ``train_rows``: store them first.
    """
    rows = []
    for name, est in estimators.items():
        data, whole = train_rows, True
        if row_limit and name in row_limit:
            key, n = row_limit[name]
            data, whole = sample_n(train_rows, key, n), False
        began = time.time()
        model = train(data, features, label, est, stored=folded and whole, folded=folded and whole)
        took = round(time.time() - began, 2)
        for ds, test in tests.items():
            m = metric_row(score(model, test), label, "pred", "score").first()
            rows.append((name, ds, m["accuracy"], m["f1"], m["auc"], took))
    return train_rows.sparkSession.createDataFrame(rows, "model string, dataset string, accuracy double, f1 double, auc double, train_s double")


def cross_dataset(model: PipelineModel, home: DataFrame, away: DataFrame, label: str) -> DataFrame:
    """In-distribution and unseen accuracy of one model, and the gap in points.

    The model's pipeline holds the home scaler, so both sets are scaled by it.
    """
    acc = binary_rates(score(model, home), label).select("accuracy").scalar()
    return binary_rates(score(model, away), label).select(
        acc.alias("home_accuracy"),
        F.col("accuracy").alias("away_accuracy"),
        F.col("f1").alias("away_f1"),
        ((acc - F.col("accuracy")) * 100).alias("gap_points"),
    )


def learning_curve(
    train_rows: DataFrame, test_rows: DataFrame, features: list[str], label: str, key: list[str], fractions: list[float], estimator: Callable[[], object], min_rows: int = 100, seed: int = 42
) -> DataFrame:
    """(fraction, rows, train_acc, test_acc, train_f1, test_f1) per share of the train rows.

    Rows are ranked once in each class by the digest of their key, as far as quotas need it,
    and a share is what ranks below its quota (at least ``min_rows`` in all and one row a
    class), so each smaller sample lies inside the larger. Models learn folded rows (see
    ``train``). All models' verdicts on all rows come from one scan.
    """
    rows = materialize(train_rows.select(*features, label, *key), "curve")
    total = rows.count()
    quota = lambda f: F.least(F.col("n"), F.greatest(F.lit(1), F.floor(F.lit(max(math.floor(total * f), min_rows)) * F.col("n") / total)))
    shares = [f"s{i}" for i in range(len(fractions))]
    ranked = below_quotas(rows, digest(key, seed), [*key, *features], [label], {c: quota(f) for c, f in zip(shares, fractions)})
    ranked = materialize(ranked.select(*features, label, *shares), "ranked")
    models = [train(ranked.filter(c), features, label, estimator(), stored=True, folded=True) for c in shares]

    inside = [F.array(*shares), F.array(*[F.lit(True)] * len(fractions))]
    scored = ranked.select(*features, label, F.lit("train").alias("part"), inside[0].alias("inside"))
    scored = scored.unionByName(test_rows.select(*features, label, F.lit("test").alias("part"), inside[1].alias("inside")))
    for i, model in enumerate(models):
        scored = predict(model, scored).withColumnRenamed("pred", f"p{i}")
    cells = [
        F.count_if(F.col("inside")[i] & (F.col(label) == y) & (F.col(f"p{i}") == p)).alias(f"{name}{i}")
        for i in range(len(fractions)) for name, y, p in (("tn", 0, 0), ("fp", 0, 1), ("fn", 1, 0), ("tp", 1, 1))
    ]
    found = {r["part"]: r for r in scored.groupBy("part").agg(*cells).collect()}

    def told(part: str, i: int) -> tuple[int, float | None, float]:
        tn, fp, fn, tp = (found[part][f"{c}{i}"] if part in found else 0 for c in ("tn", "fp", "fn", "tp"))
        n = tn + fp + fn + tp
        return n, (tn + tp) / n if n else None, 2 * tp / (2 * tp + fp + fn) if tp else 0.0

    out = []
    for i, f in enumerate(fractions):
        (n, train_acc, train_f1), (_, test_acc, test_f1) = told("train", i), told("test", i)
        out.append((f, n, train_acc, test_acc, train_f1, test_f1))
    ddl = "fraction double, rows bigint, train_acc double, test_acc double, train_f1 double, test_f1 double"
    return train_rows.sparkSession.createDataFrame(out, ddl)


def _part(df: DataFrame, key: list[str], rows: int | None, seed: int) -> DataFrame:
    return df if rows is None else sample_n(df, key, rows, seed)


def _steps(text: str, n: int) -> int:
    """A number in [0, n) out of the first 8 hex digits of the md5 of ``text``, as ``digest_int`` draws it."""
    return int(hashlib.md5(text.encode()).hexdigest()[:8], 16) % n


def _shift(seed: int, run: int, feature: str, n: int) -> tuple[int, int]:
    """(a, b) of the permutation at -> (a at + b) mod n of row numbers, a without a factor in common with n."""
    drawn = lambda i: int(hashlib.md5(f"{seed}:{run}:{feature}:{i}".encode()).hexdigest()[:15], 16) % n
    return next((a for a in map(drawn, range(64)) if math.gcd(a, n) == 1), 1), drawn("b")


def permutation_importance(
    scorer: Scorer, df: DataFrame, features: list[str], label: str, key: list[str], repeats: int = 10, rows: int | None = None, seed: int = 42
) -> DataFrame:
    """(feature, importance, sd): accuracy lost when a feature's values are shuffled.

    Works on all rows, or on a uniform sample of ``rows``. Rows are numbered in the
    order of a digest; a shuffle is a keyed permutation of these numbers, so the row
    that hands a value over is found by arithmetic, and one join fetches the values of
    all shuffles. All shuffled copies are scored in one pass by ``scorer``, which must
    add ``pred`` to its input.
    """
    sample = materialize(_part(df.select(*features, label, *key), key, rows, seed), "sample")
    base = accuracy(scorer(sample), label).select("accuracy").scalar()
    places = materialize(numbered(sample, digest(key, seed), [*key, *features, label], "at"), "sample")
    n = max(1, places.count())
    runs = [(r, f) for r in range(repeats) for f in features]
    wide = handed_across(places, "at", n, [(*_shift(seed, r, f, n), f) for r, f in runs])
    given = F.array(*[F.struct(F.lit(r).alias("run"), F.lit(f).alias("feature"), F.col("handed")[i].alias("given")) for i, (r, f) in enumerate(runs)])
    copies = wide.select(*features, label, *key, F.inline(given))
    mixed = copies.withColumns({f: F.when(F.col("feature") == f, F.col("given").cast(copies.schema[f].dataType)).otherwise(F.col(f)) for f in features})
    per = scorer(mixed.drop("given")).groupBy("feature", "run").agg(F.avg((F.col(label) == F.col("pred")).cast("int")).alias("acc"))
    return per.groupBy("feature").agg(F.avg(base - F.col("acc")).alias("importance"), F.stddev_pop(base - F.col("acc")).alias("sd"))


#: Mixes of ranges whose scores are kept as one table of numbers.
GRID = 1 << 21


@dataclass
class Grid:
    """Scores of a folded model for every mix of its ranges: ``before`` makes the ranges' numbers, in ``columns``."""

    before: list
    columns: list[str]
    sizes: list[int]
    scores: np.ndarray


def score_grid(model: PipelineModel, spark: SparkSession) -> Grid | None:
    """The grid of a model trained with ``folded``, or None where there are more than ``GRID`` mixes."""
    *before, assembler, learner = model.stages
    columns = assembler.getInputCols()
    sizes = [len(s) - 1 for s in before[-1].getSplitsArray()]
    total = math.prod(sizes)
    if total > GRID:
        return None
    place, cells = F.col("id"), []
    for c, n in zip(reversed(columns), reversed(sizes)):
        cells.append((place % n).cast("double").alias(c))
        place = F.floor(place / n)
    found = score(PipelineModel([assembler, learner]), spark.range(total).select("id", *cells)).select("id", "score").toArrow()
    scores = np.empty(total)
    scores[found["id"].to_numpy()] = found["score"].to_numpy()
    return Grid(before, columns, sizes, scores)


def _grid_shares(wide: DataFrame, grid: Grid, features: list[str], key: list[str], draws: int, seed: int) -> DataFrame:
    """Moments of each row's shares (n, a, q of each feature): the mixes of a draw are steps in the grid, none is a row."""
    by_name = sorted(range(len(features)), key=lambda i: features[i])
    pairs = range(1, (draws + 1) // 2 + 1)
    drawn_by = [F.xxhash64(F.lit(seed), "row.at", F.lit(p).cast("bigint"), F.lit(features[i])).alias(f"x{p}_{i}") for p in pairs for i in by_name]
    rows = wide.select(*[F.col(f"row.{c}").alias(c) for c in key], *[F.col(f"row.{f}").cast("bigint").alias(f"own{i}") for i, f in enumerate(features)], *[f"h{d}" for d in range(draws)], *drawn_by)
    strides = np.array([math.prod(grid.sizes[i + 1 :]) for i in range(len(features))])
    scores = wide.sparkSession.sparkContext.broadcast(grid.scores)

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            each = np.arange(n)
            own = np.stack([batch[f"own{i}"].to_numpy() for i in range(len(features))], axis=1)
            orders = [np.array(by_name)[np.argsort(np.stack([batch[f"x{p}_{i}"].to_numpy() for i in by_name], axis=1), axis=1, kind="stable")] for p in pairs]
            shares = np.empty((n, draws, len(features)))
            for d in range(draws):
                back = batch[f"h{d}"].flatten().to_numpy().reshape(n, len(features)).astype(np.int64)
                order = orders[d // 2][:, :: -1 if d % 2 else 1]
                at = back @ strides
                last = scores.value[at]
                for j in range(len(features)):
                    f = order[:, j]
                    at = at + (own[each, f] - back[each, f]) * strides[f]
                    now = scores.value[at]
                    shares[each, d, f] = now - last
                    last = now
            mean = shares.mean(axis=1)
            off = ((shares - mean[:, None]) ** 2).sum(axis=1)
            out = {c: batch[c] for c in key}
            for i in range(len(features)):
                out |= {f"n_g{i}": pa.array(np.full(n, draws, np.int32)), f"a_g{i}": pa.array(mean[:, i]), f"q_g{i}": pa.array(off[:, i])}
            yield pa.RecordBatch.from_pydict(out)

    ddl = ", ".join([*(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in key), *(f"n_g{i} int, a_g{i} double, q_g{i} double" for i in range(len(features)))])
    return rows.mapInArrow(walk, ddl)


def _scored_shares(wide: DataFrame, scorer: Scorer, features: list[str], key: list[str], numbers: range, seed: int) -> DataFrame:
    """Moments of each row's shares (n, a, q of each feature): each mix is a row that ``scorer`` scores."""
    draw = wide.select("blk", "row.*", F.inline(F.array(*[F.struct(F.lit(d).alias("draw"), F.col(f"h{d - 1}").alias("back")) for d in numbers])))

    def order(number):
        pair = F.expr("(draw + 1) div 2") if number is None else F.lit((number + 1) // 2).cast("bigint")
        names = F.array_sort(F.array(*[F.struct(F.xxhash64(F.lit(seed), "at", pair, F.lit(f)).alias("h"), F.lit(f).alias("f")) for f in features]))["f"]
        if number is None:
            return F.when(F.col("draw") % 2 == 0, F.reverse(names)).otherwise(names)
        return F.reverse(names) if number % 2 == 0 else names

    mixes = draw.withColumn("order", order(None)).withColumn("joined", F.explode(F.sequence(F.lit(0), F.lit(len(features)))))
    cols = {f: F.when(F.array_position("order", f) <= F.col("joined"), F.col(f)).otherwise(F.col("back")[i].cast(mixes.schema[f].dataType)) for i, f in enumerate(features)}
    scored = scorer(mixes.withColumns(cols).select("blk", *key, "at", "draw", "order", "joined", *features))
    told = lambda d, j: F.max(F.when((F.col("draw") == d) & (F.col("joined") == j), F.col("score"))).alias(f"s{d}_{j}")
    chain = scored.groupBy("blk", "at", *key).agg(*[told(d, j) for d in numbers for j in range(len(features) + 1)])
    chain = chain.select(*key, *[order(d).alias(f"o{d}") for d in numbers], *[F.array(*[f"s{d}_{j}" for j in range(len(features) + 1)]).alias(f"s{d}") for d in numbers])
    shares = {}
    for i, f in enumerate(features):
        joins = {d: F.array_position(f"o{d}", f).cast("int") for d in numbers}
        shares[f"g{i}"] = F.filter(F.array(*[F.get(f"s{d}", joins[d]) - F.get(f"s{d}", joins[d] - 1) for d in numbers]), lambda g: g.isNotNull())
    chain = chain.select(*key, *[g.alias(c) for c, g in shares.items()])
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda x, y: x + y)
    # moments of each row's shares, put together over the rows of a key
    one = {}
    for c in shares:
        mean = total(F.col(c)) / F.nullif(F.size(c), F.lit(0))
        one |= {f"n_{c}": F.size(c), f"a_{c}": mean, c: F.col(c)}
    first = chain.select(*key, *[x.alias(c) for c, x in one.items()])

    def off(c: str):
        return total(F.transform(c, lambda g: (g - F.col(f"a_{c}")) * (g - F.col(f"a_{c}"))))

    return first.select(*key, *[x for c in shares for x in (f"n_{c}", f"a_{c}", off(c).alias(f"q_{c}"))])


def attribution(
    scorer: Scorer, df: DataFrame, features: list[str], key: list[str], rows: int | None = None, draws: int = 8, seed: int = 42, grid: Grid | None = None
) -> DataFrame:
    """Sampled Shapley values: (key, feature, attribution, error) of all rows, or of a uniform sample of ``rows``.

    Each draw mixes a row with another row of the sample: the features join one by one
    in a random order, and what the score gains when one joins is its share. The mixes
    of a draw are one chain, each scored once, so a draw costs one mix more than there
    are features. Every second draw takes the order of the one before backwards.
    ``attribution`` is the mean share, ``error`` its standard error. The shares of a row
    add up to its score less the mean score of the rows it was mixed with. Rows that
    share a key are averaged. All mixes are scored in one pass by ``scorer``, which must
    add ``score`` to its input. The features' numbers move to the rows that they are mixed
    with in blocks; mixes are made and folded where these rows are. With ``grid``, the
    table of a folded model's scores, rows are cut into its ranges and the same mixes are
    looked up there; ``scorer`` is not asked.
    """
    if grid:
        for stage in grid.before:
            df = stage.transform(df)
        df = df.select(*key, *[F.col(c).alias(f) for c, f in zip(grid.columns, features)])
    sample = materialize(_part(df.select(*features, *key), key, rows, seed), "sample")
    blocks = materialize(in_blocks(numbered(sample, digest(key, seed), [*key, *features], "at"), "at"), "blocks")
    n = max(1, blocks.agg(F.sum(F.size("rows"))).first()[0] or 0)
    # another row of the sample, a different step for each draw
    numbers = range(1, draws + 1)
    wide = handed_round(blocks, n, [(1 + _steps(f"{d}:{seed}", max(n - 1, 1)), features) for d in numbers])
    shares = [f"g{i}" for i in range(len(features))]
    first = _grid_shares(wide, grid, features, key, draws, seed) if grid else _scored_shares(wide, scorer, features, key, numbers, seed)
    folded = first.groupBy(*key).agg(
        F.count("*").alias("__rows"),
        *[x for c in shares for x in (F.sum(f"n_{c}").alias(f"n_{c}"), F.sum(F.col(f"n_{c}") * F.col(f"a_{c}")).alias(f"t_{c}"), F.sum(F.col(f"n_{c}") * F.col(f"a_{c}") * F.col(f"a_{c}")).alias(f"u_{c}"), F.sum(f"q_{c}").alias(f"q_{c}"))],
    )
    out = []
    for c, f in zip(shares, features):
        mean = F.col(f"t_{c}") / F.nullif(F.col(f"n_{c}"), F.lit(0))
        spread = F.col(f"q_{c}") + F.when(F.col("__rows") == 1, 0.0).otherwise(F.greatest(F.col(f"u_{c}") - F.col(f"t_{c}") * mean, F.lit(0.0)))
        error = F.when(F.col(f"n_{c}") > 1, F.sqrt(spread / (F.col(f"n_{c}") - 1)) / F.sqrt(F.col(f"n_{c}"))).otherwise(0.0)
        out.append(F.struct(F.lit(f).alias("feature"), mean.alias("attribution"), F.coalesce(error, F.lit(0.0)).alias("error")))
    return folded.select(*key, F.inline(F.array(*out)))


def attribution_ranking(values: DataFrame, k: int = 5) -> DataFrame:
    """The ``k`` features of highest mean absolute attribution."""
    mean = values.groupBy("feature").agg(F.avg(F.abs("attribution")).alias("importance"))
    return mean.orderBy(F.desc("importance"), "feature").limit(k)

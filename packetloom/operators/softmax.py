"""Gradient boosting for several classes at once, with probabilities, on Spark ML's regression trees.

Each round fits one regression tree a class to the gradient of the log loss. With p
the probability the model gives a class now, y 1 for its rows, and h = 2 p (1 - p)
(twice, since all classes step at once), the tree learns (y - p) / h under the weight
h, so a leaf's mean is a Newton step. h has a floor, which shortens the steps of rows
the model is sure of. Margins are sums of the trees' steps; probabilities are their softmax.
"""

from __future__ import annotations

import json
import math
from concurrent.futures import ThreadPoolExecutor

from pyspark import keyword_only
from pyspark.ml import Estimator, Model
from pyspark.ml.functions import array_to_vector
from pyspark.ml.linalg import Vectors
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasFeaturesCol, HasLabelCol, HasPredictionCol, HasProbabilityCol, HasWeightCol
from pyspark.ml.regression import GBTRegressionModel, RandomForestRegressor
from pyspark.ml.util import DefaultParamsReader, DefaultParamsWriter, MLReadable, MLReader, MLWritable, MLWriter
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from packetloom.functions.draws import draws
from packetloom.functions.scratch import materialize, spread, spread_rows

_LEAST_CURVE = 0.05


def _softmax(margins: Column) -> Column:
    top = F.array_max(margins)
    powers = F.transform(margins, lambda m: F.exp(m - top))
    total = F.aggregate(powers, F.lit(0.0), lambda a, x: a + x)
    return F.transform(powers, lambda x: x / total)


class _SoftmaxParams(HasFeaturesCol, HasLabelCol, HasPredictionCol, HasProbabilityCol, HasWeightCol):
    trees = Param(Params._dummy(), "trees", "rounds, each one tree a class", TypeConverters.toInt)
    depth = Param(Params._dummy(), "depth", "depth of a tree", TypeConverters.toInt)
    step = Param(Params._dummy(), "step", "share of a Newton step that is taken", TypeConverters.toFloat)
    rows = Param(Params._dummy(), "rows", "share of the rows a tree sees", TypeConverters.toFloat)
    countCol = Param(Params._dummy(), "countCol", "how many equal rows a row stands for", TypeConverters.toString)
    columns = Param(Params._dummy(), "columns", "features tried at a node, as of Spark ML forests", TypeConverters.toString)
    minLeaf = Param(Params._dummy(), "minLeaf", "rows of a leaf at least", TypeConverters.toInt)
    seed = Param(Params._dummy(), "seed", "seed of the samples", TypeConverters.toInt)

    def setFeaturesCol(self, value: str):
        return self._set(featuresCol=value)

    def setLabelCol(self, value: str):
        return self._set(labelCol=value)

    def setWeightCol(self, value: str):
        return self._set(weightCol=value)

    def setCountCol(self, value: str):
        return self._set(countCol=value)


class SoftmaxBoosting(Estimator, _SoftmaxParams):
    """Labels are whole numbers from 0; ``weightCol`` weighs the rows. Fitting one round costs one pass of tree growing a class.

    With ``countCol`` a row stands for so many equal ones, which share its weight: a tree then
    sees the share ``rows`` of these, drawn one by one, and not of the rows that stand for them.
    """

    @keyword_only
    def __init__(self, *, trees: int = 100, depth: int = 6, step: float = 0.1, rows: float = 1.0, columns: str = "all", minLeaf: int = 1, seed: int = 42):
        super().__init__()
        self._setDefault(trees=100, depth=6, step=0.1, rows=1.0, columns="all", minLeaf=1, seed=42, predictionCol="prediction", probabilityCol="probability")
        self._set(**self._input_kwargs)

    def _fit(self, dataset: DataFrame) -> SoftmaxModel:
        get = self.getOrDefault
        weight = F.col(get("weightCol")).cast("double") if self.isDefined("weightCol") else F.lit(1.0)
        rows = dataset.select(F.col(get("featuresCol")).alias("features"), F.col(get("labelCol")).cast("int").alias("y"), weight.alias("w"), *([F.col(get("countCol")).alias("n")] if self._counted() else [])).filter("w > 0")
        counts = {r["y"]: r["w"] for r in rows.groupBy("y").agg(F.sum("w").alias("w")).collect()}
        if not counts or min(counts) < 0:
            raise ValueError("labels are whole numbers from 0, and at least one row is needed")
        classes, total = max(counts) + 1, sum(counts.values())
        # the margins of the shares; a class without a row stays improbable
        prior = [max(counts.get(c, 0.0) / total, 1e-9) for c in range(classes)]
        start = F.array(*[F.log(F.lit(p)) for p in prior])
        state = spread(materialize(self._sampled(rows.withColumn("m", start), classes, 0), "margins"))
        made: list[list] = [[] for _ in range(classes)]
        losses = [self._loss(state, total)]
        with ThreadPoolExecutor(min(classes, 4)) as pool:
            for turn in range(get("trees")):
                grown = list(pool.map(lambda c: self._tree(state, c, turn), range(classes)))
                stepped = state
                for c, tree in enumerate(grown):
                    made[c].append(tree.trees[0])
                    stepped = tree.setPredictionCol(f"t{c}").transform(stepped)
                moved = F.array(*[F.col("m")[c] + F.lit(get("step")) * F.col(f"t{c}") for c in range(classes)])
                moved_rows = stepped.select("features", "y", "w", *(["n"] if self._counted() else []), moved.alias("m"))
                state = materialize(self._sampled(moved_rows, classes, turn + 1), "margins")
                losses.append(self._loss(state, total))
        spark = dataset.sparkSession
        sums = [_sum_of_trees(spark, trees, get("step")) for trees in made]
        return self._copyValues(SoftmaxModel(sums, [math.log(p) for p in prior], losses))

    def _counted(self) -> bool:
        return self.isDefined("countCol") and self.getOrDefault("rows") < 1

    def _sampled(self, state: DataFrame, classes: int, turn: int) -> DataFrame:
        """Adds in ``d`` how many of a counted row's rows each class's tree of the round sees."""
        if not self._counted():
            return state
        numbers = [self.getOrDefault("seed") + 1000 * turn + c for c in range(classes)]
        return state.withColumn("d", draws(F.xxhash64("features", "y", "w"), F.col("n"), numbers, self.getOrDefault("rows"), False))

    def _tree(self, state: DataFrame, c: int, turn: int):
        p = _softmax(F.col("m"))[c]
        curve = F.greatest(2 * p * (1 - p), F.lit(_LEAST_CURVE))
        aim = ((F.col("y") == c).cast("double") - p) / curve
        counted = self._counted()
        seen = F.col("w") * F.col("d")[c] / F.col("n") if counted else F.col("w")
        rows = state.select("features", aim.alias("aim"), (seen * curve).alias("h")).filter("h > 0")
        get = self.getOrDefault
        one = RandomForestRegressor(
            featuresCol="features", labelCol="aim", numTrees=1, maxDepth=get("depth"), minInstancesPerNode=get("minLeaf"), bootstrap=False,
            subsamplingRate=1.0 if counted else get("rows"), featureSubsetStrategy=get("columns"), seed=get("seed") + 1000 * turn + c, maxMemoryInMB=1024,
        )
        return one.setWeightCol("h").fit(spread_rows(rows))

    def _loss(self, state: DataFrame, total: float) -> float:
        p = F.get(_softmax(F.col("m")), F.col("y"))
        return state.agg(F.sum(-F.log(F.greatest(p, F.lit(1e-300))) * F.col("w"))).first()[0] / total


def _sum_of_trees(spark: SparkSession, trees: list, step: float) -> GBTRegressionModel:
    """The trees as one ensemble model of Spark ML, which is scored in one pass and can be saved."""
    jvm, gateway = spark._jvm, spark.sparkContext._gateway
    kind = jvm.org.apache.spark.ml.regression.DecisionTreeRegressionModel
    array = gateway.new_array(kind, len(trees))
    weights = gateway.new_array(jvm.double, len(trees))
    for i, tree in enumerate(trees):
        array[i], weights[i] = tree._java_obj, step
    uid = f"sum_of_trees_{abs(hash(tuple(t.uid for t in trees))):x}"
    return GBTRegressionModel(jvm.org.apache.spark.ml.regression.GBTRegressionModel(uid, array, weights))


class SoftmaxModel(Model, _SoftmaxParams, MLWritable, MLReadable):
    """One ensemble a class. ``losses``: mean log loss of the train rows before the first round and after each."""

    def __init__(self, sums: list[GBTRegressionModel] | None = None, base: list[float] | None = None, losses: list[float] | None = None):
        super().__init__()
        self._setDefault(predictionCol="prediction", probabilityCol="probability")
        self.sums, self.base, self.losses = sums or [], base or [], losses or []

    @property
    def featureImportances(self):
        """Mean of the classes' importances, summing to 1."""
        total = sum(s.featureImportances.toArray() for s in self.sums)
        return Vectors.dense(total / total.sum() if total.sum() else total)

    def _transform(self, dataset: DataFrame) -> DataFrame:
        out, names = dataset, []
        for c, model in enumerate(self.sums):
            names.append(f"{self.uid}_{c}")
            out = model.setFeaturesCol(self.getOrDefault("featuresCol")).setPredictionCol(names[-1]).transform(out)
        p = f"{self.uid}_p"
        out = out.withColumn(p, _softmax(F.array(*[F.col(n) + F.lit(b) for n, b in zip(names, self.base)])))
        # of equal probabilities the smaller class
        best = (F.array_position(p, F.array_max(p)) - 1).cast("double")
        out = out.withColumns({self.getOrDefault("probabilityCol"): array_to_vector(p), self.getOrDefault("predictionCol"): best})
        return out.drop(p, *names)

    def write(self) -> MLWriter:
        return _SoftmaxWriter(self)

    @classmethod
    def read(cls) -> MLReader:
        return _SoftmaxReader(cls)


class _SoftmaxWriter(MLWriter):
    def __init__(self, model: SoftmaxModel):
        super().__init__()
        self.model = model

    def saveImpl(self, path: str) -> None:
        extra = {"base": self.model.base, "losses": self.model.losses}
        DefaultParamsWriter.saveMetadata(self.model, path, self.sparkSession, extraMetadata={"softmax": json.dumps(extra)})
        for c, model in enumerate(self.model.sums):
            model.write().overwrite().save(f"{path}/class_{c}")


class _SoftmaxReader(MLReader):
    def __init__(self, cls):
        super().__init__()
        self.cls = cls

    def load(self, path: str) -> SoftmaxModel:
        meta = DefaultParamsReader.loadMetadata(path, self.sparkSession)
        extra = json.loads(meta["softmax"])
        sums = [GBTRegressionModel.load(f"{path}/class_{c}") for c in range(len(extra["base"]))]
        model = SoftmaxModel(sums, extra["base"], extra["losses"])
        model._resetUid(meta["uid"])
        DefaultParamsReader.getAndSetParams(model, meta)
        return model

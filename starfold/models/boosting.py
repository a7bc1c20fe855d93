"""Boosted binary classifiers on pyspark.ml."""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass, replace

from pyspark import SparkContext
from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from starfold.models.evaluate import areas_under_roc
from starfold.session import materialize, shared_dir


FIRST_ROUNDS = 64


@dataclass(frozen=True)
class BoostSettings:
    """Training settings.

    ``leaves`` sets the depth when ``depth`` is not given: trees here grow level by level, so a
    tree of 128 leaves is one of depth 7. ``patience`` is the number of rounds without a better
    validation metric after which training ends. With ``tolerance`` it ends as soon as a round
    improves the validation loss by no more than that share. ``max_bins`` is how many split
    candidates a feature has.
    """

    rounds: int = 100
    learning_rate: float = 0.1
    depth: int | None = None
    leaves: int | None = None
    feature_share: float = 1.0
    row_share: float = 1.0
    min_leaf_rows: int = 1
    min_split_gain: float = 0.0
    patience: int = 50
    tolerance: float | None = None
    max_bins: int = 32
    seed: int = 2017

    def tree_depth(self) -> int:
        if self.depth is not None:
            return self.depth
        return math.ceil(math.log2(self.leaves)) if self.leaves else 5

    def with_(self, **changes) -> BoostSettings:
        return replace(self, **changes)

    def estimator(self, features: str, label: str) -> GBTClassifier:
        share = "all" if self.feature_share >= 1.0 else str(self.feature_share)
        return GBTClassifier(
            featuresCol=features,
            labelCol=label,
            maxIter=self.rounds,
            stepSize=self.learning_rate,
            maxDepth=self.tree_depth(),
            featureSubsetStrategy=share,
            subsamplingRate=self.row_share,
            minInstancesPerNode=self.min_leaf_rows,
            minInfoGain=self.min_split_gain,
            maxBins=self.max_bins,
            seed=self.seed,
        )


def rows_for_weight(weight: float) -> int:
    """The fewest rows whose second derivatives of the log loss, at most 1/4 each, reach a weight."""
    return math.ceil(4 * weight)


# The training settings of the four scoring runs. The depth-six runs also ask for a
# minimum split gain of 0.2 in total loss; per row, as measured here, that is 0.2 / n, hence 0.
MANY_LEAVES = BoostSettings(
    rounds=1000, learning_rate=0.05, leaves=128, feature_share=0.9, row_share=0.8, max_bins=255
)
FEW_LEAVES = BoostSettings(
    rounds=1000, learning_rate=0.05, leaves=10, feature_share=0.6, row_share=0.8, min_leaf_rows=150,
    max_bins=255,
)
DEPTH_SIX = BoostSettings(
    rounds=800, learning_rate=0.03, depth=6, feature_share=0.4, row_share=0.6,
    min_leaf_rows=rows_for_weight(10), max_bins=256,
)
DEPTH_SIX_STACKED = BoostSettings(
    rounds=800, learning_rate=0.05, depth=6, feature_share=0.8, row_share=0.6,
    min_leaf_rows=rows_for_weight(12), max_bins=256,
)


def feature_vector(df: DataFrame, columns: Sequence[str], out: str = "features") -> DataFrame:
    """The ordered feature columns as one vector; key and label stay beside it."""
    assembler = VectorAssembler(inputCols=list(columns), outputCol=out, handleInvalid="error")
    return assembler.transform(df)


def positive_probability(column: str = "probability") -> Column:
    return vector_to_array(F.col(column))[1]


def best_round(history: Sequence[float], patience: int, larger_is_better: bool) -> int:
    """The 1-based round a patient watcher keeps.

    Rounds are read in order; reading stops once ``patience`` rounds have passed without a
    strictly better value, and the best round read so far is the answer.
    """
    best, best_at = None, 0
    for at, value in enumerate(history, start=1):
        better = best is None or (value > best if larger_is_better else value < best)
        if better:
            best, best_at = value, at
        elif at - best_at >= patience:
            break
    return best_at


def prefix_model(model: GBTClassificationModel, rounds: int) -> GBTClassificationModel:
    """The same model cut to its first trees. Boosting is sequential, so it equals a shorter fit."""
    if rounds >= model.getNumTrees:
        return model
    java = model._java_obj
    context = SparkContext.getOrCreate()
    jvm, gateway = context._jvm, context._gateway
    tree_class = jvm.org.apache.spark.ml.regression.DecisionTreeRegressionModel
    trees = gateway.new_array(tree_class, rounds)
    weights = gateway.new_array(jvm.double, rounds)
    for i, tree in enumerate(java.trees()[:rounds]):
        trees[i] = tree
        weights[i] = float(java.treeWeights()[i])
    cut = jvm.org.apache.spark.ml.classification.GBTClassificationModel(
        java.uid(), trees, weights, java.numFeatures(), 2
    )
    shorter = GBTClassificationModel(java.copyValues(cut, java.extractParamMap()))
    return shorter.setFeaturesCol(model.getFeaturesCol())


def round_metrics(
    model: GBTClassificationModel,
    df: DataFrame,
    label: str,
    metric: str = "logLoss",
    patience: int | None = None,
    chunk: int = 25,
) -> list[float]:
    """The metric after each boosting round, measured on ``df``.

    logLoss covers all rounds. areaUnderROC runs every tree over the rows once, a chunk of trees
    at a time, keeping the running margin as a table column, and takes one pass for the areas of a
    chunk; a chunk is written only when others follow it, with the features they need. With
    ``patience`` it ends after the chunk in which that many rounds brought no better value.
    """
    if metric == "logLoss":
        return list(model.evaluateEachIteration(df))
    if metric != "areaUnderROC":
        raise ValueError(f"unknown metric {metric!r}")
    features = model.getFeaturesCol()
    rows = df.select(label, features, F.lit(0.0).alias("margin_0"))
    trees, weights, out = model.trees, model.treeWeights, []
    for start in range(0, len(trees), chunk):
        at = range(start, min(start + chunk, len(trees)))
        margin = F.col(f"margin_{start}")
        names = []
        for i in at:
            tree = trees[i].setFeaturesCol(features).setPredictionCol(f"_tree_{i}")
            rows = tree.transform(rows)
            margin = margin + F.col(f"_tree_{i}") * F.lit(float(weights[i]))
            names.append(margin.alias(f"margin_{i + 1}"))
        rows = rows.select(label, features, *names)
        if at[-1] + 1 < len(trees):
            rows = materialize(rows, "margins")
        out += areas_under_roc(rows, label, [f"margin_{i + 1}" for i in at])
        rows = rows.select(label, features, f"margin_{at[-1] + 1}")
        if patience is not None and len(out) - best_round(out, patience, True) >= patience:
            break
    return out


class BoostedClassifier:
    """Fit and score one boosted model over a frame holding key, label and a feature vector."""

    def __init__(
        self, settings: BoostSettings, label: str = "TARGET", features: str = "features",
        metric: str = "logLoss",
    ):
        self.settings = settings
        self.label = label
        self.features = features
        self.metric = metric
        self.history: list[float] = []
        self.train_history: list[float] = []
        self.trained_rounds = 0
        self._model: GBTClassificationModel | None = None

    def fit(self, train: DataFrame, valid: DataFrame | None = None) -> BoostedClassifier:
        """Train on ``train``; with ``valid``, stop by its metric and keep the rounds up to the best.

        Training starts with ``FIRST_ROUNDS`` rounds and doubles them until the patience is used up.
        For a fixed seed a longer fit begins with the rounds of a shorter one, so each fit replaces
        the one before, and all of them together train fewer than four times the rounds needed.
        """
        context = train.sparkSession.sparkContext
        if context.getCheckpointDir() is None:
            context.setCheckpointDir(shared_dir(train.sparkSession))
        columns = [self.features, F.col(self.label).cast("double").alias(self.label)]
        rows = train.select(*columns)
        held = None if valid is None else valid.select(*columns)
        if held is None:
            self._model = self._train(rows, self.settings.rounds)
        elif self.settings.tolerance is not None:
            marked = rows.withColumn("_valid", F.lit(False)).unionByName(held.withColumn("_valid", F.lit(True)))
            self._model = self._train(marked, self.settings.rounds, self.settings.tolerance)
            self.history = round_metrics(self._model, held, self.label, self.metric)
        else:
            self._model = self._train_patiently(rows, held)
        if held is not None:
            self.train_history = round_metrics(self._model, rows, self.label, self.metric)
        return self

    def _train(self, rows: DataFrame, rounds: int, tolerance: float | None = None) -> GBTClassificationModel:
        estimator = self.settings.with_(rounds=rounds).estimator(self.features, self.label)
        if tolerance is not None:
            estimator.setParams(validationIndicatorCol="_valid", validationTol=tolerance)
        model = estimator.fit(rows)
        self.trained_rounds = model.getNumTrees
        return model

    def _train_patiently(self, rows: DataFrame, held: DataFrame) -> GBTClassificationModel:
        patience, most = self.settings.patience, self.settings.rounds
        larger = self.metric != "logLoss"
        rounds = min(FIRST_ROUNDS, most)
        while True:
            model = self._train(rows, rounds)
            history = round_metrics(model, held, self.label, self.metric, patience)
            keep = best_round(history, patience, larger)
            if rounds == most or len(history) - keep >= patience:
                self.history = history
                return prefix_model(model, keep)
            rounds = min(2 * rounds, most)

    def predict(self, df: DataFrame, out: str = "score") -> DataFrame:
        """Add the probability of the positive class."""
        made = ["rawPrediction", "probability", "prediction"]
        scored = self.get_model().transform(df)
        return scored.withColumn(out, positive_probability()).drop(*made)

    def get_model(self) -> GBTClassificationModel:
        if self._model is None:
            raise ValueError("fit first")
        return self._model

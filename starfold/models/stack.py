"""Two-level stacking: out-of-fold scores of base models feed a blending model."""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce
from multiprocessing.pool import ThreadPool

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from starfold.models.boosting import BoostedClassifier, BoostSettings, feature_vector
from starfold.operators.split import exact_split
from starfold.session import materialize


# Fits that run side by side: each level of a tree is a short job, so one fit alone leaves cores idle.
PARALLELISM = 4
# Rows a task of a fit reads at least. A level of a tree takes such a task a few milliseconds, so that
# starting more tasks for them would cost more than it saves.
TASK_ROWS = 20_000


def _few_tasks(df: DataFrame, rows: int) -> DataFrame:
    """The same rows in no more partitions than they need; larger tables keep theirs."""
    return df.coalesce(max(1, math.ceil(rows / TASK_ROWS)))


def out_of_fold(
    train: DataFrame,
    settings: Sequence[BoostSettings],
    folds: int,
    label: str = "TARGET",
    fold: str = "fold",
    parallelism: int = PARALLELISM,
    metric: str = "logLoss",
) -> tuple[DataFrame, list[list[BoostedClassifier]]]:
    """Score every training row by models that did not see its fold.

    ``train`` must be materialised and carry the fold number; written by fold, every fit and every
    scoring pass reads only its own folds. Few rows are fitted in few tasks. Returns the rows with one
    score column per base model, and the fitted models as [base model][fold]. Each row is scored once
    per base model, without a shuffle.
    """
    sizes = {row[fold]: row["count"] for row in train.groupBy(fold).count().collect()}
    total = sum(sizes.values())

    def fit(job: tuple[int, int]) -> BoostedClassifier:
        which, i = job
        size = sizes.get(i, 0)
        rest = _few_tasks(train.where(F.col(fold) != i), total - size)
        held = _few_tasks(train.where(F.col(fold) == i), size)
        return BoostedClassifier(settings[which], label, metric=metric).fit(rest, held)

    jobs = [(m, i) for m in range(len(settings)) for i in range(folds)]
    with ThreadPool(parallelism) as pool:
        fitted = pool.map(fit, jobs, chunksize=1)
    models = [fitted[m * folds : (m + 1) * folds] for m in range(len(settings))]

    def score_fold(i: int) -> DataFrame:
        held = train.where(F.col(fold) == i)
        return reduce(lambda df, m: models[m][i].predict(df, f"score_{m}"), range(len(settings)), held)

    return reduce(DataFrame.unionByName, [score_fold(i) for i in range(folds)]), models


def fold_mean(df: DataFrame, models: list[list[BoostedClassifier]]) -> DataFrame:
    """Score unseen rows by each base model as the mean over its fold models.

    The fold scores are columns of the same row, so the mean needs no grouping.
    """
    for m, fitted in enumerate(models):
        names = [f"_fold_{m}_{i}" for i in range(len(fitted))]
        for name, model in zip(names, fitted):
            df = model.predict(df, name)
        total = reduce(lambda a, b: a + b, [F.col(n) for n in names])
        df = df.withColumn(f"score_{m}", total / F.lit(float(len(names)))).drop(*names)
    return df


def blend_frames(scored: DataFrame, count: int, out: str = "blend_features") -> DataFrame:
    return feature_vector(scored, [f"score_{m}" for m in range(count)], out)


class Stack:
    """Base models, fold scores and the blender in one object."""

    def __init__(
        self,
        base: Sequence[BoostSettings],
        blender: BoostSettings,
        folds: int = 8,
        key: str = "EID",
        label: str = "TARGET",
        blend_share: float = 0.3,
        blend_seed: int = 10000,
        parallelism: int = PARALLELISM,
        metric: str = "logLoss",
    ):
        self.base, self.blender, self.folds = list(base), blender, folds
        self.key, self.label = key, label
        self.blend_share, self.blend_seed = blend_share, blend_seed
        self.parallelism, self.metric = parallelism, metric

    def fit(self, train: DataFrame) -> Stack:
        """``train`` holds key, label, features and fold."""
        scores, self.models = out_of_fold(
            train, self.base, self.folds, self.label, parallelism=self.parallelism,
            metric=self.metric,
        )
        names = [f"score_{m}" for m in range(len(self.base))]
        self.oof = materialize(scores.select(self.key, self.label, "fold", *names), "oof")
        split = exact_split(self.oof, self.key, self.blend_share, self.blend_seed)
        blend = materialize(blend_frames(split, len(self.base)), "blend")
        blend = _few_tasks(blend, blend.count())
        blender = BoostedClassifier(self.blender, self.label, "blend_features", self.metric)
        self.blend_model = blender.fit(blend.where("is_valid = 0"), blend.where("is_valid = 1"))
        return self

    def predict(self, df: DataFrame, out: str = "score") -> DataFrame:
        scored = blend_frames(fold_mean(df, self.models), len(self.base))
        return self.blend_model.predict(scored, out).drop("blend_features")

"""The four scoring runs from raw tables to the submission."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from starfold.models import (
    DEPTH_SIX,
    DEPTH_SIX_STACKED,
    FEW_LEAVES,
    MANY_LEAVES,
    BoostedClassifier,
    BoostedModel,
    BoostSettings,
    Stack,
    StackedModel,
    split_importance,
    submission,
)
from starfold.operators import exact_folds, exact_split, stack_rows, stratified_holdout
from starfold.plans.company import (
    BASE,
    CARRY,
    KEY,
    STACKED,
    WIDE,
    Recipe,
)
from starfold.plans.fitted import FittedRecipe, fit_recipe
from starfold.session import materialize
from starfold.sources import read_star, write_feature_map, write_importance, write_scored


@dataclass(frozen=True)
class Run:
    """Features, models, split and threshold of one scoring run.

    With ``folds`` the models are stacked and blended; with ``share`` that part of the rows is
    held out; otherwise ``strata`` gives the held-out part per label.
    """

    recipe: Recipe
    models: tuple[BoostSettings, ...]
    threshold: float
    seed: int
    strata: Mapping[int, float] = field(default_factory=lambda: {1: 0.3, 0: 0.1})
    share: float | None = None
    folds: int | None = None

    def sized(self, rounds: int, depth: int | None = None, folds: int | None = None) -> Run:
        """The same run with fewer rounds, smaller trees or fewer folds."""
        models = tuple(
            m.with_(rounds=rounds, depth=depth or m.depth, min_leaf_rows=1 if depth else m.min_leaf_rows)
            for m in self.models
        )
        return replace(self, models=models, folds=folds if folds and self.folds else self.folds)


# Split seeds and decision thresholds of the four scoring runs.
RUNS = {
    "base": Run(BASE, (MANY_LEAVES,), 0.222, seed=70),
    "carry": Run(CARRY, (FEW_LEAVES,), 0.222, seed=40),
    "wide": Run(WIDE, (DEPTH_SIX,), 0.271, seed=10000, share=0.3),
    "stacked": Run(STACKED, (MANY_LEAVES, DEPTH_SIX_STACKED), 0.34, seed=2017, folds=8),
}


@dataclass
class KeptRun:
    """What later companies are scored with: the learned recipe, its feature list, the model, the threshold."""

    recipe: FittedRecipe
    features: DataFrame
    model: BoostedModel | StackedModel
    threshold: float

    def save(self, path: str) -> None:
        """One folder for everything; an earlier run in it is replaced."""
        spark = self.features.sparkSession
        kind = "stack" if isinstance(self.model, StackedModel) else "single"
        self.recipe.save(f"{path}/recipe")
        self.features.write.mode("overwrite").parquet(f"{path}/features")
        self.model.write().overwrite().save(f"{path}/model")
        about = spark.createDataFrame([(kind, self.threshold)], "kind string, threshold double")
        about.write.mode("overwrite").parquet(f"{path}/run")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> KeptRun:
        about = spark.read.parquet(f"{path}/run").first()
        model = StackedModel if about.kind == "stack" else BoostedModel
        features = spark.read.parquet(f"{path}/features")
        return cls(FittedRecipe.load(spark, f"{path}/recipe"), features, model.load(f"{path}/model"), about.threshold)

    def score(self, tables: Mapping[str, DataFrame]) -> DataFrame:
        """The submission of the companies of ``tables["spine"]``; with a ``split`` those of the test list.

        Tables that lack a column the model was trained on, or bring another one, raise.
        """
        rows, features = self.recipe.vectors(tables)
        changed = features.exceptAll(self.features).unionByName(self.features.exceptAll(features))
        if not changed.isEmpty():
            raise ValueError(f"other features than at training time: {[r.feature for r in changed.limit(10).collect()]}")
        if "split" in rows.columns:
            rows = rows.where("split = 'test'")
        return submission(self.model.transform(rows), self.threshold)


@dataclass
class Outcome:
    """What a run leaves behind. ``importance`` and ``history`` need a single model.

    ``unreadable`` counts training rows whose target could not be read; they are neither trained on
    nor scored. ``kept`` scores later companies and can be saved.
    """

    submission: DataFrame
    features: DataFrame
    importance: DataFrame | None = None
    history: list[float] | None = None
    unreadable: int = 0
    kept: KeptRun | None = None


def spine_of(train: DataFrame, test: DataFrame) -> DataFrame:
    """Both company lists as one spine, each row marked with the list it comes from."""
    known = train.select(KEY, "TARGET", F.lit("train").alias("split"))
    return stack_rows(known, test.select(KEY, F.lit("test").alias("split")))


def score_companies(
    tables: Mapping[str, DataFrame], run: Run, metric: str = "areaUnderROC"
) -> Outcome:
    """Build the features once, train, and score the companies of the test list.

    Categories of any width are the sparse end of the feature vectors. A spine without ``split`` is
    scored where the target is NULL.
    """
    recipe = fit_recipe(tables, run.recipe)
    rows, names = recipe.vectors(tables)
    if "split" not in rows.columns:
        rows = rows.withColumn("split", F.when(F.col("TARGET").isNull(), "test").otherwise("train"))
    listed, unknown = rows.where("split = 'train'"), rows.where("split = 'test'")
    known = listed.where(F.col("TARGET").isNotNull())
    unreadable = listed.where(F.col("TARGET").isNull()).count()
    listing = names.orderBy("index")
    if run.folds:
        train = materialize(exact_folds(known, KEY, run.folds, run.seed), "folds", "fold")
        stack = Stack(run.models, run.models[0], run.folds, metric=metric).fit(train)
        kept = KeptRun(recipe, names, StackedModel(stack), run.threshold)
        return Outcome(submission(stack.predict(unknown), run.threshold), listing, unreadable=unreadable, kept=kept)
    if run.share is not None:
        split = exact_split(known, KEY, run.share, run.seed)
    else:
        split = stratified_holdout(known, KEY, "TARGET", dict(run.strata), run.seed)
    split = materialize(split, "split")
    model = BoostedClassifier(run.models[0], metric=metric).fit(
        split.where("is_valid = 0"), split.where("is_valid = 1")
    )
    return Outcome(
        submission(model.predict(unknown), run.threshold),
        listing,
        split_importance(model.get_model(), names),
        model.history,
        unreadable,
        KeptRun(recipe, names, BoostedModel(model), run.threshold),
    )


def run_files(spark: SparkSession, inputs: str, outputs: str, run: Run) -> Outcome:
    """Read the CSV files of a folder, run, and write the submission, the feature tables and the kept run."""
    star = read_star(spark, inputs)
    tables = star | {"spine": spine_of(star["train"], star["test"])}
    outcome = score_companies(tables, run)
    write_scored(outcome.submission, f"{outputs}/evaluation_public")
    write_feature_map(outcome.features, f"{outputs}/feature_map")
    if outcome.importance is not None:
        write_importance(outcome.importance, f"{outputs}/feature_importance")
    outcome.kept.save(f"{outputs}/kept_run")
    return outcome

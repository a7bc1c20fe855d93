"""The boosted model and the stack as ``pyspark.ml`` estimators whose models can be kept and reloaded.

Both fit into a ``Pipeline``. A saved model is a folder: metadata with the settings and the history, and
one folder per fitted booster (for a stack each fold of each base model, and the blender).
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import asdict

from pyspark import keyword_only
from pyspark.ml import Estimator, Model
from pyspark.ml.classification import GBTClassificationModel
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasFeaturesCol, HasLabelCol
from pyspark.ml.util import DefaultParamsReader, DefaultParamsWriter, MLReadable, MLReader, MLWritable, MLWriter
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from starfold.models.boosting import BoostedClassifier, BoostSettings
from starfold.models.stack import Stack


class _Columns(HasFeaturesCol, HasLabelCol):
    """Columns and metric of estimators and models."""

    scoreCol = Param(Params._dummy(), "scoreCol", "column of the positive probability", TypeConverters.toString)
    metric = Param(Params._dummy(), "metric", "logLoss or areaUnderROC", TypeConverters.toString)

    def __init__(self):
        super().__init__()
        self._setDefault(featuresCol="features", labelCol="TARGET", scoreCol="score", metric="logLoss")


class _Writer(MLWriter):
    """Metadata of the stage, then every booster it holds under its own name."""

    def __init__(self, stage):
        super().__init__()
        self.stage = stage

    def saveImpl(self, path: str) -> None:
        DefaultParamsWriter.saveMetadata(self.stage, path, self.sc, extraMetadata=self.stage._kept())
        for name, fitted in self.stage._boosters().items():
            writer = fitted.get_model().write()
            (writer.overwrite() if self.shouldOverwrite else writer).save(f"{path}/{name}")


class _Reader(MLReader):
    def __init__(self, kind):
        super().__init__()
        self.kind = kind

    def load(self, path: str):
        metadata = DefaultParamsReader.loadMetadata(path, self.sc)
        stage = self.kind._restored(metadata, lambda name: GBTClassificationModel.load(f"{path}/{name}"))
        DefaultParamsReader.getAndSetParams(stage, metadata)
        stage._resetUid(metadata["uid"])
        return stage


class _Kept(MLReadable, MLWritable):
    def write(self) -> MLWriter:
        return _Writer(self)

    @classmethod
    def read(cls) -> MLReader:
        return _Reader(cls)


def _history(fitted: BoostedClassifier) -> dict:
    names = ("history", "train_history", "trained_rounds", "label", "features", "metric")
    return {"settings": asdict(fitted.settings)} | {n: getattr(fitted, n) for n in names}


def _booster(kept: dict, model: GBTClassificationModel) -> BoostedClassifier:
    out = BoostedClassifier(BoostSettings(**kept["settings"]), kept["label"], kept["features"], kept["metric"])
    out.history, out.train_history = list(kept["history"]), list(kept["train_history"])
    out.trained_rounds = kept["trained_rounds"]
    out._model = model
    return out


class Boosted(Estimator, _Columns):
    """Fits one boosted model. With ``validCol`` the rows where it is 1 are held out and stop training."""

    validCol = Param(Params._dummy(), "validCol", "0/1 column of the held-out rows", TypeConverters.toString)

    @keyword_only
    def __init__(self, *, settings: BoostSettings | None = None, featuresCol="features", labelCol="TARGET",
                 scoreCol="score", metric="logLoss", validCol=None):
        super().__init__()
        given = {k: v for k, v in self._input_kwargs.items() if v is not None}
        self.settings = given.pop("settings", BoostSettings())
        self._set(**given)

    def _fit(self, dataset: DataFrame) -> BoostedModel:
        fitted = BoostedClassifier(self.settings, self.getLabelCol(), self.getFeaturesCol(), self.getOrDefault("metric"))
        if self.isSet("validCol"):
            held = F.col(self.getOrDefault("validCol")) == 1
            fitted.fit(dataset.where(~held), dataset.where(held))
        else:
            fitted.fit(dataset)
        return self._copyValues(BoostedModel(fitted))


class BoostedModel(Model, _Columns, _Kept):
    """Adds the positive probability; ``fitted`` has the booster, its settings and its history."""

    validCol = Boosted.validCol

    def __init__(self, fitted: BoostedClassifier | None = None):
        super().__init__()
        self.fitted = fitted

    def _transform(self, dataset: DataFrame) -> DataFrame:
        return self.fitted.predict(dataset, self.getOrDefault("scoreCol"))

    def _kept(self) -> dict:
        return {"booster": _history(self.fitted)}

    def _boosters(self) -> dict[str, BoostedClassifier]:
        return {"booster": self.fitted}

    @classmethod
    def _restored(cls, metadata, load) -> BoostedModel:
        return cls(_booster(metadata["booster"], load("booster")))


class Stacked(Estimator, _Columns):
    """Fits base models fold by fold and the blender. The rows carry key, label, features and fold."""

    keyCol = Param(Params._dummy(), "keyCol", "column of the entity key", TypeConverters.toString)

    @keyword_only
    def __init__(self, *, base: Sequence[BoostSettings] = (), blender: BoostSettings | None = None, folds: int = 8,
                 keyCol="EID", labelCol="TARGET", scoreCol="score", metric="logLoss", parallelism: int = 2):
        super().__init__()
        given = dict(self._input_kwargs)
        self.base = list(given.pop("base", ()))
        self.blender, self.folds = given.pop("blender", None), given.pop("folds", 8)
        self.parallelism = given.pop("parallelism", 2)
        self._setDefault(keyCol="EID")
        self._set(**given)

    def _fit(self, dataset: DataFrame) -> StackedModel:
        stack = Stack(
            self.base, self.blender or self.base[0], self.folds, self.getOrDefault("keyCol"), self.getLabelCol(),
            parallelism=self.parallelism, metric=self.getOrDefault("metric"),
        )
        return self._copyValues(StackedModel(stack.fit(dataset)))


class StackedModel(Model, _Columns, _Kept):
    """Adds the blended probability; ``stack`` has the fold models and the blender."""

    keyCol = Stacked.keyCol

    def __init__(self, stack: Stack | None = None):
        super().__init__()
        self._setDefault(keyCol="EID")
        self.stack = stack

    def _transform(self, dataset: DataFrame) -> DataFrame:
        return self.stack.predict(dataset, self.getOrDefault("scoreCol"))

    def _kept(self) -> dict:
        s = self.stack
        numbers = {"folds": s.folds, "key": s.key, "label": s.label, "metric": s.metric}
        models = {name: _history(fitted) for name, fitted in self._boosters().items()}
        blend = {"blend_share": s.blend_share, "blend_seed": s.blend_seed}
        return {"stack": numbers | blend, "bases": [asdict(b) for b in s.base], "models": models}

    def _boosters(self) -> dict[str, BoostedClassifier]:
        fitted = {f"base-{m}-fold-{i}": f for m, row in enumerate(self.stack.models) for i, f in enumerate(row)}
        return fitted | {"blender": self.stack.blend_model}

    @classmethod
    def _restored(cls, metadata, load) -> StackedModel:
        kept, numbers = metadata["models"], metadata["stack"]
        bases = [BoostSettings(**b) for b in metadata["bases"]]
        stack = Stack(bases, BoostSettings(**kept["blender"]["settings"]), **numbers)
        stack.models = [
            [_booster(kept[n], load(n)) for n in (f"base-{m}-fold-{i}" for i in range(stack.folds))]
            for m in range(len(bases))
        ]
        stack.blend_model = _booster(kept["blender"], load("blender"))
        return cls(stack)

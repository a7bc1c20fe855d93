"""Feature blocks from stored partial aggregates: a new slice does not read history again.

A slice (a day, a file, a batch) is aggregated once into one row per entity of what its features need. The
features of all slices are the merge of these rows. Replacing a slice replaces its rows; slices can be
compacted into one base, so the number of rows stays near the number of entities.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from starfold.functions.states import Mergeable
from starfold.operators.blocks import finish
from starfold.session import materialize
from starfold.sources.versions import Versions, last_number

BASE = "base"
NUMBER = "_slice"


@dataclass(frozen=True)
class StateBlock:
    """A feature block whose features are ``Mergeable``; the other fields are those of ``FeatureBlock``."""

    name: str
    features: Mapping[str, Mergeable]
    key: str = "EID"
    derived: Mapping[str, Column] = field(default_factory=dict)
    scaled: Mapping[str, str] = field(default_factory=dict)
    tops: Mapping[str, float | None] = field(default_factory=dict)
    drop: tuple[str, ...] = ()
    fill: float | None = None

    def _part(self, feature: str):
        return lambda part: F.col(f"`{feature}.{part}`")

    def states(self, rows: DataFrame, *by: str) -> DataFrame:
        """One row per key of a slice, or of every slice that ``by`` tells, with the stored parts of every feature."""
        parts = [c.alias(f"{n}.{p}") for n, m in self.features.items() for p, c in m.parts.items()]
        return rows.where(F.col(self.key).isNotNull()).groupBy(self.key, *by).agg(*parts)

    def merge(self, states: DataFrame) -> DataFrame:
        """States of several slices as the states of all of them; merging may be repeated."""
        parts = [
            c(self._part(n)).alias(f"{n}.{p}") for n, m in self.features.items() for p, c in m.merge.items()
        ]
        return states.groupBy(self.key).agg(*parts)

    def finish(self, merged: DataFrame) -> DataFrame:
        """Merged states as features."""
        return finish(merged.select(self.key, *[m.value(self._part(n)).alias(n) for n, m in self.features.items()]), self)


class StateStore:
    """The states of a block's slices in one folder; each change is one commit.

    ``put`` may be repeated for a slice: the last rows count. ``compact`` merges what is there into a base;
    a slice in the base can no longer be replaced. A failed or interrupted change leaves the store as it was.
    """

    def __init__(self, spark: SparkSession, folder: str, block: StateBlock):
        self.spark, self.block = spark, block
        self.versions = Versions(spark, folder)

    def _content(self) -> tuple[dict, int]:
        content = self.versions.read() or {"parts": {}, "based": []}
        return content, last_number(self.versions)

    def slices(self) -> list[str]:
        """All slices held, those in the base included."""
        content, _ = self._content()
        return sorted([s for s in content["parts"] if s != BASE] + content["based"])

    def put(self, name: str, rows: DataFrame) -> None:
        """Aggregate the rows of one slice and store its states; only these rows are read."""
        self._store(name, self.block.states(rows))

    def put_slices(self, names: Sequence[str], rows: DataFrame, number: Column) -> None:
        """``put`` for every slice of ``rows``, told apart by ``number`` (place in ``names``): read and aggregated once."""
        states = materialize(self.block.states(rows.withColumn(NUMBER, number), NUMBER), "slices", NUMBER)
        for i, name in enumerate(names):
            self._store(name, states.where(F.col(NUMBER) == i).drop(NUMBER))

    def _store(self, name: str, states: DataFrame) -> None:
        content, after = self._content()
        if name in content["based"] or name == BASE:
            raise ValueError(f"slice {name} is part of the base")
        folder = self.versions.fresh(f"slice-{name}")
        states.write.parquet(f"{self.versions.folder}/{folder}")
        self.versions.commit({"parts": content["parts"] | {name: folder}, "based": content["based"]}, after)

    def _read(self, parts: Mapping[str, str]) -> DataFrame:
        frames = [self.spark.read.parquet(f"{self.versions.folder}/{p}") for p in parts.values()]
        return reduce(DataFrame.unionByName, frames)

    def merged(self) -> DataFrame:
        """The states of all slices together."""
        content, _ = self._content()
        if not content["parts"]:
            raise ValueError("no slice was put")
        return self.block.merge(self._read(content["parts"]))

    def features(self) -> DataFrame:
        """The block over all slices; only stored states are read."""
        return self.block.finish(self.merged())

    def drop_unused(self) -> None:
        """Delete what no version but the last two needs; call it when no reader is left on older ones."""
        self.versions.drop_unused()

    def compact(self) -> None:
        """Replace all slices by one base of their merged states."""
        content, after = self._content()
        folder = self.versions.fresh(BASE)
        self.block.merge(self._read(content["parts"])).write.parquet(f"{self.versions.folder}/{folder}")
        based = sorted(content["based"] + [s for s in content["parts"] if s != BASE])
        self.versions.commit({"parts": {BASE: folder}, "based": based}, after)

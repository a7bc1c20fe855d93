"""Feature blocks: all features of one child table from one grouped aggregation."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from starfold.functions.nulls import fill_numeric
from starfold.session import materialize


@dataclass(frozen=True)
class FeatureBlock:
    """One row per key with every declared feature.

    ``features`` are aggregate expressions over ``source``. ``derived`` are expressions over the
    aggregated features. ``fill`` replaces the NULLs of numeric features. ``tops`` are largest group
    values learned before, by the name of the scaled feature; the others are taken from this block.
    """

    name: str
    source: DataFrame
    features: Mapping[str, Column]
    key: str = "EID"
    derived: Mapping[str, Column] = field(default_factory=dict)
    scaled: Mapping[str, str] = field(default_factory=dict)
    tops: Mapping[str, float | None] = field(default_factory=dict)
    drop: tuple[str, ...] = ()
    fill: float | None = None

    def build(self) -> DataFrame:
        rows = self.source.where(F.col(self.key).isNotNull())
        out = rows.groupBy(self.key).agg(*[c.alias(n) for n, c in self.features.items()])
        return finish(out, self)


def finish(out: DataFrame, block) -> DataFrame:
    """Scaled and derived features, dropped helpers and fills over the aggregated features of a block."""
    if block.scaled:
        out = _with_scaled(out, block.scaled, block.tops)
    if block.derived:
        out = out.withColumns(dict(block.derived))
    if block.drop:
        out = out.drop(*block.drop)
    return out if block.fill is None else fill_numeric(out, block.fill, skip=[block.key])


def _with_scaled(out: DataFrame, scaled: Mapping[str, str], tops: Mapping[str, float | None]) -> DataFrame:
    """``scaled[new] = feature``: the feature over its largest group value.

    The block, one row per key, is written first: the largest values are then read from a few of
    its columns, and the child table behind it is read once.
    """
    largest = {new: F.lit(tops[new]) for new in scaled if new in tops}
    needed = sorted({n for new, n in scaled.items() if new not in tops})
    if needed:
        out = materialize(out, "block")
        found = out.agg(F.struct(*[F.max(n).alias(n) for n in needed]).alias("s")).scalar()
        largest |= {new: found[n] for new, n in scaled.items() if new not in tops}
    return out.withColumns(
        {new: F.try_divide(F.col(n).cast("double"), largest[new].cast("double")) for new, n in scaled.items()}
    )

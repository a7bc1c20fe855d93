"""Features whose aggregates can be kept per slice and merged.

Each builder names what has to be stored of a group (``parts``, aggregates over rows), how the stored
columns of several slices become one (``merge``, aggregates over states) and the feature (``value``). The
merge of all slices gives what the aggregate of the same name in ``aggregates`` gives over all rows.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from starfold.functions import aggregates
from starfold.functions.aggregates import dummy_name

Part = Callable[[str], Column]


@dataclass(frozen=True)
class Mergeable:
    """``parts`` over rows; ``merge`` and ``value`` take a function from part name to its column."""

    parts: Mapping[str, Column]
    merge: Mapping[str, Callable[[Part], Column]]
    value: Callable[[Part], Column]


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _added(**parts: Column) -> tuple[dict, dict]:
    """Parts that merge by adding up."""
    return parts, {n: (lambda p, n=n: F.sum(p(n))) for n in parts}


def total_of(c: Column | str) -> Mergeable:
    parts, merge = _added(sum=F.sum(_col(c)))
    return Mergeable(parts, merge, lambda p: F.coalesce(p("sum").cast("double"), F.lit(0.0)))


def present(c: Column | str) -> Mergeable:
    parts, merge = _added(n=F.count(_col(c)))
    return Mergeable(parts, merge, lambda p: p("n"))


def row_count() -> Mergeable:
    return present(F.lit(1))


def mean_of(c: Column | str) -> Mergeable:
    parts, merge = _added(sum=F.sum(_col(c)), n=F.count(_col(c)))
    return Mergeable(parts, merge, lambda p: F.try_divide(p("sum").cast("double"), p("n").cast("double")))


def truncated_mean(c: Column | str) -> Mergeable:
    mean = mean_of(c)
    return Mergeable(mean.parts, mean.merge, lambda p: mean.value(p).cast("int"))


def flag_rate(c: Column | str) -> Mergeable:
    return mean_of(_col(c).cast("int"))


def share_where(condition: Column) -> Mergeable:
    parts, merge = _added(hits=F.count_if(condition), n=F.count(F.lit(1)))
    return Mergeable(parts, merge, lambda p: p("hits").cast("double") / p("n").cast("double"))


def biggest(c: Column | str) -> Mergeable:
    return Mergeable({"max": F.max(_col(c))}, {"max": lambda p: F.max(p("max"))}, lambda p: p("max"))


latest = biggest


def earliest(c: Column | str) -> Mergeable:
    return Mergeable({"min": F.min(_col(c))}, {"min": lambda p: F.min(p("min"))}, lambda p: p("min"))


def year_span(c: Column | str) -> Mergeable:
    low, high = earliest(c), biggest(c)
    return Mergeable(low.parts | high.parts, low.merge | high.merge, lambda p: p("max") - p("min"))


def carry_latest(c: Column | str, order: Column | str) -> Mergeable:
    """The value in the row of largest order; the order is stored beside it, so slices may overlap in time."""
    return Mergeable(
        {"order": F.max(_col(order)), "value": F.max_by(_col(c), _col(order))},
        {"order": lambda p: F.max(p("order")), "value": lambda p: F.max_by(p("value"), p("order"))},
        lambda p: p("value"),
    )


def carry_first(c: Column | str, order: Column | str) -> Mergeable:
    return Mergeable(
        {"order": F.min(_col(order)), "value": F.min_by(_col(c), _col(order))},
        {"order": lambda p: F.min(p("order")), "value": lambda p: F.min_by(p("value"), p("order"))},
        lambda p: p("value"),
    )


def category_counts(
    c: Column | str,
    values: Sequence,
    prefix: str,
    names: Sequence[str] | None = None,
    null_category: bool = False,
) -> dict[str, Mergeable]:
    names = names or [dummy_name(prefix, v) for v in values]
    conditions = aggregates.category_conditions(c, values, null_category)
    out = {}
    for name, condition in zip(names, conditions):
        parts, merge = _added(n=F.count_if(condition))
        out[name] = Mergeable(parts, merge, lambda p: p("n"))
    return out

"""Aggregate expressions for feature blocks.

Each builder returns one aggregate column, so a block can put all its features in a single
``groupBy(key).agg(...)``. All of them combine partially before the shuffle: a key that owns a
third of the table still sends only one buffer per map task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def total_of(c: Column | str) -> Column:
    """Sum as double, 0 for an all-null group.

    Decimals and whole numbers add up exactly in their own type. Doubles add as doubles: no digit is
    dropped and no size overflows; the last bits depend on the order of rows, and NaN stays NaN.
    """
    return F.coalesce(F.sum(_col(c)).cast("double"), F.lit(0.0))


def present(c: Column | str) -> Column:
    """Count of non-null values."""
    return F.count(_col(c))


def row_count() -> Column:
    return F.count(F.lit(1))


def mean_of(c: Column | str) -> Column:
    """Mean of the non-null rows as double; NULL for an all-null group."""
    return F.avg(_col(c)).cast("double")


def truncated_mean(c: Column | str) -> Column:
    return F.avg(_col(c)).cast("int")


def flag_rate(c: Column | str) -> Column:
    """Share of ones in a 0/1 column among its non-null rows."""
    return F.avg(_col(c).cast("int"))


def share_where(condition: Column) -> Column:
    """Rows meeting the condition over all rows of the group; never NULL."""
    return F.count_if(condition).cast("double") / F.count(F.lit(1)).cast("double")


def biggest(c: Column | str) -> Column:
    return F.max(_col(c))


def latest(c: Column | str) -> Column:
    """Last value when the kept column is also the ordering one."""
    return F.max(_col(c))


def earliest(c: Column | str) -> Column:
    return F.min(_col(c))


def year_span(c: Column | str) -> Column:
    return F.max(_col(c)) - F.min(_col(c))


def order_key(
    year: Column | str, month: Column | str, tiebreak: Column | str, digits: int = 19
) -> Column:
    """(year, month, whole-number tie-break of up to ``digits`` digits) packed into one decimal.

    A decimal fits a fixed-width aggregation buffer, so ``max_by`` on it runs as a hash
    aggregate. Ordering by a struct would sort every input row instead.
    """
    if digits > 28:
        raise ValueError("at most 28 digits fit beside year and month")
    when = (_col(year).cast("int") * 100 + _col(month).cast("int")).cast("decimal(8,0)")
    # Twice the range of the tie-break, so a negative one never reaches the month before.
    step = F.lit("2" + "0" * digits).cast(f"decimal({digits + 1},0)")
    return when * step + _col(tiebreak).cast(f"decimal({digits},0)")


def carry_latest(c: Column | str, order: Column) -> Column:
    """Value of ``c`` in the row with the largest ``order``."""
    return F.max_by(_col(c), order)


def carry_first(c: Column | str, order: Column | str) -> Column:
    """Value of ``c`` in the row with the smallest ``order``: the first row of the group."""
    return F.min_by(_col(c), _col(order))


def dummy_name(prefix: str, value) -> str:
    """Column name of a category; without dots, which Spark reads as struct access."""
    if isinstance(value, float) and value.is_integer():
        value = int(value)
    return f"{prefix}_{value}".replace(".", "_")


def category_counts(
    c: Column | str,
    values: Sequence,
    prefix: str,
    names: Sequence[str] | None = None,
    null_category: bool = False,
) -> dict[str, Column]:
    """One count per category value. With ``null_category`` a None in ``values`` counts NULLs."""
    out = {}
    for i, value in enumerate(values):
        name = names[i] if names else dummy_name(prefix, value)
        out[name] = F.count_if(_matches(c, value, null_category))
    return out


def category_conditions(c: Column | str, values: Sequence, null_category: bool = False) -> list[Column]:
    """One condition per category value."""
    return [_matches(c, value, null_category) for value in values]


def category_shares(c: Column | str, values: Sequence, prefix: str) -> dict[str, Column]:
    """Share of each category over all rows of the group."""
    return {
        dummy_name(prefix, value): share_where(_matches(c, value, False)) for value in values
    }


def _matches(c: Column | str, value, null_category: bool) -> Column:
    if value is None:
        if not null_category:
            raise ValueError("None is a category only with null_category=True")
        return _col(c).isNull()
    return _col(c) == F.lit(value)


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c

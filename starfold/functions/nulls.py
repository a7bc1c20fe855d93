"""Null handling. NULL is the only missing value; NaN is never carried."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def fill_constant(c: Column | str, value) -> Column:
    return F.coalesce(_col(c), F.lit(value))


def fill_from(c: Column | str, other: Column | str) -> Column:
    """Fill one column from another one of the same row."""
    return F.coalesce(_col(c), _col(other))


def replace_value(c: Column | str, old, new) -> Column:
    c = _col(c)
    return F.when(c == F.lit(old), F.lit(new)).otherwise(c)


def fill_numeric(df: DataFrame, value: float, skip: Iterable[str] = ()) -> DataFrame:
    """Constant fill of every numeric column in one projection; each column keeps its type."""
    skip = set(skip)
    names = [
        f.name
        for f in df.schema.fields
        if isinstance(f.dataType, T.NumericType) and f.name not in skip
    ]
    return df.na.fill(value, subset=names) if names else df


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c

"""Column transforms that need a global scalar.

Every scalar comes from a one-row aggregate used as an uncorrelated scalar subquery: the scan of
the subquery reads only the column concerned, partial aggregation leaves one buffer per task, and
no join or unpartitioned window is planned.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def scalars(df: DataFrame, **aggregates: Column) -> Column:
    """Several global aggregates of one frame as a struct, read in a single pass."""
    return df.agg(F.struct(*[a.alias(n) for n, a in aggregates.items()]).alias("s")).scalar()


def scale_by_max(df: DataFrame, column: str, out: str | None = None) -> DataFrame:
    """Divide a column by its largest value; NULL when that value is 0."""
    top = df.agg(F.max(column)).scalar()
    return df.withColumn(out or column, F.try_divide(F.col(column).cast("double"), top.cast("double")))


def log_stats(df: DataFrame, column: str) -> Column:
    """Largest, mean and smallest ln(1 + x) of a column as a struct, in a single pass."""
    logged = F.log1p(F.col(column).cast("double"))
    return scalars(df, top=F.max(logged), mean=F.avg(logged), low=F.min(logged))


def fill_truncated_mean(
    df: DataFrame, column: str, out: str | None = None, mean: Column | None = None
) -> DataFrame:
    """Fill NULLs with the whole part of the column's mean, or of a ``mean`` learned before."""
    whole = df.agg(F.avg(column).cast("bigint").alias("m")).scalar() if mean is None else mean.cast("bigint")
    return df.withColumn(out or column, F.coalesce(F.col(column), whole.cast(_type(df, column))))


def fill_truncated_min(df: DataFrame, column: str, out: str | None = None) -> DataFrame:
    """Fill NULLs with the whole part of the column's minimum."""
    whole = df.agg(F.min(column).cast("bigint").alias("m")).scalar()
    return df.withColumn(out or column, F.coalesce(F.col(column), whole.cast(_type(df, column))))


def log_scale(
    df: DataFrame,
    column: str,
    fill: str | None = None,
    out: str | None = None,
    log_out: str | None = None,
    stats: Column | None = None,
) -> DataFrame:
    """ln(1 + x), optional fill with the whole part of the mean or minimum, division by the max.

    The maximum and the fill value come from the same pass, or from ``stats`` as ``log_stats`` gives
    them for the rows learned from. ``log_out`` keeps the unscaled log.
    """
    logged = F.log1p(F.col(column).cast("double"))
    if stats is None:
        stats = log_stats(df, column)
    value = logged
    if fill is not None:
        if fill not in ("mean", "min"):
            raise ValueError(f"fill must be 'mean' or 'min', not {fill!r}")
        chosen = stats["mean"] if fill == "mean" else stats["low"]
        value = F.coalesce(logged, chosen.cast("bigint").cast("double"))
    columns = {out or column: F.try_divide(value, stats["top"])}
    if log_out:
        columns[log_out] = logged
    return df.withColumns(columns)


def _type(df: DataFrame, column: str):
    return df.schema[column].dataType

"""Dataset profile numbers."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F


def base_rate(df: DataFrame, label: str = "TARGET") -> DataFrame:
    """Rows, positives and positive share of a labelled frame."""
    positive = F.col(label) == 1
    return df.agg(
        F.count(F.lit(1)).alias("rows"),
        F.count_if(positive).alias("positives"),
        F.try_divide(F.count_if(positive).cast("double"), F.count(F.lit(1)).cast("double")).alias(
            "positive_rate"
        ),
    )


def observed(df: DataFrame, write: Callable[[DataFrame], None], **numbers: Column) -> dict:
    """Write a table and return aggregates of the written rows, taken in the same pass.

    ``numbers`` are aggregates without distinct values, each a single number. No second job reads the rows.
    """
    seen = Observation()
    write(df.observe(seen, *[c.alias(n) for n, c in numbers.items()]))
    return seen.get


def distinct_ids(frames: list[DataFrame], key: str) -> DataFrame:
    """Number of distinct keys over several frames. Each frame is made distinct before the union."""
    ids = [f.select(key).distinct() for f in frames]
    both = ids[0]
    for more in ids[1:]:
        both = both.union(more)
    return both.distinct().agg(F.count(key).alias("ids"))


def coverage(child: DataFrame, child_key: str, entities: DataFrame, key: str) -> DataFrame:
    """Distinct entities in the child table over all entities."""
    every = entities.agg(F.count_distinct(key)).scalar()
    return child.agg(F.count_distinct(child_key).alias("child_ids")).select(
        "child_ids",
        every.alias("ids"),
        F.try_divide(F.col("child_ids").cast("double"), every.cast("double")).alias("coverage"),
    )

"""Joining entity-level frames. Every join here is an equi-join on the entity key."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from starfold.functions.nulls import fill_numeric
from starfold.session import materialize


def unique_rows(df: DataFrame, key: str) -> DataFrame:
    """The same rows, with a run-time error when a key occurs twice.

    The check rides on an aggregation by the key, whose shuffle the later join on that key
    reuses; duplicates never fan out into k x k rows.
    """
    others = [c for c in df.columns if c != key]
    once = F.assert_true(F.col("_copies") == 1, F.format_string(f"duplicate {key}: %s", F.col(key)))
    return (
        df.groupBy(key)
        .agg(F.count(F.lit(1)).alias("_copies"), *[F.any_value(c).alias(c) for c in others])
        .where(once.isNull())
        .drop("_copies")
    )


def assemble(
    spine: DataFrame, blocks: Iterable[DataFrame], key: str = "EID", fill: float | None = None,
    skip: Iterable[str] = (),
) -> DataFrame:
    """Left-join entity blocks onto the spine, then fill what is missing.

    All joins use the one key, so the spine is shuffled once however many blocks follow, and each
    block arrives already partitioned by its own aggregation.
    """
    wide = reduce(lambda left, block: left.join(block, key, "left"), blocks, spine)
    return wide if fill is None else fill_numeric(wide, fill, skip=[key, *skip])


def matching(df: DataFrame, other: DataFrame, key: str) -> DataFrame:
    """Rows whose key occurs in ``other``. The key list is made distinct before it is shuffled."""
    return df.join(other.select(key).distinct(), key, "left_semi")


def anti(df: DataFrame, other: DataFrame, key: str) -> DataFrame:
    """Rows whose key does not occur in ``other``."""
    return df.join(other.select(key).distinct(), key, "left_anti")


def attach(df: DataFrame, lookup: DataFrame, key: str, small_rows: int = 10_000) -> DataFrame:
    """Left-join a frame with one row per key that is not the entity key.

    Rows of ``df`` may pile up on one key. The lookup is written once; when it is counted to be small
    it is broadcast and no row of ``df`` moves, otherwise adaptive execution splits the heavy
    partitions.
    """
    lookup = materialize(lookup, "lookup")
    small = lookup.count() <= small_rows
    return df.join(F.broadcast(lookup) if small else lookup, key, "left")


def hot_keys(df: DataFrame, key: str, share: float) -> list:
    """The keys that own more than ``share`` of the rows: fewer than 1 / share, whatever the table."""
    counts = df.groupBy(key).agg(F.count(F.lit(1)).alias("_n"))
    total = df.agg(F.count(F.lit(1))).scalar()
    found = counts.where(F.col(key).isNotNull() & (F.col("_n") > total * share)).select(key).collect()
    return [r[0] for r in found]


def attach_spread(
    df: DataFrame, lookup: DataFrame, key: str, salts: int = 64, share: float = 1 / 256
) -> DataFrame:
    """``attach`` for a lookup too large to broadcast: rows of measured hot keys are dealt over salts.

    A key that owns more than ``share`` of the rows gets a salt from the content of each row, and its
    one lookup row a copy for every salt; all other rows join as they are. A lost task deals its rows
    as before, since the salt depends on nothing but the row.
    """
    hot = hot_keys(df, key, share)
    if not hot:
        return df.join(lookup, key, "left")
    heavy = F.coalesce(F.col(key).isin(hot), F.lit(False))
    salt = F.when(heavy, F.pmod(F.xxhash64(*df.columns), F.lit(salts)).cast("int")).otherwise(F.lit(0))
    copies = F.when(heavy, F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0)))
    spread = lookup.withColumn("_salt", F.explode(copies))
    return df.withColumn("_salt", salt).join(spread, [key, "_salt"], "left").drop("_salt")


def align(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Full join of two frames with one row per key."""
    return left.join(right, key, "full")


def stack_rows(first: DataFrame, second: DataFrame) -> DataFrame:
    """All rows of both frames, matched by column name; absent columns become NULL."""
    return first.unionByName(second, allowMissingColumns=True)

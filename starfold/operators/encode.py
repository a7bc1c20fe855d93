"""Categorical encoding: vocabularies, one-hot columns, dictionary indexes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from starfold.functions.aggregates import dummy_name
from starfold.session import materialize

SMALL_ROWS = 10_000
SMALL_BYTES = 8 << 20


class WideCategory(ValueError):
    """More category values than can become columns."""


def vocabulary(df: DataFrame, column: str, max_values: int = 1000) -> list:
    """The distinct non-null values in value order, for use as column names.

    Nothing is dropped: a wider column raises, because every value becomes a feature column.
    ``max_values`` is how many columns the caller will take. A column of any width goes to
    ``category_counts_long`` and ``category_vectors`` instead.
    """
    rows = (
        df.select(column).where(F.col(column).isNotNull()).distinct().limit(max_values + 1).collect()
    )
    if len(rows) > max_values:
        raise WideCategory(f"{column} has more than {max_values} values")
    return sorted(r[0] for r in rows)


def first_seen_values(
    df: DataFrame, column: str, order: Column | str, max_values: int = 1000
) -> list:
    """The distinct values, NULL included, in order of first appearance."""
    seen = df.groupBy(column).agg(F.min(order).alias("_first")).limit(max_values + 1)
    rows = seen.orderBy("_first").collect()
    if len(rows) > max_values:
        raise WideCategory(f"{column} has more than {max_values} values")
    return [r[0] for r in rows]


def one_hot(
    df: DataFrame,
    column: str,
    values: Sequence | None = None,
    prefix: str | None = None,
    without: Sequence = (),
    null_category=None,
    keep: bool = False,
) -> DataFrame:
    """0/1 columns ``prefix_value`` on the same row, without a join.

    ``without`` leaves values out. NULL gives zeros everywhere unless ``null_category`` names the
    value it stands for.
    """
    source = F.col(column)
    if null_category is not None:
        source = F.coalesce(source, F.lit(null_category))
    if values is None:
        values = vocabulary(df.select(source.alias(column)), column)
    dummies = {
        dummy_name(prefix or column, v): F.coalesce(source == F.lit(v), F.lit(False)).cast("int")
        for v in values
        if v not in without
    }
    out = df.withColumns(dummies)
    return out if keep else out.drop(column)


def codebook(
    df: DataFrame, column: str, order: Column | str | None = None, small_rows: int = SMALL_ROWS
) -> tuple[DataFrame, bool]:
    """(column, code) with codes 0.. by first appearance, or by value when no order is given.

    Also says whether the table is proven small. A small table is ranked in one task; a larger
    one is sorted by range, written once, and numbered from per-partition row counts.
    """
    first = F.col(column) if order is None else F.min(order)
    seen = df.groupBy(column).agg(F.any_value(first).alias("_first") if order is None else first.alias("_first"))
    seen = materialize(seen, "values")
    head = seen.limit(small_rows + 1).agg(
        F.count(F.lit(1)).alias("n"),
        F.coalesce(F.sum(F.octet_length(F.col(column).cast("string"))), F.lit(0)).alias("b"),
    ).first()
    if head.n <= small_rows and head.b <= SMALL_BYTES:
        rank = F.row_number().over(Window.orderBy("_first")) - 1
        return seen.select(column, rank.cast("long").alias("code")), True
    placed = materialize(
        seen.orderBy("_first").select(column, F.monotonically_increasing_id().alias("_at")), "codebook"
    )
    part = F.shiftright("_at", 33)
    within = F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))
    counts = placed.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("_n"))
    # One row per sorted partition, so this window holds no data rows.
    before = F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    starts = counts.select("_part", F.coalesce(before, F.lit(0)).alias("_start"))
    coded = placed.withColumn("_part", part).join(F.broadcast(starts), "_part")
    return coded.select(column, (F.col("_start") + within).alias("code")), False


def append_codes(
    book: DataFrame, df: DataFrame, column: str, order: Column | str | None = None, small_rows: int = SMALL_ROWS
) -> DataFrame:
    """A codebook (column, code) grown by the values of ``df`` that it does not hold.

    Old values keep their codes. New ones get the next numbers, by first appearance in ``df`` or by
    value when no order is given. Only distinct values are compared with the book. The result is
    written; an empty book gives what ``codebook`` gives.
    """
    first = F.any_value(F.col(column)) if order is None else F.min(order)
    seen = df.groupBy(column).agg(first.alias("_first"))
    known = book.select(F.col(column).alias("_known"))
    fresh = seen.join(known, F.col(column).eqNullSafe(F.col("_known")), "left_anti")
    added, _ = codebook(fresh, column, "_first", small_rows)
    start = book.agg(F.coalesce(F.max("code") + 1, F.lit(0)).cast("long")).scalar()
    return materialize(
        book.select(column, "code").unionByName(added.select(column, (F.col("code") + start).alias("code"))), "codebook"
    )


def dictionary_encode(
    df: DataFrame,
    column: str,
    order: Column | str | None = None,
    out: str | None = None,
    small_rows: int = SMALL_ROWS,
) -> DataFrame:
    """Replace a column by its codebook index; NULL is a value of its own."""
    book, small = codebook(df, column, order, small_rows)
    book = book.select(F.col(column).alias("_value"), F.col("code").alias("_code"))
    if small:
        book = F.broadcast(book)
    joined = df.join(book, F.col(column).eqNullSafe(F.col("_value")), "left")
    return joined.withColumn(out or column, F.col("_code")).drop("_value", "_code")


def wide_category_counts(
    df: DataFrame, key: str, column: str, values: Sequence, prefix: str
) -> DataFrame:
    """Category counts for many values: counted in long form first, then pivoted.

    Only (key, value) counts reach the pivot, so the aggregation buffers stay narrow. For a few
    values the fused ``category_counts`` in a block needs one aggregation instead of two.
    """
    long = df.groupBy(key, column).agg(F.count(F.lit(1)).alias("_n"))
    wide = long.groupBy(key).pivot(column, list(values)).agg(F.sum("_n"))
    return wide.select(
        key, *[F.coalesce(F.col(f"`{v}`"), F.lit(0)).alias(dummy_name(prefix, v)) for v in values]
    )


def category_counts_long(df: DataFrame, key: str, column: str) -> DataFrame:
    """(key, column, n): rows per entity and value, for any number of values; NULL is a value."""
    return df.where(F.col(key).isNotNull()).groupBy(key, column).agg(F.count(F.lit(1)).alias("n"))


def category_vectors(df: DataFrame, key: str, column: str) -> DataFrame:
    """(key, codes, counts): the counts of each entity as a sparse vector over all values.

    ``codes`` are ascending codebook numbers (by value); an entity holds only the values it has.
    """
    long = category_counts_long(df, key, column)
    coded = dictionary_encode(long, column, out="_number")
    pairs = F.sort_array(F.collect_list(F.struct("_number", "n"))).alias("_pairs")
    rows = coded.groupBy(key).agg(pairs)
    return rows.select(key, F.col("_pairs._number").alias("codes"), F.col("_pairs.n").alias("counts"))

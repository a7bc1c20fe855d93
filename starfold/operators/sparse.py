"""Sparse feature vectors of any width, built by aggregation.

A wide category never becomes columns: its counts stay rows (key, index, value) until one grouping
puts the rows of an entity into a sparse vector. The vector is the struct that vectors are stored as, so
it is written as Parquet and read back with the vector type; no Python function sees a row.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.linalg import VectorUDT
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from starfold.operators.encode import category_counts_long
from starfold.session import scratch_path


def sparse_counts(df: DataFrame, key: str, column: str, book: DataFrame, offset: int = 0) -> DataFrame:
    """(key, index, value): how often each entity has each value of a codebook (column, code).

    Counted before the join with the book, so a value that a third of all rows hold costs one row
    per entity. Values that the book does not hold are left out.
    """
    counts = category_counts_long(df, key, column)
    codes = book.select(F.col(column).alias("_value"), "code")
    coded = counts.join(codes, F.col(column).eqNullSafe(F.col("_value")))
    return coded.select(
        key, (F.col("code") + offset).cast("int").alias("index"), F.col("n").cast("double").alias("value")
    )


def sparse_parts(rows: DataFrame, key: str) -> DataFrame:
    """(key, indices, values) from rows (key, index, value); equal indices of an entity add up."""
    summed = rows.groupBy(key, "index").agg(F.sum("value").alias("value"))
    pairs = F.sort_array(F.collect_list(F.struct("index", "value"))).alias("_pairs")
    grouped = summed.groupBy(key).agg(pairs)
    return grouped.select(key, F.col("_pairs.index").alias("indices"), F.col("_pairs.value").alias("values"))


def stored_vector(size: int, indices: Column, values: Column) -> Column:
    """The struct a sparse vector is stored as; indices ascend."""
    return F.struct(
        F.lit(0).cast("byte").alias("type"),
        F.lit(size).alias("size"),
        indices.cast("array<int>").alias("indices"),
        values.cast("array<double>").alias("values"),
    )


def as_vectors(df: DataFrame, columns: str | Sequence[str] = "features", name: str = "vectors") -> DataFrame:
    """Write a frame whose ``columns`` are ``stored_vector`` and read those back as vectors."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    made = {columns} if isinstance(columns, str) else set(columns)
    fields = [T.StructField(f.name, VectorUDT() if f.name in made else f.dataType) for f in df.schema.fields]
    return df.sparkSession.read.schema(T.StructType(fields)).parquet(path)


def vector_entries(df: DataFrame, key: str, column: str) -> DataFrame:
    """(key, index, value) of the stored entries of sparse vectors, read by expressions."""
    # A vector's JSON form names its indices and values, so no Python function has to open it.
    stored = F.from_json(F.to_json(F.struct(F.col(column).alias("v"))), "v struct<indices array<int>, values array<double>>")
    pairs = df.select(key, stored.alias("s")).select(key, F.explode(F.arrays_zip("s.v.indices", "s.v.values")).alias("e"))
    return pairs.select(key, F.col("e.indices").alias("index"), F.col("e.values").alias("value"))


def dense_and_sparse(
    dense: DataFrame, names: Sequence[str], parts: DataFrame, key: str, size: int, out: str = "features"
) -> DataFrame:
    """The columns ``names`` of ``dense`` as entries 0.., the sparse parts of the same entity behind them.

    ``parts`` (key, indices, values) has one row per entity and indices from ``len(names)`` on; an
    entity without parts has none. Other columns of ``dense`` stay beside the vector.
    """
    front = F.array(*[F.lit(i) for i in range(len(names))])
    values = F.array(*[F.col(f"`{n}`").cast("double") for n in names])
    joined = dense.join(parts, key, "left")
    none = F.array().cast("array<int>"), F.array().cast("array<double>")
    vector = stored_vector(
        size,
        F.concat(front, F.coalesce("indices", none[0])),
        F.concat(values, F.coalesce("values", none[1])),
    )
    others = [c for c in dense.columns if c not in set(names)]
    return as_vectors(joined.select(*others, vector.alias(out)), out, "matrix")

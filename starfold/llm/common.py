"""Helpers shared by the training-data operators."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from starfold.session import materialize, scratch_path
from starfold.sources import table

__all__ = ["blank", "bound_batches", "components", "cut", "for_now", "map_batches", "row_key", "small_enough", "table"]

BATCH_BYTES = 2 << 20
BROADCAST_BYTES = 64 << 20


def cut(df: DataFrame, name: str) -> DataFrame:
    """Write once to the shared folder and go on from the files: short lineage, no second computation."""
    return materialize(df, name)


@contextmanager
def for_now(df: DataFrame, name: str) -> Iterator[DataFrame]:
    """``cut`` for a table that is needed only within the block; its files are deleted behind it."""
    spark, path = df.sparkSession, scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    try:
        yield spark.read.schema(df.schema).parquet(path)
    finally:
        folder = spark._jvm.org.apache.hadoop.fs.Path(path)
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def bound_batches(spark: SparkSession) -> None:
    """Let Arrow batches be limited by bytes too, so that long texts cannot fill a worker."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def map_batches(
    df: DataFrame, function: Callable[[pa.RecordBatch], Iterator[pa.RecordBatch]], schema: str
) -> DataFrame:
    """``mapInArrow`` for a function of one batch."""
    bound_batches(df.sparkSession)

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                yield from function(batch)

    return df.mapInArrow(run, schema)


def blank(c: str) -> Column:
    """A text column with null read as empty."""
    return F.coalesce(F.col(c).cast("string"), F.lit(""))


def row_key() -> Column:
    """A long from the id and the text of a row: rows that agree in both are one row."""
    return F.xxhash64(F.coalesce(F.col("doc_id").cast("string"), F.lit("-")), blank("text"))


def small_enough(df: DataFrame, rows: int, row_bytes: int) -> DataFrame:
    """Hint a broadcast only for a side whose counted size is under the limit; else leave it to a shuffle.

    ``row_bytes`` is what a row takes in the hash table of the join, several times its raw width.
    """
    return F.broadcast(df) if rows * row_bytes <= BROADCAST_BYTES else df


def components(edges: DataFrame) -> DataFrame:
    """Connected components of an edge list (a, b) of longs: one row (id, root) per linked id.

    Alternates large-star and small-star steps; each step is two aggregations that combine before
    the shuffle and two equi-joins, and its edges go to the shared folder. Root is the smallest id
    reachable. Loops and repeated edges are allowed; an empty list gives no rows.
    """
    edges = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    now = cut(edges.where("u != v").distinct(), "edges")
    state = None
    while True:
        both = now.select("u", "v").unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        now = cut(small.unionByName(low.select("u", F.col("m").alias("v"))).distinct(), "edges")
        seen = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(seen) == state:
            return now.select(F.col("u").alias("id"), F.col("v").alias("root")).unionByName(
                now.select(F.col("v").alias("id"), F.col("v").alias("root")).distinct()
            )
        state = tuple(seen)

"""Child tables stored in buckets of the entity key, so that their aggregation needs no shuffle."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from starfold.session import scratch_path


def store_bucketed(df: DataFrame, key: str, buckets: int, name: str | None = None, path: str | None = None) -> str:
    """Write a table in ``buckets`` buckets of ``key``, sorted by it within each; returns the table name.

    The one shuffle is paid here. Each bucket is one file, so a reader that groups or joins by the key
    takes a bucket as a partition. Tables to be joined without a shuffle need the same ``buckets``.
    """
    name = name or f"bucketed_{uuid.uuid4().hex}"
    path = path or scratch_path(df.sparkSession, name)
    laid = df.repartition(buckets, key)
    laid.write.bucketBy(buckets, key).sortBy(key).option("path", path).saveAsTable(name)
    return name


def bucketed(spark: SparkSession, name: str) -> DataFrame:
    return spark.table(name)

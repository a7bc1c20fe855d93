"""Metrics, per-round history and feature importance of a boosted model."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.classification import GBTClassificationModel
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from starfold.session import scratch_path


def area_under_roc(df: DataFrame, label: str, score: str) -> float:
    """Exact area under the ROC curve. Equal scores are one point of the curve; no binning."""
    evaluator = BinaryClassificationEvaluator(
        rawPredictionCol=score, labelCol=label, metricName="areaUnderROC", numBins=0
    )
    return evaluator.evaluate(
        df.select(F.col(label).cast("double").alias(label), F.col(score).cast("double").alias(score))
    )


def areas_under_roc(df: DataFrame, label: str, scores: Sequence[str], buckets: int = 4096) -> list[float]:
    """The exact area under the curve of several score columns, in one pass over the rows.

    Rows are counted by (column, score), then cumulated in two steps: over score ranges, and inside
    each range. A window therefore holds one range of one column, never a whole column.
    """
    values = F.array(*[F.struct(F.lit(i).alias("i"), F.col(s).cast("double").alias("s")) for i, s in enumerate(scores)])
    long = df.select(F.col(label).cast("int").alias("y"), F.explode(values).alias("v")).select("y", "v.i", "v.s")
    counts = long.groupBy("i", "s").agg(F.sum("y").alias("p"), F.sum(1 - F.col("y")).alias("n"))
    # Margins run over all numbers; their logistic value spreads them over the ranges in order.
    place = F.floor(buckets / (1 + F.exp(-F.col("s")))).cast("int")
    counts = counts.withColumn("b", place)
    inside = Window.partitionBy("i", "b").orderBy("s").rowsBetween(Window.unboundedPreceding, -1)
    below = F.coalesce(F.sum("n").over(inside), F.lit(0))
    ranges = counts.withColumn("below", below).groupBy("i", "b").agg(
        F.sum("p").alias("p"), F.sum("n").alias("n"), F.sum(F.col("p") * (F.col("below") + F.col("n") / 2)).alias("own")
    )
    earlier = Window.partitionBy("i").orderBy("b").rowsBetween(Window.unboundedPreceding, -1)
    area = F.sum(F.col("own") + F.col("p") * F.col("before")) / (F.sum("p") * F.sum("n"))
    areas = ranges.withColumn("before", F.coalesce(F.sum("n").over(earlier), F.lit(0))).groupBy("i").agg(area.alias("a"))
    return [r.a for r in areas.orderBy("i").collect()]


def metric_history(
    spark: SparkSession, history: Sequence[float], metric: str = "logLoss"
) -> DataFrame:
    """Per-round metric values as rows (round, metric, value)."""
    rows = [(i, metric, float(v)) for i, v in enumerate(history, start=1)]
    return spark.createDataFrame(rows, "round int, metric string, value double")


def kept_rounds(history: DataFrame, run: str, patience: int, larger_is_better: bool) -> DataFrame:
    """(run, kept, trained) from rows (run, round, value): what ``best_round`` says for each run.

    ``kept`` is the best round read before ``patience`` rounds passed without a strictly better
    value, ``trained`` the round at which reading stopped. A run's rounds are a bounded group.
    """
    value = F.col("value") if larger_is_better else -F.col("value")
    upto = Window.partitionBy(run).orderBy("round")
    before = F.max(value).over(upto.rowsBetween(Window.unboundedPreceding, -1))
    rows = history.withColumn("_before", before)
    better = F.when(F.col("_before").isNull() | (value > F.col("_before")), F.col("round"))
    rows = rows.withColumn("_best", F.max(better).over(upto))
    tired = F.when(F.col("round") - F.col("_best") >= patience, F.col("round"))
    last = F.coalesce(F.min(tired).over(Window.partitionBy(run)), F.max("round").over(Window.partitionBy(run)))
    read = rows.withColumn("_last", last).where(F.col("round") <= F.col("_last"))
    return read.groupBy(run).agg(F.max_by("_best", "round").alias("kept"), F.max("_last").alias("trained"))


def feature_map(spark: SparkSession, names: Sequence[str]) -> DataFrame:
    """Index, name and type letter ('q', quantitative) of every feature, in vector order."""
    rows = [(i, n, "q") for i, n in enumerate(names)]
    return spark.createDataFrame(rows, "index int, feature string, kind string")


def split_importance(model: GBTClassificationModel, names: Sequence[str] | DataFrame) -> DataFrame:
    """Share of splits made on each used feature, ascending.

    ``names`` are the features in vector order, or rows (index, feature) for vectors of any width. The node table the model itself writes holds one row per node of every tree.
    """
    spark = SparkSession.builder.getOrCreate()
    path = scratch_path(spark, "model")
    model.write().save(path)
    nodes = spark.read.parquet(f"{path}/data")
    node = F.col("nodeData") if "nodeData" in nodes.columns else F.struct("*")
    splits = nodes.select(node.alias("n")).where(F.col("n.leftChild") >= 0)
    counts = splits.groupBy(F.col("n.split.featureIndex").alias("index")).agg(
        F.count(F.lit(1)).alias("splits")
    )
    total = counts.agg(F.sum("splits")).scalar()
    listing = names if isinstance(names, DataFrame) else F.broadcast(feature_map(spark, names))
    named = counts.join(listing, "index")
    return named.select(
        "feature", (F.col("splits") / total).alias("fscore")
    ).orderBy("fscore", "feature")


def gain_importance(model: GBTClassificationModel, names: Sequence[str]) -> DataFrame:
    """Impurity-gain importance of every feature, summing to 1."""
    spark = SparkSession.builder.getOrCreate()
    values = model.featureImportances.toArray()
    rows = [(n, float(values[i])) for i, n in enumerate(names)]
    return spark.createDataFrame(rows, "feature string, fscore double").orderBy("fscore", "feature")


def top_features(importance: DataFrame, n: int) -> DataFrame:
    """The n most important features, best first."""
    return importance.orderBy(F.desc("fscore"), "feature").limit(n)

"""Sinks. Each one writes from the executors; the row order inside a table is not part of it."""

from __future__ import annotations

from pyspark.sql import DataFrame

from starfold.sources.versions import write_committed


def write_scored(df: DataFrame, path: str) -> None:
    """Scored rows as CSV with a header and a fixed column order."""
    df.select("EID", "FORTARGET", "PROB").write.mode("overwrite").csv(path, header=True)


def write_importance(df: DataFrame, path: str) -> None:
    """Importance table as CSV, ascending by score; it has one row per feature."""
    df.select("feature", "fscore").coalesce(1).write.mode("overwrite").csv(path, header=True)


def write_feature_map(df: DataFrame, path: str) -> None:
    """Feature map: tab-separated, without a header, in index order."""
    df.select("index", "feature", "kind").coalesce(1).write.mode("overwrite").csv(path, sep="\t")


def write_scored_atomic(df: DataFrame, folder: str) -> str:
    """Scored rows as a new version of the folder; readers of ``committed_path`` never see a part of it."""
    return write_committed(df, folder, write_scored)


def write_importance_atomic(df: DataFrame, folder: str) -> str:
    return write_committed(df, folder, write_importance)


def write_feature_map_atomic(df: DataFrame, folder: str) -> str:
    return write_committed(df, folder, write_feature_map)

"""Session defaults and the shared folder used for tables that must outlive a stage."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.ui.enabled": "false",
}

_LOCAL: dict[str, str] = {}
_WHEN_CLEARED: list[Callable[[], None]] = []


def build_session(app: str = "starfold", master: str | None = None, **conf) -> SparkSession:
    """A session with adaptive execution on. ``conf`` keys use ``__`` for dots."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for name, value in DEFAULTS.items():
        builder = builder.config(name, value)
    for name, value in conf.items():
        builder = builder.config(name.replace("__", "."), str(value))
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``; a temporary one only where one process does all."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):
        raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
    application = spark.sparkContext.applicationId
    if application not in _LOCAL:
        _LOCAL[application] = tempfile.mkdtemp(prefix="starfold-")
    return _LOCAL[application]


def _own_folder(spark: SparkSession) -> str:
    return f"{shared_dir(spark).rstrip('/')}/starfold/{spark.sparkContext.applicationId}"


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path in this application's part of the shared folder."""
    return f"{_own_folder(spark)}/{name}-{uuid.uuid4().hex}"


def when_cleared(forget: Callable[[], None]) -> Callable[[], None]:
    """Register what holds frames that read intermediate tables; it is called when those are deleted."""
    _WHEN_CLEARED.append(forget)
    return forget


JOIN_PARTITION = "16m"


def bound_partitions(spark: SparkSession) -> None:
    """Let a task of a shuffle read less, for stages that aggregate and join many tables at once.

    Adaptive execution merges partitions up to 64 MB of compressed rows; a task that holds ten
    aggregations and sorts of them needs a multiple of that. A size set by the user stays.
    """
    size = "spark.sql.adaptive.advisoryPartitionSizeInBytes"
    if spark.conf.get(size, None) is None:
        spark.conf.set(size, JOIN_PARTITION)


def clear_scratch(spark: SparkSession) -> None:
    """Delete this application's intermediate tables, after the results that read them are written."""
    for forget in _WHEN_CLEARED:
        forget()
    path = spark._jvm.org.apache.hadoop.fs.Path(_own_folder(spark))
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def materialize(df: DataFrame, name: str = "table", by: str | None = None) -> DataFrame:
    """Write ``df`` once as Parquet in the shared folder and read it back.

    ``by`` lays the files out by a column of few values, so that filters on it skip whole folders.

    Used before iterative work: every later pass prunes columns, and a lost executor re-reads
    files instead of recomputing the whole lineage.
    """
    path = scratch_path(df.sparkSession, name)
    (df.write.partitionBy(by) if by else df.write).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)

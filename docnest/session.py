"""Session settings and the shared folder."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
}


def session(app: str, master: str | None = None, **settings: str) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**SETTINGS, **settings}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


# One shuffle task should get about this much; more tasks than the cap cost more than they save.
TASK_BYTES = 256 * 1024 * 1024
MAX_SHUFFLE_TASKS = 2_000_000
# The planner's stand-in for a size it does not know is 2**63, less where columns are left out.
UNKNOWN_BYTES = 2**55
# Parquet columns grow by about this factor as shuffled rows.
ROW_GROWTH = 3


def tasks_for(tables: Iterable[DataFrame]) -> int:
    """How many tasks the largest table needs in a shuffle. Sizes are the planner's own estimates, so nothing is read; a table whose size it
    does not know does not count."""
    sizes = [int(str(t._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) for t in tables]
    return min(MAX_SHUFFLE_TASKS, max((s for s in sizes if s < UNKNOWN_BYTES), default=0) * ROW_GROWTH // TASK_BYTES)


def size_shuffles(spark: SparkSession, tables: Iterable[DataFrame]) -> int:
    """Raise the initial number of shuffle partitions to fit the largest table; adaptive execution
    merges what turns out small."""
    wanted = tasks_for(tables)
    key = "spark.sql.adaptive.coalescePartitions.initialPartitionNum"
    current = int(spark.conf.get(key, None) or spark.conf.get("spark.sql.shuffle.partitions"))
    if wanted > current:
        spark.conf.set(key, str(wanted))
    return max(wanted, current)


def shared_folder(spark: SparkSession, purpose: str) -> str:
    """A new folder every executor can reach, under ``spark.checkpoint.dir``.

    Only a local session may do without that setting; it then gets a temporary folder.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return f"{root.rstrip('/')}/{purpose}-{uuid.uuid4().hex}"
    if not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder all executors share")
    return tempfile.mkdtemp(prefix=f"docnest-{purpose}-")


def written(df: DataFrame, purpose: str) -> DataFrame:
    """``df`` written as Parquet to a new shared folder and read back: later jobs start from files, not from lineage.

    The folder goes when the driver's JVM ends, or earlier with :func:`discard`.
    """
    spark = df.sparkSession
    folder = shared_folder(spark, purpose)
    df.write.parquet(folder)
    delete_at_end(spark, folder)
    return spark.read.schema(df.schema).parquet(folder)


def delete_at_end(spark: SparkSession, folder: str) -> None:
    """Delete a folder when the driver's JVM ends."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(path)


def discard(spark: SparkSession, folder: str) -> None:
    """Delete a folder nothing will read again."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)

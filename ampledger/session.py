"""Session settings shared by every job: the checkpoint folder and scratch tables."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


#: Settings this library is written for. Partition numbers are the cluster's choice: give
#: ``spark.sql.shuffle.partitions`` generously, adaptive execution merges small ones.
SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.python.sql.dataFrameDebugging.enabled": "false",
}


def checkpoint_root(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``.

    Only a local session may fall back to a folder of its own; on a cluster the
    setting must name storage that every executor can reach.
    """
    context = spark.sparkContext
    current = context.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if not configured:
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder shared by the cluster")
        configured = tempfile.mkdtemp(prefix="run-", dir="/tmp")
    context.setCheckpointDir(configured)
    return context.getCheckpointDir()


def checkpointed(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder once and cut its lineage."""
    checkpoint_root(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame) -> DataFrame:
    """A checkpoint whose row count is known, so that what derives from it has a bound.

    Rows are counted by the job that writes them. A part that is computed twice may be
    counted twice, which leaves the count an upper bound.
    """
    checkpoint_root(df.sparkSession)
    seen = Observation()
    out = df.observe(seen, F.count(F.lit(1)).alias("n")).checkpoint(eager=True)
    return bounded(out, seen.get["n"])


def bounded(df: DataFrame, rows: int | None) -> DataFrame:
    """Note that ``df`` has at most ``rows`` rows (``None``: unknown)."""
    df._row_bound = rows
    return df


def row_bound(df: DataFrame) -> int | None:
    """Proven upper bound of the number of rows, if there is one."""
    return df.__dict__.get("_row_bound")


def no_larger(df: DataFrame, than: DataFrame) -> DataFrame:
    """``df`` filters, projects or groups ``than`` and inherits its bound."""
    return bounded(df, row_bound(than))


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path for an intermediate table, beside the checkpoints."""
    return f"{checkpoint_root(spark)}/{name}-{uuid.uuid4().hex}"

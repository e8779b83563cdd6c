"""Session settings, and where a job may keep intermediate tables."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

# The largest input, as read, that ``spread`` moves.
SPREAD_BYTES = 256 * 2**20
# What ``paired`` leaves as it is, and the size of a partition otherwise, both as read from compressed files.
BROADCAST_SIDE_BYTES = 10 * 2**20
PAIRED_BYTES = 2 * 2**20
MOST_PARTITIONS = 10_000
# Estimates of this size are no more than a product of guesses.
UNKNOWN_BYTES = 2**50

# Settings worth having on any cluster; sizes follow the data, not the code.
RECOMMENDED_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # Whole documents travel through Arrow, so batches stay small in rows.
    "spark.sql.execution.arrow.maxRecordsPerBatch": "2000",
}


def build_session(app: str, master: str | None = None, **conf: str) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**RECOMMENDED_CONF, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def checkpoint_root(spark: SparkSession) -> str:
    """The shared folder for checkpoints, as the cluster names it.

    Read from the session (``spark.checkpoint.dir``). Only a local master
    without that setting, as in tests, falls back to a temporary folder: on a
    cluster a machine-local folder would be lost with its executor.
    """
    context = spark.sparkContext
    if context.getCheckpointDir():
        return context.getCheckpointDir()
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder all executors share")
        root = tempfile.mkdtemp(prefix="lodestone-")
    context.setCheckpointDir(root)
    return context.getCheckpointDir()


def checkpointed(df: DataFrame) -> DataFrame:
    """Materialise ``df`` with its partitions and row order; survives lost executors."""
    checkpoint_root(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame, label: str = "stored") -> DataFrame:
    """Materialise ``df`` as a table, to be read column by column.

    Cuts the lineage like a checkpoint and is cheaper to read again, but rows
    come back in other partitions.
    """
    path = scratch_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh path for an intermediate table, next to the checkpoints."""
    return f"{checkpoint_root(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"


def spread(df: DataFrame) -> DataFrame:
    """Give a small input a partition per core for the per-document work after it.

    A lone file with one row group cannot be split. Only an input that Spark
    estimates at less than ``SPREAD_BYTES`` is shuffled; how a larger one is
    split is left to ``spark.sql.files.maxPartitionBytes``.
    """
    small = estimated_bytes(df) < SPREAD_BYTES
    return df.repartition(df.sparkSession.sparkContext.defaultParallelism) if small else df


def estimated_bytes(df: DataFrame) -> int:
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def paired(left: DataFrame, right: DataFrame, on: str) -> tuple[DataFrame, DataFrame]:
    """Two sides of a join in partitions by key, as many as their estimated size calls for.

    Left to itself, Spark merges partitions by their compressed size until there is one
    per core, and what a task sorts grows with the input. A pair with a side small enough
    to be broadcast, or whose size Spark can't tell, is left as it is.
    """
    sizes = [estimated_bytes(side) for side in (left, right)]
    if min(sizes) < BROADCAST_SIDE_BYTES or max(sizes) >= UNKNOWN_BYTES:
        return left, right
    count = min(-(-sum(sizes) // PAIRED_BYTES), MOST_PARTITIONS)
    return left.repartition(count, on), right.repartition(count, on)

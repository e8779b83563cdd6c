"""Recovering vectors from numbered checkpoint files."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.operators.selecting import keep_keys
from lodestone.operators.status import apply_changes
from lodestone.operators.vectors import one_per_key


def latest_checkpoint(vectors: DataFrame) -> DataFrame:
    """Vectors of the checkpoint with the largest number."""
    newest = vectors.agg(F.max("checkpoint_no").alias("checkpoint_no"))
    # One row, so the join is a filter.
    return vectors.join(F.broadcast(newest), "checkpoint_no", "left_semi")


def dedup_first(vectors: DataFrame) -> DataFrame:
    """First vector per (source, id) over checkpoints in number order.

    Vectors without a source are left out.
    """
    rows = vectors.withColumn("source", F.col("metadata.source")).filter("source is not null")
    first = one_per_key(rows, ["source", "id"], ["checkpoint_no", "pos"], newest=False)
    return first


def known_sources(vectors: DataFrame, status: DataFrame) -> DataFrame:
    return keep_keys(vectors, status.select(F.col("url").alias("source")), "source")


def unknown_sources(vectors: DataFrame, status: DataFrame) -> DataFrame:
    """Sources of vectors that no status row knows, for a warning."""
    sources = vectors.select("source").distinct()
    return sources.join(status.select(F.col("url").alias("source")), "source", "left_anti")


def merge_checkpoints(status: DataFrame, vectors: DataFrame, errors: DataFrame | None = None) -> DataFrame:
    """Status after storing the recovered ``vectors`` (source, id, ...) per source.

    ``errors`` (url, error) names sources whose vectors could not be stored.
    """
    counts = vectors.groupBy(F.col("source").alias("url")).agg(
        F.count("*").alias("embeddings_count")
    )
    counts = counts.join(status.select("url"), "url", "left_semi")
    failed = None
    if errors is not None:
        failed = counts.join(errors, "url").select("url", F.lit("failed").alias("status"), "error")
        counts = counts.join(errors, "url", "left_anti")
    stored = counts.select(
        "url",
        F.lit("completed").alias("status"),
        F.lit("embedded").alias("stage"),
        F.lit(None).cast("string").alias("error"),
        "embeddings_count",
    )
    merged = apply_changes(status, stored)
    return merged if failed is None else apply_changes(merged, failed)

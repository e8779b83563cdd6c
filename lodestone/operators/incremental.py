"""Working only on what changed since the last run."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone import schemas
from lodestone.operators.chunking import chunk
from lodestone.operators.embedding import vector_record, with_vectors
from lodestone.operators.selecting import keep_keys
from lodestone.session import stored
from lodestone.sources import tables


def changed_keys(docs: DataFrame, registry: DataFrame) -> DataFrame:
    """(url, last_modified) of documents new to the registry, or newer than it; an equal time is no change.

    The registry is first cut down to the URLs at hand.
    """
    pairs = docs.select("url", "last_modified").distinct()
    known = registry.join(pairs.select("url").distinct(), "url", "left_semi").select(
        "url", F.col("last_modified").alias("_known"), F.lit(True).alias("_in")
    )
    changed = pairs.join(known, "url", "left").filter("_in is null or _known < last_modified")
    return changed.select("url", "last_modified")


def changed_documents(docs: DataFrame, registry: DataFrame) -> DataFrame:
    """The documents of ``changed_keys``.

    Decided on (url, last_modified) alone; texts take part only in the last
    step, which seldom needs to shuffle them (see ``keep_keys``).
    """
    return keep_keys(docs, changed_keys(docs, registry), "url", "last_modified")


def registry_entries(vectors: DataFrame) -> DataFrame:
    """Registry rows of newly embedded sources: time, vector count and last id.

    The ids themselves stay one per row (``write_ids``): a source may own a
    large share of all vectors, which no single array should hold.
    """
    rows = vectors.select(
        F.col("metadata.source").alias("url"),
        F.col("metadata.last_modified").alias("last_modified"),
        "id",
    )
    return rows.groupBy("url").agg(
        F.max("last_modified").alias("last_modified"),
        F.count("*").alias("vector_count"),
        F.max("id").alias("last_vector_id"),
    )


def registry_ids(vectors: DataFrame) -> DataFrame:
    return vectors.select(F.col("metadata.source").alias("url"), F.col("id").alias("vector_id"))


def update_registry(registry: DataFrame, vectors: DataFrame) -> DataFrame:
    """The registry after a run: entries of embedded sources are replaced."""
    fresh = registry_entries(vectors)
    kept = registry.join(fresh.select("url"), "url", "left_anti")
    return kept.unionByName(fresh)


def write_registry(entries: DataFrame, path: str, write_seq: int) -> None:
    tables.append_log(schemas.conform(entries, schemas.REGISTRY), path, write_seq)


def write_ids(vectors: DataFrame, path: str, write_seq: int) -> None:
    """Store the vector ids of a run's sources beside the registry at ``path``, before its entries.

    One row per id, ordered by source within each file. Chunks of a document come
    from one task, so this needs no shuffle and a source lies in few row groups.
    """
    ids = schemas.conform(registry_ids(vectors), schemas.SOURCE_IDS)
    tables.append_log(ids.sortWithinPartitions("url", "vector_id"), f"{path}-ids", write_seq)


def source_ids(spark: SparkSession, path: str, sources: DataFrame | None = None) -> DataFrame:
    """(url, vector_id) of the sources in the registry at ``path``; with ``sources``, of their ``url`` only.

    A source has the ids of the run its entry comes from: none if that run found it
    too short for a chunk, and never those of a run that was lost before its entries
    were written. A source without a URL has none.
    """
    entries = tables.read_latest(spark, path, schemas.REGISTRY, "url", only=sources, keep_run=True)
    entries = entries.filter("vector_count > 0").select("url", "write_seq")
    ids = tables.read_log(spark, f"{path}-ids", schemas.SOURCE_IDS)
    # Stored, so that the join is planned by the real size of the entries asked for.
    return ids.join(stored(entries, "entries"), ["url", "write_seq"], "left_semi").drop("write_seq")


def read_registry(
    spark: SparkSession, path: str, docs: DataFrame | None = None, without_run: int | None = None
) -> DataFrame:
    """The registry; with ``docs``, only the entries of their URLs.

    A run that is repeated reads it ``without_run``, its own, and so finds the same changes again.
    """
    hidden = None if without_run is None else [without_run]
    return tables.read_latest(spark, path, schemas.REGISTRY, "url", only=docs, hidden=hidden)


def embed_changed_chunks(docs: DataFrame, registry: DataFrame, embedder, run_ts: Column | datetime | str) -> DataFrame:
    """Chunks of the changed documents with ``values``, or with the ``error`` of their batch."""
    return with_vectors(chunk(changed_documents(docs, registry), run_ts), embedder)


def complete_sources(embedded: DataFrame) -> DataFrame:
    """Sources all of whose chunks have a vector."""
    return embedded.groupBy("source").agg(F.count("error").alias("n")).filter("n = 0").select("source")


def embed_changed(
    docs: DataFrame,
    registry: DataFrame,
    embedder,
    namespace: str | Column,
    run_ts: Column | datetime | str,
) -> DataFrame:
    """Vectors of the changed documents only; none when nothing changed.

    Leaves out chunks that failed; ``embed_changed_chunks`` has them as well.
    """
    return vector_record(embed_changed_chunks(docs, registry, embedder, run_ts), namespace)

"""Chunks to vectors through a user-supplied embedder."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from datetime import datetime

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.functions.times import as_ntz
from lodestone.operators.selecting import drop_keys

BATCH = 16
# Texts whose vectors leave the worker at a time, in whole batches.
SLICE_TEXTS = 512
_EMBEDDED = "struct<values:array<float>,error:string>"


def _embedding_column(embedder: Callable[[list[str]], np.ndarray], batch: int) -> Callable:
    def embed_slice(text: pa.Array) -> pa.Array:
        values, errors = [], []
        texts = text.to_pylist()
        for start in range(0, len(texts), batch):
            part = texts[start : start + batch]
            try:
                vectors = np.asarray(embedder(part), dtype=np.float32)
                if len(vectors) != len(part):
                    raise ValueError(f"{len(vectors)} vectors for {len(part)} texts")
                values.extend(vectors)
                errors.extend([None] * len(part))
            except Exception as problem:  # the embedder is foreign code
                values.extend([None] * len(part))
                errors.extend([str(problem) or type(problem).__name__] * len(part))
        return pa.StructArray.from_arrays(
            [pa.array(values, pa.list_(pa.float32())), pa.array(errors, pa.string())],
            names=["values", "error"],
        )

    # Vectors are returned in slices of whole batches, so that a worker never holds those of all rows it was sent.
    step = batch * max(1, SLICE_TEXTS // batch)

    def embed_texts(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for text in batches:
            for start in range(0, max(1, len(text)), step):
                yield embed_slice(text.slice(start, step))

    # Declared non-deterministic so that the optimizer neither repeats the call for
    # a filter on its result nor moves it below a repartition.
    return F.arrow_udf(embed_texts, _EMBEDDED).asNondeterministic()


def with_vectors(
    rows: DataFrame, embedder: Callable[[list[str]], np.ndarray], batch: int = BATCH
) -> DataFrame:
    """Add ``values`` and ``error`` for the ``text`` of each row.

    Texts go to the embedder ``batch`` at a time. When one batch fails, its rows
    carry the error and the others go on.
    """
    embedded = rows.withColumn("_embedded", _embedding_column(embedder, batch)(F.col("text")))
    return embedded.select(*rows.columns, "_embedded.values", "_embedded.error")


def vector_record(embedded: DataFrame, namespace: str | Column) -> DataFrame:
    """Vectors as stored: namespace, id, values, and metadata with the text."""
    space = namespace if isinstance(namespace, Column) else F.lit(namespace)
    return embedded.filter(F.col("error").isNull()).select(
        space.alias("namespace"),
        F.col("chunk_id").alias("id"),
        "values",
        F.struct("source", "type", "depth", "last_modified", "text").alias("metadata"),
    )


def embedding_failures(embedded: DataFrame, run_ts: Column | datetime | str) -> DataFrame:
    """One failure row per source and message."""
    failed = embedded.filter(F.col("error").isNotNull())
    return failed.select(
        F.col("source").alias("url"),
        "error",
        F.lit("embedding").alias("stage"),
        as_ntz(run_ts).alias("timestamp"),
    ).distinct()


def embed(
    chunks: DataFrame,
    embedder: Callable[[list[str]], np.ndarray],
    namespace: str | Column,
    batch: int = BATCH,
) -> DataFrame:
    """Vectors of the chunks whose batch succeeded.

    To keep the failures as well, store ``with_vectors`` once and derive
    ``vector_record`` and ``embedding_failures`` from the stored frame, so that
    no text is embedded twice.
    """
    return vector_record(with_vectors(chunks, embedder, batch), namespace)


def missing_vectors(chunks: DataFrame, vectors: DataFrame) -> DataFrame:
    """Chunks without a vector; embedding is complete when there are none."""
    return drop_keys(chunks, vectors.select(F.col("id").alias("chunk_id")), "chunk_id")

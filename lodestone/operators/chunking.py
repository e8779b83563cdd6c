"""Documents to overlapping chunks."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from datetime import datetime

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.functions.splitting import SEPARATORS, split_text
from lodestone.functions.times import as_ntz

MIN_CHARS = 50
LARGE_DOCUMENT_CHUNKS = 100
# Text that is split before its chunks leave the worker.
SLICE_BYTES = 1024 * 1024


def drop_short(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """Drop documents whose text is null or shorter than ``min_chars`` code points."""
    return docs.filter(F.length("text") >= min_chars)


def chunk_metadata(docs: DataFrame, run_ts: Column | datetime | str) -> DataFrame:
    """Add source, type, depth and last_modified, with defaults for missing ones.

    ``last_modified`` may be a column of its own or part of a ``metadata`` struct.
    """
    columns = set(docs.columns)

    def present(name: str, type_: str) -> Column:
        return (F.col(name) if name in columns else F.lit(None)).cast(type_)

    stamp = F.lit(None).cast("timestamp_ntz")
    if "last_modified" in columns:
        stamp = F.col("last_modified").try_cast("timestamp_ntz")
    elif "metadata" in columns:
        stamp = F.col("metadata.last_modified").try_cast("timestamp_ntz")
    return docs.withColumns(
        {
            "source": F.coalesce(present("url", "string"), F.lit("unknown")),
            "type": F.coalesce(present("type", "string"), F.lit("html")),
            "depth": F.coalesce(present("depth", "int"), F.lit(0)),
            "last_modified": F.coalesce(stamp, as_ntz(run_ts)),
        }
    )


def _slices(texts: pa.Array, size: int) -> Iterator[pa.Array]:
    """``texts`` in runs of about ``size`` bytes; a longer one stands alone."""
    ends = np.cumsum(np.asarray(pc.fill_null(pc.binary_length(texts), 0), dtype=np.int64))
    start = 0
    while start < len(texts):
        before = ends[start - 1] if start else 0
        end = max(start + 1, int(np.searchsorted(ends, before + size, side="right")))
        yield texts.slice(start, end - start)
        start = end


def _splitter(size: int, overlap: int, separators: Sequence[str]):
    fields = [("chunks", pa.list_(pa.string())), ("error", pa.string())]

    def split_slice(texts: pa.Array) -> pa.Array:
        rows = []
        for value in texts:
            try:
                chunks = split_text(value.as_py() or "", size, overlap, separators)
                rows.append({"chunks": chunks, "error": None})
            except (ValueError, RecursionError) as problem:
                rows.append({"chunks": None, "error": str(problem)})
        return pa.array(rows, type=pa.struct(fields))

    # A batch is split and returned in slices, so that a worker never holds the chunks of a whole batch.
    def split(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            if not len(texts):
                yield split_slice(texts)
            for part in _slices(texts, SLICE_BYTES):
                yield split_slice(part)

    # Declared non-deterministic so that the optimizer neither repeats the call for
    # a filter on its result nor moves it below a repartition.
    return F.arrow_udf(split, "struct<chunks:array<string>,error:string>").asNondeterministic()


def split_documents(
    docs: DataFrame,
    run_ts: Column | datetime | str,
    size: int = 500,
    overlap: int = 50,
    separators: Sequence[str] = SEPARATORS,
    min_chars: int = MIN_CHARS,
) -> DataFrame:
    """Documents with their ``chunks`` array and ``error``; one row per document.

    Short documents are dropped before any text reaches Python, and only the
    text does. Both ``chunk_rows`` and ``chunk_failures`` read this frame.
    """
    if overlap > size:
        raise ValueError("overlap must not exceed size")
    described = docs.transform(drop_short, min_chars).transform(chunk_metadata, run_ts)
    split = described.withColumn("_split", _splitter(size, overlap, separators)(F.col("text")))
    kept = ["source", "type", "depth", "last_modified"]
    kept += [c for c in ("doc_key", "page") if c in docs.columns]
    return split.select(*kept, "_split.chunks", "_split.error")


def chunk_results(split: DataFrame) -> DataFrame:
    """One row per chunk, and one row with its ``error`` per failed document.

    The chunk id covers source, position and text, so a re-run or a retried
    task writes the same ids. Documents sharing a source need a ``doc_key`` (or
    ``page``) column to tell their chunks apart.
    """
    carried = [c for c in split.columns if c not in ("chunks", "error")]
    rows = split.select(*carried, "error", F.posexplode_outer("chunks").alias("chunk_index", "text"))
    parts = [c for c in ("doc_key", "page") if c in carried]
    key = [F.col("source"), *[F.col(c).cast("string") for c in parts]]
    chunk_id = F.sha2(
        F.concat_ws("\u0001", *key, F.col("chunk_index").cast("string"), F.col("text")), 256
    )
    return rows.filter("text is not null or error is not null").select(
        F.when(F.col("text").isNotNull(), chunk_id).alias("chunk_id"),
        "source",
        "chunk_index",
        "text",
        "type",
        "depth",
        "last_modified",
        *[c for c in carried if c in ("doc_key", "page")],
        "error",
    )


def chunk_rows(split: DataFrame) -> DataFrame:
    return chunk_results(split).filter(F.col("text").isNotNull()).drop("error")


def chunk_failures(split: DataFrame, run_ts: Column | datetime | str) -> DataFrame:
    """Failure rows of documents that could not be split; the others go on."""
    return split.filter(F.col("error").isNotNull()).select(
        F.col("source").alias("url"),
        "error",
        F.lit("chunking").alias("stage"),
        as_ntz(run_ts).alias("timestamp"),
    )


def chunk(docs: DataFrame, run_ts: Column | datetime | str, **options) -> DataFrame:
    """Chunks of all documents; ``options`` as for ``split_documents``."""
    return chunk_rows(split_documents(docs, run_ts, **options))


def chunks_per_document(chunks: DataFrame) -> DataFrame:
    """Chunk count per source, and whether the document counts as large."""
    counts = chunks.groupBy("source").agg(F.count("*").alias("chunks_count"))
    return counts.withColumn("is_large", F.col("chunks_count") > LARGE_DOCUMENT_CHUNKS)

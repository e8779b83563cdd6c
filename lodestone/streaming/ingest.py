"""Documents arriving in batches: embed what changed, store it, remember it."""

from __future__ import annotations

import json
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from lodestone.operators import embedding, incremental
from lodestone.operators.vectors import append_vectors
from lodestone.session import spread, stored
from lodestone.sources import tables
from lodestone.sources.files import path_exists


def ingest_batch(
    docs: DataFrame,
    root: str,
    batch_id: int,
    embedder,
    namespace: str,
    run_ts: datetime | str,
    writer: str = "batches",
    replace_sources: bool = False,
) -> int:
    """One batch of ``writer``, which numbers its batches. Replaying it is harmless.

    With ``replace_sources`` a changed document loses the vectors of its earlier form, also
    when it has become too short for a chunk; one of whose chunks failed keeps them.

    Chunks that fail are logged under ``failures_ingest``; only documents all of
    whose chunks have vectors are registered, so the others are embedded again
    when they next come. Vectors and their ids by source are stored before the registry. A replay doesn't see
    what its own earlier attempt registered: it finds the same documents changed and
    writes the same rows in place of its own. Where all of them were registered, it writes
    nothing.
    """
    spark = docs.sparkSession
    docs = spread(docs)
    entry_run = tables.claim_run(spark, f"{root}/registry", writer, batch_id)
    if path_exists(spark, f"{root}/registry/write_seq={entry_run}"):
        known = incremental.read_registry(spark, f"{root}/registry", docs)
        if incremental.changed_documents(docs, known).isEmpty():
            return 0
    registry = incremental.read_registry(spark, f"{root}/registry", docs, entry_run)
    if replace_sources:
        changed = stored(incremental.changed_keys(docs, registry), "changed")
    embedded = stored(incremental.embed_changed_chunks(docs, registry, embedder, run_ts), "embedded")
    if embedded.isEmpty() and (not replace_sources or changed.isEmpty()):
        return 0
    failed = embedding.embedding_failures(embedded, run_ts)
    log = f"{root}/failures_ingest"
    tables.append_failures(failed, log, tables.claim_run(spark, log, writer, batch_id))
    fresh = embedding.vector_record(embedded, namespace)
    complete = incremental.complete_sources(embedded)
    replaced = None
    if replace_sources:
        failing = embedded.filter("error is not null").select(F.col("source").alias("url"))
        whole = changed.join(failing, "url", "left_anti")
        replaced = whole.select(F.lit(namespace).alias("namespace"), F.col("url").alias("source"))
    written = append_vectors(fresh, f"{root}/index", batch_id, writer, replace_sources, replaced)
    registered = fresh.join(complete, F.col("metadata.source") == complete["source"], "left_semi")
    entries = incremental.registry_entries(registered)
    if replace_sources:
        none = whole.join(embedded.select(F.col("source").alias("url")), "url", "left_anti")
        entries = entries.unionByName(
            none.groupBy("url").agg(
                F.max("last_modified").alias("last_modified"),
                F.lit(0).cast("long").alias("vector_count"),
                F.lit(None).cast("string").alias("last_vector_id"),
            )
        )
    incremental.write_ids(registered, f"{root}/registry", entry_run)
    incremental.write_registry(entries, f"{root}/registry", entry_run)
    return written


def _stream_id(spark: SparkSession, checkpoint: str) -> str:
    """The id Spark gave the stream when its checkpoint was started; a new checkpoint has a new one."""
    text = spark.read.text(f"{checkpoint}/metadata", wholetext=True).first()["value"]
    return f"stream-{json.loads(text)['id']}"


def ingest_stream(
    docs: DataFrame,
    root: str,
    embedder,
    namespace: str,
    run_ts: datetime | str,
    trigger: dict | None = None,
    replace_sources: bool = False,
) -> StreamingQuery:
    """Ingest a stream of documents (url, text, type, last_modified) into ``root``.

    State lives in the tables, not in the stream, so no watermark is needed.
    By default the query stops when everything available has been read;
    ``trigger`` takes the options of ``DataStreamWriter.trigger``.
    """

    checkpoint = f"{root}/stream"

    def ingest(batch: DataFrame, batch_id: int) -> None:
        writer = _stream_id(batch.sparkSession, checkpoint)
        ingest_batch(batch, root, batch_id, embedder, namespace, run_ts, writer, replace_sources)

    return (
        docs.writeStream.foreachBatch(ingest)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )

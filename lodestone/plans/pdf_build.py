"""PDFs from page texts to stored vectors, all stages in one run.

Same rule as ``corpus_build``: the status table is written last and completes
the run; outputs are logged under the number of the status version to come.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone import schemas
from lodestone.operators import chunking, embedding, pages, status, vectors
from lodestone.operators.selecting import keep_keys
from lodestone.plans.corpus_build import Run
from lodestone.sources import tables

_CHUNK = f"{schemas.CHUNK}, page int, error string"
_VECTOR = f"{schemas.CHUNK}, page int, values array<float>, error string"

NO_TEXT = "no text in the file"


def build(
    run: Run,
    pdfs: DataFrame,
    page_texts: DataFrame,
    embedder,
    namespace: str = vectors.DEFAULT_NAMESPACE,
    dimension: int = vectors.DIMENSION,
) -> int:
    """Chunk, embed and upload the PDFs that are due; returns the rows stored.

    ``pdfs`` is (path), ``page_texts`` is (path, page, text) with pages numbered
    from 1. Chunks keep their page.
    """
    before = run.status()
    listed = pdfs.select(F.col("path").alias("url"))
    due = status.stage_gate(listed, before, "pdf")
    documents = keep_keys(pages.pages_as_documents(page_texts), due, "url")
    had_text = documents.select("url").distinct()

    split = chunking.split_documents(documents, run.run_ts)
    rows = schemas.conform(chunking.chunk_results(split), _CHUNK)
    tables.append_results(rows, run.path("pdf_chunks"), run.write_seq)
    chunks = run.this_stage("pdf_chunks", _CHUNK)

    embedded = embedding.with_vectors(chunks.drop("error"), embedder)
    tables.append_results(schemas.conform(embedded, _VECTOR), run.path("pdf_vectors"), run.write_seq)
    fresh = run.this_stage("pdf_vectors", _VECTOR)

    records = embedding.vector_record(fresh, namespace)
    valid, wrong = vectors.validate_vectors(records, dimension)
    uploaded = vectors.append_vectors(valid, run.path("index"), run.write_seq)

    def per_url(frame: DataFrame, *columns) -> DataFrame:
        return frame.groupBy(F.col("source").alias("url")).agg(*columns)

    failed_chunks = run.this_stage("pdf_chunks", _CHUNK, "failed")
    failed_vectors = run.this_stage("pdf_vectors", _VECTOR, "failed")
    facts = (
        due.join(had_text.withColumn("had_text", F.lit(True)), "url", "left")
        .join(per_url(failed_chunks, F.max("error").alias("chunk_error")), "url", "left")
        .join(per_url(chunks, F.count("*").alias("chunks")), "url", "left")
        .join(per_url(failed_vectors, F.max("error").alias("vector_error")), "url", "left")
        .join(per_url(fresh, F.count("*").alias("vectors")), "url", "left")
        .join(wrong.groupBy("url").agg(F.max("error").alias("upload_error")), "url", "left")
    )
    # Where the run stopped: the first stage with an error, else the end.
    results = facts.select(
        "url",
        F.when(F.col("had_text").isNull() | F.col("chunk_error").isNotNull(), None)
        .when(F.col("vector_error").isNotNull(), "chunked")
        .when(F.col("upload_error").isNotNull(), "embedded")
        .otherwise("uploaded")
        .alias("reached"),
        F.coalesce("chunks", F.lit(0)).alias("chunks"),
        F.coalesce("vectors", F.lit(0)).alias("vectors"),
        F.when(F.col("had_text").isNull(), NO_TEXT)
        .otherwise(F.coalesce("chunk_error", "vector_error", "upload_error"))
        .alias("error"),
    )
    new_status = status.mark_pdf_run(before, listed, results, run.run_ts)
    tables.write_status(new_status, run.path("status"))
    return uploaded

"""The staged corpus build: scrape, merge, chunk, embed, upload.

Each stage reads the tables the stages before it wrote, works only on the URLs
the status table says are ready, stores its output, and last the new status:
writing the status is what completes a stage. Outputs are logged under the
number of the status version to come. A stage lost half way finds the same
version, and the same URLs due, when it is run again and replaces its own
output; a completed stage moves on to the next number.
"""

from __future__ import annotations

from dataclasses import dataclass
from datetime import datetime
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone import schemas
from lodestone.functions.http import http_metadata
from lodestone.functions.times import as_ntz
from lodestone.functions.urls import base_path
from lodestone.operators import chunking, combine, embedding, pages, status, vectors
from lodestone.operators.selecting import keep_keys
from lodestone.session import stored
from lodestone.sources import tables


@dataclass(frozen=True)
class Run:
    """Where a build keeps its tables, and the time it writes into them."""

    spark: SparkSession
    root: str
    run_ts: datetime | str

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def status(self) -> DataFrame:
        return tables.read_status(self.spark, self.path("status"))

    @property
    def write_seq(self) -> int:
        """Number of the status version the running stage will write."""
        return (tables.current_version(self.spark, self.path("status")) or 0) + 1

    def results(self, name: str, ddl: str, *key: str) -> DataFrame:
        """Good rows of a stage, the newest run of each key."""
        return tables.read_latest(self.spark, f"{self.path(name)}/result=ok", ddl, *key)

    def this_stage(self, name: str, ddl: str, result: str = "ok") -> DataFrame:
        """Rows the running stage has just stored."""
        log = tables.read_log(self.spark, f"{self.path(name)}/result={result}", ddl)
        return log.filter(F.col("write_seq") == self.write_seq).drop("write_seq")

    def finish(self, stage: str, new_status: DataFrame, failed: DataFrame) -> None:
        """Log the stage's failures, then complete the stage."""
        tables.append_failures(failed, self.path(f"failures_{stage}"), self.write_seq)
        tables.write_status(new_status, self.path("status"))


_METADATA = schemas.PAGE_METADATA.replace(", ", ",").replace(" ", ":")
_PAGE = (
    "url string, text string, type string, last_modified timestamp_ntz, "
    f"links array<string>, error string, metadata struct<{_METADATA}>"
)
_CHUNK = f"{schemas.CHUNK}, doc_key string, error string"
_VECTOR = f"{schemas.CHUNK}, doc_key string, values array<float>, error string"
LEFT_OUT = "left out when small documents were merged"


RECOVERED = (
    "source string, id string, values array<float>, metadata struct<source:string,type:string,"
    "depth:int,last_modified:timestamp_ntz,text:string>, error string"
)
STAGES = ("scrape", "chunk", "embed", "upload")


def _document():
    """The document a row is part of; merged ones of a section share their source and have a key."""
    return F.coalesce("doc_key", "source").alias("document")


def _by_document(rows: DataFrame, *columns) -> DataFrame:
    return rows.groupBy(_document()).agg(*columns)


def _lineage(run: Run) -> DataFrame | None:
    """Which document a URL went into (``schemas.LINEAGE``), or None where nothing was ever merged."""
    path = run.path("lineage")
    if not tables.log_runs(run.spark, path):
        return None
    return tables.read_latest(run.spark, path, schemas.LINEAGE, "url")


def _members(run: Run, per_document: DataFrame) -> DataFrame:
    """Rows by ``document`` as rows by ``url``: one for every URL that went into the document."""
    lineage = _lineage(run)
    if lineage is None:
        return per_document.withColumnRenamed("document", "url")
    into = lineage.filter("doc_key is not null").select("url", F.col("doc_key").alias("document"))
    rows = per_document.join(into, "document", "left")
    return rows.withColumn("url", F.coalesce("url", "document")).drop("document")


def _due_sources(run: Run, due: DataFrame) -> DataFrame:
    """Sources of chunks that URLs stand for: themselves and, once documents are merged, their sections.

    A section is taken as a whole, as any of its URLs may change how the others are merged.
    """
    sources = due.select(F.col("url").alias("source"))
    if _lineage(run) is not None:
        sources = sources.unionByName(due.select(base_path("url").alias("source"))).distinct()
    return sources


def _with_metadata(run: Run, fetched: DataFrame) -> DataFrame:
    """Fetches with ``last_modified`` as a time and their headers as ``metadata``; a header not given is null."""
    kinds = dict(fetched.dtypes)

    def header(name):
        return F.col(name).cast("string") if name in kinds else F.lit(None).cast("string")

    names = ("last_modified", "etag", "content_type", "content_length")
    metadata = http_metadata("url", *map(header, names), run.run_ts)
    changed = metadata["last_modified"]
    if kinds.get("last_modified", "string") != "string":
        changed = F.col("last_modified").cast("timestamp_ntz")
    elif "last_modified" in kinds:
        changed = F.coalesce(F.col("last_modified").try_cast("timestamp_ntz"), changed)
    rows = fetched.withColumn("metadata", metadata.withField("last_modified", changed))
    return rows.withColumn("last_modified", F.col("metadata.last_modified"))


def _pdf_documents(run: Run, page_texts: DataFrame, due: DataFrame) -> DataFrame:
    """The PDFs that are due, put together from their pages; one without text is an error."""
    texts = keep_keys(page_texts.select("url", "page", "text"), due, "url").withColumnRenamed("url", "path")
    return pages.pages_to_document(texts).select(
        F.col("path").alias("url"),
        "text",
        pages.classify_document("path").alias("type"),
        as_ntz(run.run_ts).alias("last_modified"),
        F.lit(None).cast("array<string>").alias("links"),
        F.when(F.col("text") == "", "no text in the file").alias("error"),
        http_metadata("path", *[F.lit(None).cast("string")] * 4, run.run_ts).alias("metadata"),
    )


def scrape(run: Run, discovered: DataFrame, fetched: DataFrame, page_texts: DataFrame | None = None) -> None:
    """Parse the pages that are due; text, links and errors come of one pass.

    ``fetched`` is (url, status, html[, last_modified, etag, content_type,
    content_length]), the last four as headers give them or ``last_modified`` as a
    time; they are kept as the documents' ``metadata``. PDFs are no pages to parse: their texts come from ``page_texts`` (url, page, text). A URL with
    neither html nor page texts is logged as a failure.
    """
    due = status.stage_gate(discovered, run.status(), "scrape")
    html = keep_keys(pages.ok_pages(fetched).filter("html is not null"), due, "url")
    html = _with_metadata(run, html).select("url", "html", "last_modified", "metadata")
    parsed = pages.parse_pages(html).withColumns(
        {
            "text": pages.page_text(F.col("title"), F.col("body")),
            "type": pages.classify_document("url"),
        }
    )
    content = schemas.conform(parsed, _PAGE)
    if page_texts is not None:
        content = content.unionByName(schemas.conform(_pdf_documents(run, page_texts, due), _PAGE))
    tables.append_results(content, run.path("pages"), run.write_seq)
    content = run.this_stage("pages", _PAGE)
    errors = run.this_stage("pages", _PAGE, "failed")
    before = run.status()
    failed = status.scrape_failures(before, discovered, content, errors)
    run.finish("scrape", status.mark_scraped(before, discovered, content), failed)


def documents(run: Run) -> DataFrame:
    """The scraped documents with their page metadata, as ``json_files.write_documents`` takes them."""
    return schemas.conform(run.results("pages", _PAGE, "url").drop("links", "error"), schemas.DOCUMENT)


def links(run: Run) -> DataFrame:
    """Link edges of the scraped pages, for the next discovery."""
    scraped = run.results("pages", _PAGE, "url")
    edges = scraped.select(F.col("url").alias("src"), F.explode("links").alias("dst"))
    return pages.keep_within_site(edges)


def merge_small(run: Run, min_words: int = 100, keep_pending: bool = False) -> None:
    """Optional: merge the scraped documents that are small into larger ones."""
    documents = run.results("pages", _PAGE, "url").drop("links", "error")
    merged = combine.combine_small(documents, min_words, keep_pending)
    tables.write_combined(merged, run.path("combined"))


def _merged_documents(run: Run, due: DataFrame, min_words: int, keep_pending: bool) -> DataFrame:
    """The documents to chunk once small ones are merged; stores which URL went into which.

    All documents of a section with a URL that is due are merged and chunked anew, as the
    merged ones share the section as their source.
    """
    merge_small(run, min_words, keep_pending)
    combined = tables.read_combined(run.spark, run.path("combined"))
    sections = due.select(base_path("url").alias("base_path")).distinct()
    large = keep_keys(combined.filter("not combined"), due, "url")
    small = keep_keys(combined.filter("combined"), sections, "base_path").withColumn("doc_key", F.col("sources")[0])
    into = small.select(F.explode("sources").alias("url"), F.col("url").alias("source"), "doc_key")
    own = large.select("url", F.col("url").alias("source"), F.col("url").alias("doc_key"))
    known = stored(into.unionByName(own).distinct(), "lineage")
    urls = run.results("pages", _PAGE, "url").select("url").distinct()
    of_sections = keep_keys(urls.withColumn("base_path", base_path("url")), sections, "base_path")
    lost = of_sections.join(known, "url", "left_anti").join(combined.filter("not combined"), "url", "left_anti")
    tables.append_log(
        schemas.conform(known.unionByName(schemas.conform(lost.select("url"), schemas.LINEAGE)), schemas.LINEAGE),
        run.path("lineage"),
        run.write_seq,
    )
    columns = ["url", "text", "type", "last_modified"]
    return large.select(*columns, F.lit(None).cast("string").alias("doc_key")).unionByName(
        small.select(*columns, "doc_key")
    )


def chunk_stage(
    run: Run,
    discovered: DataFrame,
    merged: bool = False,
    min_words: int = 100,
    keep_pending: bool = False,
    **options,
) -> None:
    """Chunk the scraped documents that are due; ``options`` as for ``split_documents``.

    With ``merged``, documents of less than ``min_words`` words are merged first, by section.
    A merged document has its section as source, and its chunks count for every URL in it. A
    URL that merging leaves out (see ``combine_small``; not with ``keep_pending``) fails.
    """
    before = run.status()
    due = status.stage_gate(discovered, status.init_pending(before, discovered), "chunk")
    had_content = keep_keys(run.results("pages", _PAGE, "url").select("url"), due, "url").distinct()
    if merged:
        had_content = stored(had_content, "due")
        documents = _merged_documents(run, had_content, min_words, keep_pending)
    else:
        documents = keep_keys(run.results("pages", _PAGE, "url"), due, "url").drop("links", "error")
    split = chunking.split_documents(documents, run.run_ts, **options)
    rows = schemas.conform(chunking.chunk_results(split), _CHUNK)
    tables.append_results(rows, run.path("chunks"), run.write_seq)
    counts = _by_document(run.this_stage("chunks", _CHUNK), F.count("*").alias("n"))
    errors = _by_document(run.this_stage("chunks", _CHUNK, "failed"), F.max("error").alias("error"))
    # A document too short to chunk had content and counts no chunks.
    results = had_content.join(_members(run, counts.join(errors, "document", "full")), "url", "left")
    if merged:
        lost = _lineage(run).filter("doc_key is null").select("url", F.lit(LEFT_OUT).alias("_lost"))
        results = results.join(lost, "url", "left").withColumn("error", F.coalesce("error", "_lost")).drop("_lost")
    run.finish("chunk", *status.mark_chunked(before, discovered, results, run.run_ts))


def embed_stage(run: Run, discovered: DataFrame, embedder) -> None:
    """Embed chunks of documents that are due and have no vector yet."""
    before = run.status()
    due = _due_sources(run, status.stage_gate(discovered, before, "embed"))
    chunks = keep_keys(run.results("chunks", _CHUNK, "source").drop("error"), due, "source")
    done = tables.read_log(run.spark, f"{run.path('vectors')}/result=ok", _VECTOR)
    done = done.filter(F.col("write_seq") < run.write_seq).select(F.col("chunk_id").alias("id"))
    embedded = embedding.with_vectors(vectors.new_chunks(chunks, done), embedder)
    tables.append_results(schemas.conform(embedded, _VECTOR), run.path("vectors"), run.write_seq)
    counts = _by_document(chunks, F.count("*").alias("n"))
    errors = _by_document(run.this_stage("vectors", _VECTOR, "failed"), F.max("error").alias("error"))
    results = _members(run, counts.join(errors, "document", "left"))
    run.finish("embed", *status.mark_embedded(before, discovered, results, run.run_ts))


def upload_stage(
    run: Run,
    discovered: DataFrame,
    namespace: str = vectors.DEFAULT_NAMESPACE,
    dimension: int = vectors.DIMENSION,
    replace_sources: bool = False,
) -> int:
    """Store the vectors of embedded documents; returns how many rows came in.

    With ``replace_sources`` the index keeps nothing else of the documents whose vectors
    are all stored now; a document with a rejected vector keeps what it had.
    """
    before = run.status()
    due = _due_sources(run, status.stage_gate(discovered, before, "upload"))
    embedded = tables.read_latest(
        run.spark, f"{run.path('vectors')}/result=ok", _VECTOR, "chunk_id"
    )
    # Vectors of chunks an earlier form of the document had are not written again.
    chunks = run.results("chunks", _CHUNK, "source").select("source", "chunk_id")
    current = keep_keys(embedded, keep_keys(chunks, due, "source"), "chunk_id")
    recovered = keep_keys(run.results("recovered", RECOVERED, "source", "id"), due, "source")
    records = embedding.vector_record(current, namespace).unionByName(
        recovered.select(F.lit(namespace).alias("namespace"), "id", "values", "metadata")
    )
    valid, wrong = vectors.validate_vectors(records, dimension)
    rejected = wrong.groupBy(F.col("url").alias("source")).agg(F.max("error").alias("error"))
    had_vectors = current.select("source", _document()).unionByName(
        recovered.select("source", F.col("source").alias("document"))
    )
    results = _members(run, had_vectors.distinct().join(rejected, "source", "left"))
    # A document also replaces what its members had on their own.
    whole = results.filter("error is null")
    names = whole.select("source").union(whole.select("url")).distinct()
    replaced = names.select(F.lit(namespace).alias("namespace"), "source")
    index = run.path("index")
    uploaded = vectors.append_vectors(valid, index, run.write_seq, replace_sources=replace_sources, replaced=replaced)
    run.finish("upload", *status.mark_uploaded(before, discovered, results))
    return uploaded


def all_failures(run: Run) -> DataFrame:
    """The failure log of every stage since the last reset; ``write_seq`` gives the order."""
    logs = [tables.read_failures(run.spark, run.path(f"failures_{s}")) for s in STAGES]
    start = tables.read_table(run.spark, run.path("failures_from"), "write_seq bigint").first()
    since = start["write_seq"] if start else 0
    return reduce(DataFrame.unionByName, logs).filter(F.col("write_seq") >= since)


def build(
    run: Run,
    discovered: DataFrame,
    fetched: DataFrame,
    embedder,
    namespace: str,
    dimension: int,
    page_texts: DataFrame | None = None,
    merged: bool = False,
    min_words: int = 100,
    replace_sources: bool = False,
) -> int:
    """All stages in order, as one batch ingest. Returns the number of vectors stored.

    ``page_texts`` are the pages of PDFs (see ``scrape``), ``merged`` chunks small documents
    together (see ``chunk_stage``), ``replace_sources`` clears what the index had of them.
    """
    scrape(run, discovered, fetched, page_texts)
    chunk_stage(run, discovered, merged, min_words)
    embed_stage(run, discovered, embedder)
    return upload_stage(run, discovered, namespace, dimension, replace_sources)

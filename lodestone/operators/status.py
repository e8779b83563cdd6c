"""The per-URL status table: who is ready for a stage, and what a stage changes.

``url`` is unique in a status table. Every transition returns a whole new
table; store it with ``sources.tables.write_status`` after the stage's output.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone import schemas
from lodestone.functions.times import as_ntz
from lodestone.operators.selecting import keep_keys
from lodestone.session import paired

RunTime = Column | datetime | str

RATE_UNIT_SECONDS = 3600


def _is(column: str, value: str) -> Column:
    return F.coalesce(F.col(column) == value, F.lit(False))


# Stages that an untracked URL is ready for.
UNTRACKED = ("scrape", "pdf")
# What makes a tracked URL ready for a stage.
READY = {
    "scrape": "not (status <=> 'completed')",
    "chunk": "stage <=> 'scraped'",
    "embed": "stage <=> 'chunked'",
    "upload": "stage <=> 'embedded'",
    "pdf": "not (status <=> 'completed' and stage <=> 'uploaded')",
}


def stage_gate(discovered: DataFrame, status: DataFrame, stage: str) -> DataFrame:
    """Discovered URLs that are ready for ``stage``.

    What makes them ready is settled before the join, so that only URLs and a flag are sorted.
    """
    flagged = status.select("url", F.expr(READY[stage]).alias("_ready"))
    urls, flagged = paired(discovered.select("url").distinct(), flagged, "url")
    tracked = urls.join(flagged, "url", "left")
    return tracked.filter(F.coalesce("_ready", F.lit(stage in UNTRACKED))).select("url")


def with_content(ready: DataFrame, content: DataFrame) -> DataFrame:
    return ready.join(content.select("url").distinct(), "url", "left_semi")


def missing_content(ready: DataFrame, content: DataFrame) -> DataFrame:
    return ready.join(content.select("url").distinct(), "url", "left_anti")


def reuse_completed(discovered: DataFrame, status: DataFrame, stored: DataFrame, fresh: DataFrame) -> DataFrame:
    """All content for merging: stored for completed URLs, fresh for the others."""
    urls = discovered.select("url").distinct()
    completed = urls.join(status.filter(_is("status", "completed")), "url", "left_semi")
    others = urls.join(completed, "url", "left_anti")
    return keep_keys(stored, completed, "url").unionByName(keep_keys(fresh, others, "url"))


def apply_changes(
    status: DataFrame,
    changes: DataFrame,
    whole_row: bool = False,
    unless_null: tuple[str, ...] = (),
) -> DataFrame:
    """Set the columns of ``changes`` on its URLs, adding URLs not there yet.

    Columns ``changes`` lacks keep their value, or become null with ``whole_row``;
    those in ``unless_null`` keep theirs where the change is null.
    """
    old = status.select("url", F.struct(*[c for c in schemas.STATUS_COLUMNS if c != "url"]).alias("_old"))
    set_columns = [c for c in changes.columns if c != "url"]
    new = changes.select("url", F.struct(*set_columns).alias("_new"))
    joined = old.join(new, "url", "full")
    touched = F.col("_new").isNotNull()

    def value(name: str) -> Column:
        kept = F.col(f"_old.{name}")
        if name in unless_null:
            return F.coalesce(f"_new.{name}", kept)
        if name in set_columns:
            return F.when(touched, F.col(f"_new.{name}")).otherwise(kept)
        return F.when(~touched, kept) if whole_row else kept

    columns = [value(c).alias(c) for c in schemas.STATUS_COLUMNS if c != "url"]
    return schemas.conform(joined.select("url", *columns), schemas.STATUS)


def mark_scraped(status: DataFrame, discovered: DataFrame, content: DataFrame) -> DataFrame:
    """URLs scraped in this run become completed / scraped, with a fresh row."""
    done = with_content(stage_gate(discovered, status, "scrape"), content)
    changes = done.select("url", F.lit("completed").alias("status"), F.lit("scraped").alias("stage"))
    return apply_changes(status, changes, whole_row=True)


def scrape_failures(status: DataFrame, discovered: DataFrame, content: DataFrame, errors: DataFrame) -> DataFrame:
    """Failure rows of URLs that were due but brought no content."""
    failed = missing_content(stage_gate(discovered, status, "scrape"), content)
    return failed.join(errors.select("url", "error"), "url", "left").select(
        "url",
        F.coalesce("error", F.lit("no content returned")).alias("error"),
        F.lit("scraping").alias("stage"),
    )


def init_pending(status: DataFrame, discovered: DataFrame, run_ts: RunTime | None = None) -> DataFrame:
    """Add untracked URLs as pending / discovered; PDFs also get a time."""
    new = discovered.select("url").distinct().join(status, "url", "left_anti")
    rows = new.select("url", F.lit("pending").alias("status"), F.lit("discovered").alias("stage"))
    if run_ts is not None:
        rows = rows.withColumn("last_updated", as_ntz(run_ts))
    return status.unionByName(schemas.conform(rows, schemas.STATUS))


def _stage_results(
    ready: DataFrame,
    results: DataFrame,
    done: str,
    doing: str,
    count_column: str,
    absent: str,
    run_ts: RunTime,
) -> DataFrame:
    """Changes for every ready URL from (url, n, error): one row per URL."""
    outcome = ready.join(results.select("url", "n", "error", F.lit(True).alias("_seen")), "url", "left")
    error = F.when(F.col("_seen").isNull(), F.lit(absent)).otherwise(F.col("error"))
    rows = outcome.select("url", "n", error.alias("_error"))
    failed = F.col("_error").isNotNull()
    return rows.select(
        "url",
        F.when(failed, "failed").otherwise("completed").alias("status"),
        F.when(failed, doing).otherwise(done).alias("stage"),
        F.col("_error").alias("error"),
        F.when(~failed, F.coalesce("n", F.lit(0))).cast("bigint").alias(count_column),
        as_ntz(run_ts).alias("last_updated"),
    )


def _advance(status: DataFrame, changes: DataFrame, count_column: str) -> DataFrame:
    """Apply stage results. A success leaves an old error, a failure an old count."""
    return apply_changes(status, changes, unless_null=("error", count_column))


def _failures(changes: DataFrame, with_time: bool = True) -> DataFrame:
    rows = changes.filter("status = 'failed'")
    time = F.col("last_updated") if with_time else F.lit(None).cast("timestamp_ntz")
    return rows.select("url", "error", "stage", time.alias("timestamp"))


def mark_chunked(
    status: DataFrame, discovered: DataFrame, results: DataFrame, run_ts: RunTime
) -> tuple[DataFrame, DataFrame]:
    """Status and failure rows after chunking. ``results`` is (url, n, error),
    with a row for every URL that had content."""
    tracked = init_pending(status, discovered)
    ready = stage_gate(discovered, tracked, "chunk")
    changes = _stage_results(
        ready, results, "chunked", "chunking", "chunks_count", "no text to chunk", run_ts
    )
    return _advance(tracked, changes, "chunks_count"), _failures(changes)


def mark_embedded(
    status: DataFrame, discovered: DataFrame, results: DataFrame, run_ts: RunTime
) -> tuple[DataFrame, DataFrame]:
    """Status and failure rows after embedding. An untracked URL is not ready.

    A URL whose chunks all had vectors already moves on as well.
    """
    ready = stage_gate(discovered, status, "embed")
    changes = _stage_results(
        ready, results, "embedded", "embedding", "embeddings_count", "nothing to embed", run_ts
    )
    return _advance(status, changes, "embeddings_count"), _failures(changes)


def mark_uploaded(
    status: DataFrame, discovered: DataFrame, results: DataFrame
) -> tuple[DataFrame, DataFrame]:
    """Only the stage moves on. A failed upload is logged without a time and
    leaves the status alone, so it is tried again; one without vectors waits."""
    ready = stage_gate(discovered, status, "upload")
    outcome = ready.join(results.select("url", "error"), "url", "inner")
    done = outcome.filter("error is null").select("url", F.lit("uploaded").alias("stage"))
    failures = outcome.filter("error is not null").select(
        "url", "error", F.lit("uploading").alias("stage"), F.lit(None).cast("timestamp_ntz").alias("timestamp")
    )
    return apply_changes(status, done), failures


# Stages of a PDF run in order.
PDF_STAGES = ("chunked", "embedded", "uploaded")


def mark_pdf_run(status: DataFrame, pdfs: DataFrame, results: DataFrame, run_ts: RunTime) -> DataFrame:
    """Status after PDFs went through all stages in one run.

    ``results`` is (url, reached, chunks, vectors, error): the last stage
    reached (null when no text came out) and the error that stopped it, if any.
    """
    tracked = init_pending(status, pdfs, run_ts)
    outcome = results.select(
        "url", "reached", "chunks", "vectors", F.col("error").alias("problem")
    )
    due = stage_gate(pdfs, tracked, "pdf").join(outcome, "url")
    rows = tracked.join(due, "url")
    position = F.coalesce(
        F.array_position(F.array(*[F.lit(s) for s in PDF_STAGES]), F.col("reached")), F.lit(0)
    )
    changes = rows.select(
        "url",
        F.when(F.col("problem").isNull(), "completed").otherwise("failed").alias("status"),
        F.coalesce("reached", "stage").alias("stage"),
        F.coalesce("problem", "error").alias("error"),
        F.when(position >= 1, F.col("chunks")).otherwise(F.col("chunks_count")).alias("chunks_count"),
        F.when(position >= 2, F.col("vectors"))
        .otherwise(F.col("embeddings_count"))
        .alias("embeddings_count"),
        as_ntz(run_ts).alias("last_updated"),
    )
    return apply_changes(tracked, changes)


def reset_to_chunked(status: DataFrame) -> DataFrame:
    """Send every URL back to completed / chunked, also those never chunked."""
    there = _is("status", "completed") & _is("stage", "chunked")
    return status.select(
        "url",
        F.lit("completed").alias("status"),
        F.lit("chunked").alias("stage"),
        F.when(there, F.col("error")).alias("error"),
        "chunks_count",
        F.when(there, F.col("embeddings_count")).alias("embeddings_count"),
        "last_updated",
    )


def reset_failures(spark: SparkSession) -> DataFrame:
    return schemas.empty(spark, schemas.FAILURE)


def stage_counts(status: DataFrame) -> DataFrame:
    return status.groupBy(F.coalesce("stage", F.lit("unknown")).alias("stage")).agg(
        F.count("*").alias("n")
    )


def status_counts(status: DataFrame) -> DataFrame:
    return status.groupBy(F.coalesce("status", F.lit("unknown")).alias("status")).agg(
        F.count("*").alias("n")
    )


def totals(discovered: DataFrame, status: DataFrame, failures: DataFrame) -> DataFrame:
    """One row: URLs discovered, tracked, failed, and waiting for upload."""
    tracked = status.agg(
        F.count("*").alias("tracked"), F.count_if(_is("stage", "embedded")).alias("embedded")
    )
    return (
        discovered.agg(F.count("*").alias("discovered"))
        .crossJoin(tracked)
        .crossJoin(failures.agg(F.count("*").alias("failed")))
    )


def processing_rate(status: DataFrame) -> DataFrame:
    """Completed URLs per hour; null when their times do not span any."""
    done = status.filter(_is("status", "completed") & F.col("last_updated").isNotNull())
    span = done.agg(
        F.count("*").alias("completed"),
        F.min("last_updated").alias("earliest"),
        F.max("last_updated").alias("latest"),
    )
    seconds = F.timestamp_diff("MICROSECOND", F.col("earliest"), F.col("latest")) / 1e6
    rate = F.col("completed") / seconds * RATE_UNIT_SECONDS
    return span.withColumn("urls_per_hour", F.when(seconds > 0, rate))


def first_and_last_update(status: DataFrame) -> DataFrame:
    """URLs updated first and last among the completed; the lower URL on ties."""
    done = status.filter(_is("status", "completed") & F.col("last_updated").isNotNull())
    times = done.groupBy("last_updated").agg(F.min("url").alias("url"))
    return times.agg(
        F.min_by("url", "last_updated").alias("first_url"),
        F.max_by("url", "last_updated").alias("last_url"),
    )


def recent_failures(failures: DataFrame, n: int = 5, log_order: str = "write_seq") -> DataFrame:
    """The newest failures first, those without a time last, ties in log order, then by URL and error."""
    rest = [F.asc(c) for c in ("url", "error") if c in failures.columns]
    order = [F.desc_nulls_last("timestamp"), F.asc(log_order), *rest]
    return failures.orderBy(*order).limit(n)

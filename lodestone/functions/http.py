"""Expressions over the headers of a fetched page."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column
from pyspark.sql import functions as F

from lodestone.functions.times import as_ntz, parse_http_date


def http_metadata(
    url: Column | str,
    last_modified: Column | str,
    etag: Column | str,
    content_type: Column | str,
    content_length: Column | str,
    run_ts: Column | datetime | str,
) -> Column:
    """Page metadata struct. A missing or malformed date falls back to the run time."""
    col = lambda c: F.col(c) if isinstance(c, str) else c
    now = as_ntz(run_ts)
    return F.struct(
        col(url).alias("url"),
        F.coalesce(parse_http_date(last_modified), now).alias("last_modified"),
        col(etag).alias("etag"),
        col(content_type).alias("content_type"),
        col(content_length).try_cast("bigint").alias("content_length"),
        now.alias("scraped_at"),
    )


def is_html_response(content_type: Column | str) -> Column:
    """Whether a page's links are followed; a missing content type is not HTML."""
    col = F.col(content_type) if isinstance(content_type, str) else content_type
    return F.coalesce(col.contains("text/html"), F.lit(False))


def is_pdf_response(content_type: Column | str) -> Column:
    return F.coalesce(F.lower(content_type).contains("application/pdf"), F.lit(False))


def pdf_response_error(content_type: Column | str) -> Column:
    """Null for a PDF, else the message the download log records."""
    kind = F.coalesce(F.lower(content_type), F.lit(""))
    # Fixed value: the message as it stands in existing download logs.
    message = F.concat(F.lit("Not a PDF (content-type: "), kind, F.lit(")"))
    return F.when(~is_pdf_response(content_type), message)

"""The PDF download log as a table."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.functions.http import pdf_response_error
from lodestone.functions.times import as_ntz
from lodestone.functions.urls import url_hash


def pdf_manifest(attempts: DataFrame, run_ts: Column | datetime | str) -> DataFrame:
    """Result of each attempt (url, content_type, error): a file name or an error."""
    error = F.coalesce("error", pdf_response_error("content_type"))
    return attempts.select(
        "url",
        F.when(error.isNull(), F.concat(url_hash("url"), F.lit(".pdf"))).alias("filename"),
        error.alias("error"),
        as_ntz(run_ts).alias("timestamp"),
    )


def manifest_counts(manifest: DataFrame) -> DataFrame:
    return manifest.agg(
        F.count_if(F.col("error").isNull()).alias("pdfs_found"),
        F.count_if(F.col("error").isNotNull()).alias("errors"),
    )

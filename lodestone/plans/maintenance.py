"""Repairing and resetting the tables of a corpus."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone import schemas
from lodestone.operators import repair, status
from lodestone.plans.corpus_build import RECOVERED, Run
from lodestone.sources import json_files, tables


def recover_checkpoints(run: Run, folder: str) -> DataFrame:
    """Store the vectors of checkpoint files for known sources and mark those embedded.

    The next upload stage takes them along with those embedded since.
    Returns the sources no status row knows; their vectors are left alone.
    """
    before = run.status()
    found = repair.dedup_first(json_files.read_checkpoints(run.spark, folder))
    known = repair.known_sources(found, before)
    tables.append_results(schemas.conform(known, RECOVERED), run.path("recovered"), run.write_seq)
    stored = run.this_stage("recovered", RECOVERED)
    tables.write_status(repair.merge_checkpoints(before, stored), run.path("status"))
    return repair.unknown_sources(found, before)


def reset_to_chunked(run: Run) -> None:
    tables.write_status(status.reset_to_chunked(run.status()), run.path("status"))


def reset_failures(run: Run) -> None:
    """Empty the failure log: rows logged so far are not read any more."""
    start = run.spark.range(1).select(F.lit(run.write_seq).cast("bigint").alias("write_seq"))
    tables.write_table(start, run.path("failures_from"))

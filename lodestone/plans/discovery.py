"""Discovery over stored pages: parse once, keep the links, walk them."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession

from lodestone import schemas
from lodestone.operators import crawl, pages
from lodestone.sources import tables

LINK_BUCKETS = 64


def discover_site(
    spark: SparkSession,
    root: str,
    fetched: DataFrame,
    start_url: str,
    run_ts: datetime | str,
    max_depth: int = crawl.DEFAULT_MAX_DEPTH,
    buckets: int = LINK_BUCKETS,
) -> DataFrame:
    """URLs reachable from ``start_url``, stored with the header of the run.

    ``fetched`` is (url, status, content_type, html). Links of the pages that
    may lead on are extracted once and stored in ``buckets`` by linking page, so
    that each depth reads those of its frontier only.
    """
    leading = fetched.transform(pages.ok_pages).transform(pages.expandable_pages)
    links = pages.extract_links(leading.select("url", "html"), within_site=False)
    tables.write_table(crawl.by_source(links, buckets), f"{root}/links", "bucket")
    edges = tables.read_table(spark, f"{root}/links", schemas.LINK)
    found = crawl.discover(edges, fetched, start_url, run_ts, max_depth, buckets)
    tables.write_table(schemas.conform(found, schemas.DISCOVERED), f"{root}/discovered")
    header = crawl.discovery_run(spark, start_url, run_ts, max_depth)
    tables.write_table(header, f"{root}/discovery_run")
    return tables.read_table(spark, f"{root}/discovered", schemas.DISCOVERED)

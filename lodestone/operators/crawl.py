"""Breadth-first discovery over a link table."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.functions.http import is_html_response
from lodestone.functions.times import as_ntz
from lodestone.functions.urls import is_pdf_url, same_domain, url_domain
from lodestone.session import stored

DEFAULT_MAX_DEPTH = 2


def link_bucket(url: Column | str, buckets: int) -> Column:
    """The bucket of a linking page."""
    return F.pmod(F.xxhash64(url), F.lit(buckets)).cast("int")


def by_source(edges: DataFrame, buckets: int) -> DataFrame:
    """Distinct edges with the ``bucket`` of their source, to be written partitioned by it.

    Ranges run over bucket, source and target: a bucket lies in few files, which are
    in the order of their sources, and a page with very many links spans several tasks.
    """
    order = ["bucket", "src", "dst"]
    dealt = edges.select("src", "dst").distinct().withColumn("bucket", link_bucket("src", buckets))
    return dealt.repartitionByRange(*order).sortWithinPartitions(*order)


def links_of(edges: DataFrame, leading: DataFrame, buckets: int | None) -> DataFrame:
    """Edges that start at one of the ``leading`` (url), distinct URLs.

    Of edges partitioned by bucket only the buckets of these pages are read; at most
    ``buckets`` numbers pass through the driver to say which.
    """
    if buckets:
        rows = leading.select(link_bucket("url", buckets).alias("bucket")).distinct().collect()
        edges = edges.filter(F.col("bucket").isin([r["bucket"] for r in rows]))
    return edges.join(leading, edges["src"] == leading["url"], "left_semi")


def discover(
    edges: DataFrame,
    pages: DataFrame,
    start_url: str,
    run_ts: datetime | str | Column,
    max_depth: int = DEFAULT_MAX_DEPTH,
    buckets: int | None = None,
) -> DataFrame:
    """URLs reachable from ``start_url`` in at most ``max_depth`` links.

    ``edges`` is (src, dst), and ``bucket`` if they are stored in that many ``buckets``
    (see ``by_source``): each depth then reads those of its frontier. ``pages`` is
    (url, status, content_type). A URL is listed once, at its least depth, when its
    page answered 200. Only HTML pages lead on, and only to the start URL's domain. A
    URL without a page, or with another status, counts as visited but is not listed.

    One round of joins per depth: the frontier meets the link table on the
    linking page, targets are reduced to distinct URLs on the map side, and
    those seen before are removed by an anti join. AQE broadcasts a frontier it
    has measured as small and splits a link-rich page's join partition. Each
    frontier is checkpointed, so the plan does not grow with depth.
    """
    spark = edges.sparkSession
    domain = spark.range(1).select(url_domain(F.lit(start_url)).alias("d")).first()["d"]
    onward = edges.filter(same_domain("dst", domain))

    def fetched(frontier: DataFrame, depth: int) -> DataFrame:
        known = frontier.join(pages.select("url", "status", "content_type"), "url", "left")
        # A fetch that was tried again has several rows; one answer of 200 is enough.
        good = F.coalesce(F.col("status") == 200, F.lit(False))
        return stored(
            known.groupBy("url")
            .agg(
                F.bool_or(good).alias("listed"),
                F.bool_or(good & is_html_response("content_type")).alias("is_html"),
            )
            .withColumn("depth", F.lit(depth))
        )

    level = fetched(spark.range(1).select(F.lit(start_url).alias("url")), 0)
    visited = level
    for depth in range(1, max_depth + 1):
        leading = level.filter("listed and is_html").select("url")
        fresh = links_of(onward, leading, buckets).select(F.col("dst").alias("url")).distinct()
        level = fetched(fresh.join(visited.select("url"), "url", "left_anti"), depth)
        if level.isEmpty():
            break
        visited = visited.unionByName(level)
    return visited.filter("listed").select(
        "url", "depth", is_pdf_url("url").alias("is_pdf"), as_ntz(run_ts).alias("discovered_at")
    )


def discovery_run(
    spark: SparkSession,
    start_url: str,
    run_ts: datetime | str | Column,
    max_depth: int = DEFAULT_MAX_DEPTH,
) -> DataFrame:
    """The header row of a discovery run."""
    return spark.range(1).select(
        F.lit(start_url).alias("start_url"),
        F.lit(max_depth).alias("max_depth"),
        url_domain(F.lit(start_url)).alias("domain"),
        as_ntz(run_ts).alias("discovery_time"),
    )

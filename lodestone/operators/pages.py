"""From fetched pages to text documents and link edges."""

from __future__ import annotations

from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.functions.http import is_html_response
from lodestone.functions.markup import CONTENT_IDS, PageReader, resolve_links
from lodestone.functions.text import strip
from lodestone.functions.urls import classify_document, same_domain, url_domain

_PARTS = "struct<title:string,body:string,links:array<string>,error:string>"

# Pages per PDF-text block, see pages_to_document.
PAGES_PER_BLOCK = 64


def _page_parts(content_ids: Sequence[str]):
    ids = tuple(content_ids)

    def parts(url: pa.Array, html: pa.Array) -> pa.Array:
        rows = []
        for page_url, page in zip(url.to_pylist(), html.to_pylist()):
            try:
                page_read = PageReader(ids).read(page or "")
                rows.append(
                    {
                        "title": page_read.title(),
                        "body": page_read.body(),
                        "links": resolve_links(page_url or "", page_read.hrefs),
                        "error": None,
                    }
                )
            except (AssertionError, ValueError, RecursionError) as problem:
                rows.append({"title": None, "body": None, "links": None, "error": str(problem)})
        text = pa.string()
        fields = [("title", text), ("body", text), ("links", pa.list_(text)), ("error", text)]
        return pa.array(rows, type=pa.struct(fields))

    # Declared non-deterministic so that the optimizer neither repeats the call for
    # a filter on its result nor moves it below a repartition.
    return F.arrow_udf(parts, _PARTS).asNondeterministic()


def parse_pages(pages: DataFrame, content_ids: Sequence[str] = CONTENT_IDS) -> DataFrame:
    """Add title, body, links and error from one parse of the ``html`` column.

    Only ``url`` and ``html`` travel through Python; every other column stays
    in the JVM. Keep the result (a stage table) when both text and links are
    wanted, so that a page is parsed once.
    """
    parsed = pages.withColumn("_parts", _page_parts(content_ids)(F.col("url"), F.col("html")))
    kept = [c for c in pages.columns if c != "html"]
    return parsed.select(*kept, "_parts.title", "_parts.body", "_parts.links", "_parts.error")


def page_text(title: Column, body: Column) -> Column:
    heading = F.when(title != "", F.concat(F.lit("Title: "), title))
    return F.concat_ws("\n\n", heading, body)


def extract_page_text(pages: DataFrame, content_ids: Sequence[str] = CONTENT_IDS) -> DataFrame:
    """Text documents of HTML pages; columns of ``pages`` other than html are kept."""
    parsed = parse_pages(pages, content_ids).filter(F.col("error").isNull())
    kept = [c for c in pages.columns if c not in ("html", "text", "type")]
    return parsed.select(
        *kept,
        page_text(F.col("title"), F.col("body")).alias("text"),
        classify_document("url").alias("type"),
    )


def extract_title(pages: DataFrame) -> DataFrame:
    return parse_pages(pages).select("url", "title")


def extract_links(pages: DataFrame, within_site: bool = True) -> DataFrame:
    """Link edges, one row per occurrence, to pages of the same domain."""
    edges = parse_pages(pages).select(F.col("url").alias("src"), F.explode("links").alias("dst"))
    return edges.transform(keep_within_site) if within_site else edges


def keep_within_site(edges: DataFrame) -> DataFrame:
    return edges.filter(same_domain("dst", url_domain("src")))


def page_errors(parsed: DataFrame) -> DataFrame:
    """Failure rows of pages that could not be parsed."""
    failed = parsed.filter(F.col("error").isNotNull())
    return failed.select("url", "error", F.lit("scraping").alias("stage"))


def ok_pages(fetches: DataFrame) -> DataFrame:
    return fetches.filter(F.col("status") == 200)


def expandable_pages(fetches: DataFrame) -> DataFrame:
    return fetches.filter(is_html_response("content_type"))


def number_pages(page_texts: DataFrame) -> DataFrame:
    """One row per PDF page from ``path, texts array<string>``, numbered from 1."""
    rows = page_texts.select("path", F.posexplode("texts").alias("pos", "text"))
    return rows.select("path", (F.col("pos") + 1).alias("page"), "text")


def drop_empty_pages(pages: DataFrame) -> DataFrame:
    """Numbers are given before this filter, so they keep their gaps."""
    return pages.filter(F.col("text") != "")


def pages_to_document(pages: DataFrame) -> DataFrame:
    """Page texts of each path in page order, joined without separator, trimmed.

    Pages are first joined in blocks of neighbours, so that a path with very
    many pages is put together by many tasks; the last step joins only the
    blocks, already strings, of each path.
    """
    by_page = F.array_sort(F.collect_list(F.struct("page", F.coalesce("text", F.lit("")).alias("text"))))
    blocks = pages.groupBy("path", F.floor(F.col("page") / PAGES_PER_BLOCK).alias("block")).agg(
        F.array_join(F.transform(by_page, lambda p: p["text"]), "").alias("text")
    )
    by_block = F.array_sort(F.collect_list(F.struct("block", "text")))
    joined = F.array_join(F.transform(by_block, lambda b: b["text"]), "")
    return blocks.groupBy("path").agg(strip(joined).alias("text"))


def pages_as_documents(pages: DataFrame) -> DataFrame:
    """One document per PDF page; the page number is kept."""
    return drop_empty_pages(pages).select(
        F.col("path").alias("url"), "text", F.lit("pdf").alias("type"), "page"
    )

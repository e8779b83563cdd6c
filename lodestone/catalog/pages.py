"""Pages: URLs, text, links, headers, PDF pages, discovery."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestone.catalog.frames import (
    FETCHES_INPUT,
    RUN_TS,
    base_path_sql,
    from_sql,
    load,
    stamp,
    stamp_sql,
    trim_sql,
)
from lodestone.functions import http, urls
from lodestone.operators import crawl, manifest, pages
from lodestone.session import spread, stored

_SITE = "blog.ththan.example.net"
_START = "https://g.example/s/1"


def url_features(spark, sf):
    return load(spark, sf, "pages").select(
        "page_id",
        urls.url_domain("url").alias("domain"),
        urls.same_domain("url", _SITE).alias("on_site"),
        urls.is_pdf_url("url").alias("is_pdf"),
        urls.url_hash("url").alias("url_hash"),
        urls.base_path("url").alias("base_path"),
        urls.classify_document("url").alias("type"),
    )


def _html(spark, sf):
    return spread(load(spark, sf, "pages"))


def page_title(spark, sf):
    return pages.extract_title(_html(spark, sf))


def page_links(spark, sf):
    return pages.extract_links(_html(spark, sf))


def page_text(spark, sf):
    return pages.extract_page_text(_html(spark, sf)).select("page_id", "url", "type", "text")


def http_metadata(spark, sf):
    fetches = from_sql(spark, sf, FETCHES_INPUT)
    header = (
        F.when(F.col("event_type") == "view", F.lit(None))
        .when(F.col("event_type") == "error", F.lit("yesterday"))
        .otherwise(F.concat(F.date_format("ts", "EEE, dd MMM yyyy HH:mm:ss"), F.lit(" GMT")))
    )
    meta = http.http_metadata("url", header, "etag", "content_type", "content_length", RUN_TS)
    return fetches.select(meta.alias("m")).select(
        "m.url",
        stamp("m.last_modified").alias("last_modified"),
        "m.etag",
        "m.content_type",
        "m.content_length",
        stamp("m.scraped_at").alias("scraped_at"),
    )


def ok_pages(spark, sf):
    return pages.ok_pages(from_sql(spark, sf, FETCHES_INPUT)).select("url", "content_type")


def expandable_pages(spark, sf):
    fetches = from_sql(spark, sf, FETCHES_INPUT)
    return fetches.transform(pages.ok_pages).transform(pages.expandable_pages).select("url")


def pdf_manifest(spark, sf):
    rows = manifest.pdf_manifest(from_sql(spark, sf, FETCHES_INPUT), RUN_TS)
    return rows.withColumn("timestamp", stamp("timestamp"))


def manifest_counts(spark, sf):
    return manifest.manifest_counts(manifest.pdf_manifest(from_sql(spark, sf, FETCHES_INPUT), RUN_TS))


def _pdf_pages(spark, sf):
    """Conversations as PDFs, their turns as pages; system turns are blank pages."""
    return load(spark, sf, "conversations").select(
        F.concat(F.lit("data/pdfs/"), "conv_id", F.lit(".pdf")).alias("path"),
        (F.col("turn") + 1).cast("int").alias("page"),
        F.when(F.col("role") != "system", F.col("text")).otherwise("").alias("text"),
    )


def pages_to_document(spark, sf):
    return pages.pages_to_document(_pdf_pages(spark, sf))


def pages_as_documents(spark, sf):
    return pages.pages_as_documents(_pdf_pages(spark, sf))


def number_pages(spark, sf):
    """Pages of each conversation numbered from an array of page texts."""
    by_turn = F.array_sort(F.collect_list(F.struct("page", "text")))
    texts = _pdf_pages(spark, sf).groupBy("path").agg(
        F.transform(by_turn, lambda p: p["text"]).alias("texts")
    )
    return pages.drop_empty_pages(pages.number_pages(texts))


_NODES = """
    select case when s_nationkey >= 20 and s_suppkey > 1 then 'https://other.example/s/' else 'https://g.example/s/' end
               || s_suppkey as url, 200 as status, 'text/html' as content_type, 's' || s_suppkey as node
    from supplier
    union all
    select 'https://g.example/p/' || p_partkey as url,
           case when p_size > 45 then 404 else 200 end as status,
           case when p_size < 5 then 'application/pdf' else 'text/html; charset=utf-8' end as content_type,
           'p' || p_partkey as node
    from part"""


def _graph(spark, sf):
    nodes = from_sql(spark, sf, _NODES)
    lines = load(spark, sf, "lineitem")
    supplier = F.concat(F.lit("s"), "l_suppkey").alias("a")
    part = F.concat(F.lit("p"), "l_partkey").alias("b")
    pairs = lines.select(supplier, part)
    both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
    names = nodes.select("node", "url")
    edges = (
        both.join(names.toDF("a", "src"), "a").join(names.toDF("b", "dst"), "b").select("src", "dst")
    )
    return edges, nodes


def discover_bfs(spark, sf):
    edges, nodes = _graph(spark, sf)
    # Discovery reads its link table once per depth, so it is stored first.
    found = crawl.discover(stored(edges), stored(nodes), _START, RUN_TS, max_depth=3)
    return found.withColumn("discovered_at", stamp("discovered_at"))


def discover_refetched(spark, sf):
    """A log in which every fetch failed first and good ones are listed twice; each URL comes once."""
    edges, nodes = _graph(spark, sf)
    failed = nodes.withColumn("status", F.lit(503))
    log = stored(nodes.unionByName(failed).unionByName(nodes))
    found = crawl.discover(stored(edges), log, _START, RUN_TS, max_depth=3)
    return found.withColumn("discovered_at", stamp("discovered_at"))


def discover_page_links(spark, sf):
    """Discovery over the links of the page table, from its first home page."""
    html = _html(spark, sf)
    links = stored(pages.extract_links(html))
    # Every linked URL answers; pages of the table lead on, the others are leaves.
    targets = links.select(F.col("dst").alias("url"), F.lit("text/plain").alias("content_type")).distinct()
    known = html.select("url", F.lit("text/html").alias("content_type"))
    fetched = known.unionByName(targets.join(known, "url", "left_anti")).withColumn("status", F.lit(200))
    start = load(spark, sf, "pages").agg(F.min("url")).first()[0]
    found = crawl.discover(links, fetched, start, RUN_TS)
    return found.select("url", "depth", "is_pdf")


def discovery_run(spark, sf):
    start = load(spark, sf, "pages").agg(F.min("url")).first()[0]
    run = crawl.discovery_run(spark, start, RUN_TS)
    return run.withColumn("discovery_time", stamp("discovery_time"))


QUERIES = {
    f.__name__: f
    for f in (
        url_features, page_title, page_links, page_text, http_metadata, ok_pages, expandable_pages,
        pdf_manifest, manifest_counts, pages_to_document, pages_as_documents, number_pages,
        discover_bfs, discover_refetched, discover_page_links, discovery_run,
    )
}

_DOMAIN = "regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)', 1)"


def _decoded(text: str) -> str:
    """Entities that occur in the page table, some cut short; the ampersand comes last."""
    for name, char in (("quot", "'\"'"), ("copy", "chr(169)"), ("middot", "chr(183)"), ("amp", "'&'")):
        text = f"regexp_replace({text}, '&{name}(?:;|\\b)', {char}, 'g')"
    return text


_TITLE = trim_sql(_decoded("regexp_extract(html, '<h1[^>]*>([^<]*)</h1>', 1)"))
_STRIPPED = r"regexp_replace(html, '(?s)<script.*?</script>|<style.*?</style>|<!--.*?-->|<![^>]*>', '<x>', 'g')"
_BODY = f"""array_to_string(list_filter(list_transform(
    string_split_regex({_STRIPPED}, '<[^>]*>'), lambda s: {trim_sql(_decoded("s"))}),
    lambda s: s <> ''), ' ')"""
_LINKS = f"""
    select url as src, regexp_extract(url, '^[a-z]+://[^/?#]*', 0) || {_decoded("href")} as dst
    from (select url, unnest(regexp_extract_all(html, '<a href="([^"]*)"', 1)) as href from pages)"""
_PDF_PAGES = """
    select 'data/pdfs/' || conv_id || '.pdf' as path, (turn + 1)::integer as page,
           case when role <> 'system' then text else '' end as text from conversations"""

ORACLES = {
    "url_features": f"""
        select page_id, {_DOMAIN} as domain, {_DOMAIN} = '{_SITE}' as on_site,
               contains(lower(url), '.pdf') or contains(lower(url), '/pdf/')
                   or contains(lower(url), 'application/pdf') as is_pdf,
               md5(url) as url_hash, {base_path_sql("url")} as base_path,
               case when contains(lower(url), '.pdf') or contains(lower(url), '/pdf/')
                   or contains(lower(url), 'application/pdf') then 'pdf' else 'html' end as type
        from pages""",
    "page_title": f"select url, {_TITLE} as title from pages",
    "page_links": _LINKS,
    "page_text": f"""
        select page_id, url, 'html' as type,
               case when t <> '' then 'Title: ' || t || chr(10) || chr(10) else '' end || body as text
        from (select page_id, url, {_TITLE} as t, {_BODY} as body from pages)""",
    "http_metadata": f"""
        with f as ({FETCHES_INPUT})
        select url,
               {stamp_sql(f"case when event_type in ('view', 'error') then timestamp '{RUN_TS}' else date_trunc('second', ts) end")}
                   as last_modified,
               etag, content_type, try_cast(content_length as bigint) as content_length,
               '{RUN_TS}' as scraped_at
        from f""",
    "ok_pages": f"select url, content_type from ({FETCHES_INPUT}) where status = 200",
    "expandable_pages": f"""
        select url from ({FETCHES_INPUT}) where status = 200 and contains(content_type, 'text/html')""",
    "pdf_manifest": f"""
        with f as ({FETCHES_INPUT}), r as (
            select url, coalesce(error, case when coalesce(contains(lower(content_type), 'application/pdf'), false)
                then null else 'Not a PDF (content-type: ' || coalesce(lower(content_type), '') || ')' end) as error
            from f)
        select url, case when error is null then md5(url) || '.pdf' end as filename, error,
               '{RUN_TS}' as timestamp from r""",
    "manifest_counts": f"""
        select count(*) filter (event_type = 'purchase') as pdfs_found,
               count(*) filter (event_type <> 'purchase') as errors from ({FETCHES_INPUT})""",
    "pages_to_document": f"""
        select path, {trim_sql("string_agg(text, '' order by page)")} as text from ({_PDF_PAGES}) group by path""",
    "pages_as_documents": f"""
        select path as url, text, 'pdf' as type, page from ({_PDF_PAGES}) where text <> ''""",
    "number_pages": f"""
        select path, page, text from (
            select path, text, (row_number() over (partition by path order by page, text))::integer as page
            from ({_PDF_PAGES})) where text <> ''""",
    "discover_bfs": f"""
        with recursive nodes as ({_NODES}),
        pairs as (select 's' || l_suppkey as a, 'p' || l_partkey as b from lineitem
                  union all select 'p' || l_partkey, 's' || l_suppkey from lineitem),
        edges as (select distinct x.url as src, y.url as dst
                  from pairs join nodes x on x.node = a join nodes y on y.node = b
                  where starts_with(y.url, 'https://g.example/')),
        reach(url, depth) as (
            select '{_START}', 0
            union
            select e.dst, r.depth + 1
            from reach r
            join nodes n on n.url = r.url and n.status = 200 and contains(n.content_type, 'text/html')
            join edges e on e.src = r.url
            where r.depth < 3)
        select r.url, min(r.depth) as depth, contains(r.url, '.pdf') as is_pdf, '{RUN_TS}' as discovered_at
        from reach r join nodes n on n.url = r.url and n.status = 200 group by r.url""",
    "discover_page_links": f"""
        with recursive start as (select min(url) as url from pages),
        edges as (select distinct src, dst from ({_LINKS})),
        reach(url, depth) as (
            select url, 0 from start
            union
            select e.dst, r.depth + 1 from reach r join pages p on p.url = r.url
            join edges e on e.src = r.url where r.depth < 2)
        select url, min(depth) as depth, contains(lower(url), '.pdf') or contains(lower(url), '/pdf/') as is_pdf
        from reach group by url""",
    "discovery_run": f"""
        select url as start_url, 2 as max_depth, {_DOMAIN} as domain, '{RUN_TS}' as discovery_time
        from (select min(url) as url from pages)""",
}
ORACLES["discover_refetched"] = ORACLES["discover_bfs"]

"""The status table: gates, transitions, reports, repair."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestone.catalog.frames import (
    CHECKPOINT_INPUT,
    DISCOVERED_INPUT,
    FAILURES_INPUT,
    RESULTS_INPUT,
    RUN_TS,
    STATUS_INPUT,
    from_sql,
    load,
    stamp,
    stamp_sql,
)
from lodestone.functions.times import as_ntz
from lodestone.operators import repair
from lodestone.operators import status as st
from lodestone.plans.report import status_report
from lodestone.session import scratch_path
from lodestone.sources import json_files, tables


def _status(spark, sf):
    return from_sql(spark, sf, STATUS_INPUT)


def _discovered(spark, sf):
    return from_sql(spark, sf, DISCOVERED_INPUT)


def _results(spark, sf):
    return from_sql(spark, sf, RESULTS_INPUT)


def _shown(status):
    return status.select(
        "url", "status", "stage", "error", "chunks_count", "embeddings_count",
        stamp("last_updated").alias("last_updated"),
    )


def _shown_failures(failures):
    return failures.select("url", "error", "stage", stamp("timestamp").alias("timestamp"))


def stage_gate(spark, sf):
    """URLs ready for each stage."""
    frames = [
        st.stage_gate(_discovered(spark, sf), _status(spark, sf), stage).withColumn("due", F.lit(stage))
        for stage in st.READY
    ]
    union = frames[0]
    for frame in frames[1:]:
        union = union.unionByName(frame)
    return union


def missing_content(spark, sf):
    ready = st.stage_gate(_discovered(spark, sf), _status(spark, sf), "chunk")
    return st.missing_content(ready, _results(spark, sf))


def with_content(spark, sf):
    ready = st.stage_gate(_discovered(spark, sf), _status(spark, sf), "chunk")
    return st.with_content(ready, _results(spark, sf))


def reuse_completed(spark, sf):
    """Stored content of completed URLs and fresh content of the others."""
    content = load(spark, sf, "lineitem").select(
        F.concat(F.lit("https://h.example/o/"), "l_orderkey").alias("url"), "l_linenumber", "l_returnflag"
    )
    stored = content.filter("l_returnflag = 'N'").withColumn("origin", F.lit("stored"))
    fresh = content.withColumn("origin", F.lit("fresh"))
    return st.reuse_completed(_discovered(spark, sf), _status(spark, sf), stored, fresh)


def mark_scraped(spark, sf):
    return _shown(st.mark_scraped(_status(spark, sf), _discovered(spark, sf), _results(spark, sf)))


def scrape_failures(spark, sf):
    errors = from_sql(spark, sf, DISCOVERED_INPUT).select("url", F.lit("status 500").alias("error"))
    errors = errors.filter(F.col("url").contains("/c/"))
    return st.scrape_failures(
        _status(spark, sf), _discovered(spark, sf), _results(spark, sf), errors
    )


def init_pending(spark, sf):
    return _shown(st.init_pending(_status(spark, sf), _discovered(spark, sf)))


def mark_chunked(spark, sf):
    changed, _ = st.mark_chunked(_status(spark, sf), _discovered(spark, sf), _results(spark, sf), RUN_TS)
    return _shown(changed)


def chunking_failures(spark, sf):
    _, failed = st.mark_chunked(_status(spark, sf), _discovered(spark, sf), _results(spark, sf), RUN_TS)
    return _shown_failures(failed)


def mark_embedded(spark, sf):
    changed, _ = st.mark_embedded(_status(spark, sf), _discovered(spark, sf), _results(spark, sf), RUN_TS)
    return _shown(changed)


def embedding_failures(spark, sf):
    _, failed = st.mark_embedded(_status(spark, sf), _discovered(spark, sf), _results(spark, sf), RUN_TS)
    return _shown_failures(failed)


def mark_uploaded(spark, sf):
    changed, _ = st.mark_uploaded(_status(spark, sf), _discovered(spark, sf), _results(spark, sf))
    return _shown(changed)


def upload_failures(spark, sf):
    _, failed = st.mark_uploaded(_status(spark, sf), _discovered(spark, sf), _results(spark, sf))
    return _shown_failures(failed)


_PDF_RESULTS = """
    select 'https://h.example/o/' || l_orderkey as url, count(*) as chunks, count(*) * 2 as vectors,
           case when max(l_returnflag) = 'N' then null when max(l_linestatus) = 'F' then 'chunked'
                when sum(l_quantity) > 100 then 'embedded' else 'uploaded' end as reached,
           case when max(l_returnflag) = 'N' then 'no text in the file' when max(l_linestatus) = 'F'
                or sum(l_quantity) > 100 then 'stopped' end as error
    from lineitem group by l_orderkey"""


def mark_pdf_run(spark, sf):
    results = from_sql(spark, sf, _PDF_RESULTS)
    return _shown(st.mark_pdf_run(_status(spark, sf), _discovered(spark, sf), results, RUN_TS))


def reset_to_chunked(spark, sf):
    return _shown(st.reset_to_chunked(_status(spark, sf)))


def reset_failures(spark, sf):
    """A log with failures, then emptied."""
    path = scratch_path(spark, "failures")
    tables.write_table(from_sql(spark, sf, FAILURES_INPUT).drop("write_seq"), path)
    tables.write_table(st.reset_failures(spark), path)
    return _shown_failures(tables.read_table(spark, path, "url string, error string, stage string, timestamp timestamp_ntz"))


def stage_counts(spark, sf):
    return st.stage_counts(_status(spark, sf))


def status_counts(spark, sf):
    return st.status_counts(_status(spark, sf))


def _report(spark, sf):
    return status_report(_discovered(spark, sf), _status(spark, sf), from_sql(spark, sf, FAILURES_INPUT))


def totals(spark, sf):
    return _report(spark, sf)["totals"]


def processing_rate(spark, sf):
    rate = _report(spark, sf)["processing_rate"]
    return rate.select(
        "completed", stamp("earliest").alias("earliest"), stamp("latest").alias("latest"),
        F.round("urls_per_hour", 6).alias("urls_per_hour"),
    )


def event_rate(spark, sf):
    """Rate over events as completed work, to the microsecond."""
    events = load(spark, sf, "events").select(
        F.lit("completed").alias("status"), F.col("ts").alias("last_updated")
    )
    return st.processing_rate(events).select("completed", F.round("urls_per_hour", 6).alias("urls_per_hour"))


def first_and_last_update(spark, sf):
    return st.first_and_last_update(_status(spark, sf))


def recent_failures(spark, sf):
    failures = st.recent_failures(from_sql(spark, sf, FAILURES_INPUT))
    return _shown_failures(failures)


def undated_failures_last(spark, sf):
    """All failures but the two newest are undated; ties come in log order."""
    failures = from_sql(spark, sf, FAILURES_INPUT)
    newest = failures.agg(F.max("timestamp").alias("m")).first()["m"]
    undated = failures.withColumn(
        "timestamp", F.when(F.col("timestamp") >= as_ntz(newest), F.col("timestamp"))
    )
    return _shown_failures(st.recent_failures(undated, n=5)).select("url", "error", "timestamp")


def status_table(spark, sf):
    """Two versions of the status table; the newest is read back."""
    path = scratch_path(spark, "status")
    tables.write_status(_status(spark, sf), path)
    tables.write_status(st.reset_to_chunked(tables.read_status(spark, path)), path)
    return _shown(tables.read_status(spark, path))


def failure_log(spark, sf):
    """Failures appended in two runs, the second of them repeated."""
    path = scratch_path(spark, "failure-log")
    failures = from_sql(spark, sf, FAILURES_INPUT)
    tables.append_failures(failures, path, write_seq=1)
    for _ in range(2):
        tables.append_failures(failures.filter("timestamp is null"), path, write_seq=2)
    stored = tables.read_failures(spark, path)
    return stored.groupBy("write_seq").agg(
        F.count("*").alias("n"), F.count("timestamp").alias("dated")
    )


def _checkpoints(spark, sf):
    rows = from_sql(spark, sf, CHECKPOINT_INPUT)
    return rows.select(
        F.col("checkpoint_no").cast("bigint").alias("checkpoint_no"),
        "pos",
        "id",
        F.array(F.col("pos").cast("float")).alias("values"),
        F.struct("source").alias("metadata"),
    )


def latest_checkpoint(spark, sf):
    newest = repair.latest_checkpoint(_checkpoints(spark, sf))
    return newest.select("checkpoint_no", "pos", "id", F.col("metadata.source").alias("source"))


def dedup_first(spark, sf):
    first = repair.dedup_first(_checkpoints(spark, sf))
    value = F.element_at("values", 1).cast("bigint").alias("value")
    return first.select("source", "id", "checkpoint_no", "pos", value)


def checkpoint_files(spark, sf):
    """Events as vectors in three numbered checkpoints, written and read back: the first one per source and id."""
    folder = scratch_path(spark, "checkpoints")
    rows = _checkpoints(spark, sf).withColumns(
        {
            "values": F.array((F.col("pos") % 1000).cast("float"), F.lit(0.5).cast("float")),
            "metadata": F.struct(
                F.col("metadata.source").alias("source"),
                F.lit("html").alias("type"),
                F.lit(0).alias("depth"),
                F.lit(RUN_TS).cast("timestamp_ntz").alias("last_modified"),
                F.concat(F.lit('"é" '), F.col("pos").cast("string")).alias("text"),
            ),
        }
    )
    for number, days in ((9, (1, 10)), (10, (11, 20)), (100, (21, 31))):
        json_files.write_checkpoint(rows.filter(F.col("checkpoint_no").between(*days)), folder, number, "pos")
    first = repair.dedup_first(json_files.read_checkpoints(spark, folder))
    return first.select(
        "source", "id", "checkpoint_no", F.element_at("values", 1).cast("bigint").alias("value"),
        F.col("metadata.text").alias("text"), stamp("metadata.last_modified").alias("last_modified"),
    )


def known_sources(spark, sf):
    first = repair.dedup_first(_checkpoints(spark, sf))
    return repair.known_sources(first, _status(spark, sf)).select("source", "id")


def unknown_sources(spark, sf):
    first = repair.dedup_first(_checkpoints(spark, sf))
    return repair.unknown_sources(first, _status(spark, sf))


def merge_checkpoints(spark, sf):
    first = repair.dedup_first(_checkpoints(spark, sf))
    status = _status(spark, sf)
    errors = status.filter("status = 'failed'").select("url", F.lit("disk full").alias("error"))
    return _shown(repair.merge_checkpoints(status, first, errors))


_FOUND = """
    select 'https://h.example/e/' || event_id as url, cast(extract(day from ts) as int) as depth,
           event_type = 'purchase' as is_pdf, case when event_type <> 'view' then ts end as discovered_at
    from events"""


def json_status(spark, sf):
    """The status table written as JSON objects keyed by URL, and read back."""
    path = scratch_path(spark, "status-json")
    json_files.write_status_json(_status(spark, sf), path)
    return _shown(json_files.read_status_json(spark, path))


def json_failures(spark, sf):
    path = scratch_path(spark, "failures-json")
    json_files.write_failures_json(from_sql(spark, sf, FAILURES_INPUT), path)
    return _shown_failures(json_files.read_failures_json(spark, path))


def json_discovered(spark, sf):
    """URLs with the header of their run in every file; both are read back."""
    path = scratch_path(spark, "discovered-json")
    run = spark.range(1).select(
        F.lit("https://h.example/").alias("start_url"), F.lit(2).alias("max_depth"),
        F.lit("h.example").alias("domain"), as_ntz(RUN_TS).alias("discovery_time"),
    )
    json_files.write_discovered(from_sql(spark, sf, _FOUND), run, path)
    header = json_files.read_discovery_run(spark, path).distinct()
    found = json_files.read_discovered(spark, path)
    when = F.date_format("discovered_at", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("discovered_at")
    return found.crossJoin(F.broadcast(header.limit(1))).select(
        "url", "depth", "is_pdf", when, "domain", "max_depth", stamp("discovery_time").alias("discovery_time")
    )


QUERIES = {
    f.__name__: f
    for f in (
        stage_gate, missing_content, with_content, reuse_completed, mark_scraped, scrape_failures,
        init_pending, mark_chunked, chunking_failures, mark_embedded, embedding_failures,
        mark_uploaded, upload_failures, mark_pdf_run, reset_to_chunked, reset_failures,
        stage_counts, status_counts, totals, processing_rate, event_rate, first_and_last_update,
        recent_failures, undated_failures_last, status_table, failure_log, latest_checkpoint,
        dedup_first, known_sources, unknown_sources, merge_checkpoints, json_status, json_failures,
        json_discovered, checkpoint_files,
    )
}

_T = f"""s as ({STATUS_INPUT}), d as ({DISCOVERED_INPUT}), r as ({RESULTS_INPUT})"""
_U = f"{stamp_sql('s.last_updated')} as last_updated"
_ROW = f"s.url, s.status, s.stage, s.error, s.chunks_count, s.embeddings_count, {_U}"


def _gate(stage: str, condition: str) -> str:
    return f"""select d.url, '{stage}' as due from d left join s using (url) where {condition}"""


_GATES = {
    "scrape": "s.status is distinct from 'completed'",
    "chunk": "s.stage = 'scraped'",
    "embed": "s.stage = 'chunked'",
    "upload": "s.stage = 'embedded'",
    "pdf": "not (s.status is not distinct from 'completed' and s.stage is not distinct from 'uploaded')",
}
_NEW = "select url from d where url not in (select url from s)"
_PENDING = f"""select url, 'pending' as status, 'discovered' as stage, null as error, null as chunks_count,
    null as embeddings_count, null as last_updated from ({_NEW})"""


def _advanced(stage_in: str, done: str, doing: str, count: str, absent: str, pending: bool) -> str:
    counts = {
        c: (f"case when hit and problem is null then coalesce(n, 0) else s.{c} end" if c == count else f"s.{c}")
        for c in ("chunks_count", "embeddings_count")
    }
    extra = f" union all {_PENDING}" if pending else ""
    return f"""
        with {_T}, o as (
            select s.*, r.n, s.stage = '{stage_in}' and s.url in (select url from d) as hit,
                   case when r.url is null then '{absent}' else r.error end as problem
            from s left join r using (url))
        select s.url,
               case when hit then case when problem is null then 'completed' else 'failed' end else s.status end as status,
               case when hit then case when problem is null then '{done}' else '{doing}' end else s.stage end as stage,
               case when hit then coalesce(problem, s.error) else s.error end as error,
               {counts["chunks_count"]} as chunks_count, {counts["embeddings_count"]} as embeddings_count,
               case when hit then '{RUN_TS}' else {stamp_sql("s.last_updated")} end as last_updated
        from o s{extra}"""


def _failed(stage_in: str, doing: str, absent: str) -> str:
    return f"""
        with {_T}
        select d.url, coalesce(r.error, '{absent}') as error, '{doing}' as stage, '{RUN_TS}' as timestamp
        from d join s using (url) left join r using (url)
        where s.stage = '{stage_in}' and (r.url is null or r.error is not null)"""


_CHUNK = ("scraped", "chunked", "chunking", "chunks_count", "no text to chunk", True)
_EMBED = ("chunked", "embedded", "embedding", "embeddings_count", "nothing to embed", False)
_FIRST = f"""
    c as ({CHECKPOINT_INPUT}),
    f as (select * exclude (rn) from (
        select *, row_number() over (partition by source, id order by checkpoint_no, pos) as rn
        from c where source is not null) where rn = 1)"""
_RESET = f"""
    select url, 'completed' as status, 'chunked' as stage,
           case when status = 'completed' and stage = 'chunked' then error end as error, chunks_count,
           case when status = 'completed' and stage = 'chunked' then embeddings_count end as embeddings_count,
           {stamp_sql("last_updated")} as last_updated from ({STATUS_INPUT})"""

ORACLES = {
    "stage_gate": f"with {_T} " + " union all ".join(_gate(*g) for g in _GATES.items()),
    "missing_content": f"""
        with {_T} select d.url from d join s using (url)
        where s.stage = 'scraped' and not exists (select 1 from r where r.url = d.url)""",
    "with_content": f"""
        with {_T} select d.url from d join s using (url)
        where s.stage = 'scraped' and exists (select 1 from r where r.url = d.url)""",
    "reuse_completed": f"""
        with {_T}, c as (select 'https://h.example/o/' || l_orderkey as url, l_linenumber, l_returnflag from lineitem)
        select c.*, 'stored' as origin from c join d using (url) join s using (url)
        where s.status = 'completed' and l_returnflag = 'N'
        union all
        select c.*, 'fresh' as origin from c join d using (url) left join s using (url)
        where s.status is distinct from 'completed'""",
    "mark_scraped": f"""
        with {_T}, h as (
            select d.url from d left join s using (url)
            where s.status is distinct from 'completed' and exists (select 1 from r where r.url = d.url))
        select url, 'completed' as status, 'scraped' as stage, null as error, null as chunks_count,
               null as embeddings_count, null as last_updated from h
        union all
        select {_ROW} from s where url not in (select url from h)""",
    "scrape_failures": f"""
        with {_T}
        select d.url, case when contains(d.url, '/c/') then 'status 500' else 'no content returned' end as error,
               'scraping' as stage
        from d left join s using (url)
        where s.status is distinct from 'completed' and not exists (select 1 from r where r.url = d.url)""",
    "init_pending": f"with {_T} select {_ROW} from s union all {_PENDING}",
    "mark_chunked": _advanced(*_CHUNK),
    "chunking_failures": _failed("scraped", "chunking", "no text to chunk"),
    "mark_embedded": _advanced(*_EMBED),
    "embedding_failures": _failed("chunked", "embedding", "nothing to embed"),
    "mark_uploaded": f"""
        with {_T}
        select s.url, s.status,
               case when s.stage = 'embedded' and r.url is not null and r.error is null
                         and s.url in (select url from d) then 'uploaded' else s.stage end as stage,
               s.error, s.chunks_count, s.embeddings_count, {_U}
        from s left join r using (url)""",
    "upload_failures": f"""
        with {_T}
        select d.url, r.error, 'uploading' as stage, cast(null as varchar) as timestamp
        from d join s using (url) join r using (url) where s.stage = 'embedded' and r.error is not null""",
    "mark_pdf_run": f"""
        with {_T}, p as ({_PDF_RESULTS}),
        t as (select url, status, stage, error, chunks_count, embeddings_count, {stamp_sql("last_updated")} as last_updated from s
              union all
              select url, 'pending', 'discovered', null, null, null, '{RUN_TS}' from ({_NEW})),
        o as (select t.*, p.chunks, p.vectors, p.reached, p.error as problem,
                     p.url is not null and t.url in (select url from d)
                     and not (t.status is not distinct from 'completed' and t.stage is not distinct from 'uploaded') as hit
              from t left join p using (url))
        select url, case when hit then case when problem is null then 'completed' else 'failed' end else status end as status,
               case when hit then coalesce(reached, stage) else stage end as stage,
               case when hit then coalesce(problem, error) else error end as error,
               case when hit and reached is not null then chunks else chunks_count end as chunks_count,
               case when hit and reached in ('embedded', 'uploaded') then vectors else embeddings_count end as embeddings_count,
               case when hit then '{RUN_TS}' else last_updated end as last_updated
        from o""",
    "reset_to_chunked": _RESET,
    "reset_failures": f"""
        select url, error, stage, {stamp_sql("timestamp")} as timestamp from ({FAILURES_INPUT}) where false""",
    "stage_counts": f"""
        select coalesce(stage, 'unknown') as stage, count(*) as n from ({STATUS_INPUT}) group by 1""",
    "status_counts": f"""
        select coalesce(status, 'unknown') as status, count(*) as n from ({STATUS_INPUT}) group by 1""",
    "totals": f"""
        with {_T} select (select count(*) from d) as discovered, (select count(*) from s) as tracked,
               (select count(*) from s where stage = 'embedded') as embedded,
               (select count(*) from ({FAILURES_INPUT})) as failed""",
    "processing_rate": f"""
        with {_T}, x as (
            select count(*) as completed, min(last_updated) as a, max(last_updated) as b
            from s where status = 'completed' and last_updated is not null)
        select completed, {stamp_sql("a")} as earliest, {stamp_sql("b")} as latest,
               round(case when b > a then completed / (date_diff('microsecond', a, b) / 1e6) * 3600 end, 6) as urls_per_hour
        from x""",
    "event_rate": """
        select count(*) as completed,
               round(count(*) / (date_diff('microsecond', min(ts), max(ts)) / 1e6) * 3600, 6) as urls_per_hour
        from events""",
    "first_and_last_update": f"""
        with {_T}, x as (select * from s where status = 'completed' and last_updated is not null)
        select (select url from x order by last_updated, url limit 1) as first_url,
               (select url from x order by last_updated desc, url limit 1) as last_url""",
    "recent_failures": f"""
        with x as ({FAILURES_INPUT})
        select url, error, stage, {stamp_sql("x.timestamp")} as timestamp
        from x order by x.timestamp desc nulls last, write_seq limit 5""",
    "undated_failures_last": f"""
        with x as ({FAILURES_INPUT}), y as (
            select *, case when timestamp >= (select max(timestamp) from x) then timestamp end as t from x)
        select url, error, {stamp_sql("t")} as timestamp from y order by t desc nulls last, write_seq limit 5""",
    "status_table": _RESET,
    "failure_log": f"""
        with x as ({FAILURES_INPUT})
        select 1::bigint as write_seq, count(*) as n, count(timestamp) as dated from x
        union all select 2, count(*), count(timestamp) from x where timestamp is null""",
    "latest_checkpoint": f"""
        with c as ({CHECKPOINT_INPUT})
        select checkpoint_no, pos, id, source from c where checkpoint_no = (select max(checkpoint_no) from c)""",
    "dedup_first": f"with {_FIRST} select source, id, checkpoint_no, pos, pos as value from f",
    "known_sources": f"with {_FIRST}, {_T} select source, id from f where source in (select url from s)",
    "unknown_sources": f"""
        with {_FIRST}, {_T} select distinct source from f where source not in (select url from s)""",
    "merge_checkpoints": f"""
        with {_FIRST}, {_T}, k as (select source as url, count(*) as n from f group by source)
        select s.url, case when k.url is null then s.status when s.status = 'failed' then 'failed'
                           else 'completed' end as status,
               case when k.url is not null and s.status is distinct from 'failed' then 'embedded' else s.stage end as stage,
               case when k.url is null then s.error when s.status = 'failed' then 'disk full' end as error,
               s.chunks_count,
               case when k.url is not null and s.status is distinct from 'failed' then k.n
                    else s.embeddings_count end as embeddings_count, {_U}
        from s left join k using (url)""",
}
ORACLES["json_status"] = f"with {_T} select {_ROW} from s"
ORACLES["json_failures"] = f"""
    select url, error, stage, {stamp_sql("timestamp")} as timestamp from ({FAILURES_INPUT})"""
ORACLES["json_discovered"] = f"""
    select url, depth, is_pdf, strftime(discovered_at, '%Y-%m-%d %H:%M:%S.%f') as discovered_at,
           'h.example' as domain, 2 as max_depth, '{RUN_TS}' as discovery_time from ({_FOUND})"""
ORACLES["checkpoint_files"] = f"""
    with c as (
        select source, id, pos, case when checkpoint_no <= 10 then 9 when checkpoint_no <= 20 then 10 else 100 end as checkpoint_no
        from ({CHECKPOINT_INPUT}) where source is not null),
    f as (select *, row_number() over (partition by source, id order by checkpoint_no, pos) as rn from c)
    select source, id, checkpoint_no, pos % 1000 as value, '"é" ' || pos as text, '{RUN_TS}' as last_modified
    from f where rn = 1"""

"""Documents: filters, merging, chunking."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestone.catalog.frames import (
    DOCS,
    RUN_TS,
    base_path_sql,
    documents,
    load,
    stamp,
    stamp_sql,
    trim_sql,
    words_sql,
)
from lodestone.functions.text import strip, word_count
from lodestone.functions.times import format_ts
from lodestone.operators import chunking, combine
from lodestone.session import scratch_path
from lodestone.sources import json_files, tables

_MIN_WORDS = 100


def word_counts(spark, sf):
    return documents(spark, sf).select("doc_id", word_count("text").alias("words"))


def stripped_text(spark, sf):
    return documents(spark, sf).select("doc_id", F.md5(strip("text")).alias("text_md5"))


def doc_filter_meta(spark, sf):
    """Defaults applied to the documents long enough to chunk; some fields left out."""
    docs = documents(spark, sf).select(
        "doc_id",
        F.when(F.col("lang") != "de", F.col("url")).alias("url"),
        "text",
        F.when(F.col("lang") != "fr", F.lit("pdf")).alias("type"),
        F.when(F.col("lang") == "en", F.length("lang")).alias("depth"),
        F.when(F.col("lang") == "es", F.lit(""))
        .when(F.col("lang") != "fr", F.col("last_modified").cast("string"))
        .alias("last_modified"),
    )
    kept = docs.transform(chunking.drop_short).transform(chunking.chunk_metadata, RUN_TS)
    return kept.select(
        "doc_id", "source", "type", "depth", stamp("last_modified").alias("last_modified")
    )


def _combined(spark, sf, **options):
    docs = documents(spark, sf)
    return combine.combine_small(docs, _MIN_WORDS, order_col="doc_id", **options).select(
        "url",
        "text",
        "type",
        F.array_join("sources", " ").alias("sources"),
        "combined",
        "base_path",
        stamp("last_modified").alias("last_modified"),
    )


def combine_small(spark, sf):
    return _combined(spark, sf)


def combine_keep_pending(spark, sf):
    return _combined(spark, sf, keep_pending=True)


def combine_report(spark, sf):
    return combine.combine_report(documents(spark, sf), _combined(spark, sf))


def combined_table(spark, sf):
    """Merged documents written as a table and read back."""
    path = scratch_path(spark, "combined")
    docs = documents(spark, sf)
    tables.write_combined(combine.combine_small(docs, _MIN_WORDS, order_col="doc_id"), path)
    stored = tables.read_combined(spark, path)
    return stored.groupBy("type", "combined").agg(
        F.count("*").alias("n"), F.sum(F.length("text")).alias("chars")
    )


def chunk_documents(spark, sf):
    chunks = chunking.chunk(documents(spark, sf), RUN_TS)
    return chunks.withColumn("last_modified", stamp("last_modified"))


def chunks_per_document(spark, sf):
    return chunking.chunks_per_document(chunking.chunk(documents(spark, sf), RUN_TS))


def _without_separators(spark, sf):
    bare = F.regexp_replace("text", r"[\s.!?,]", "_")
    return documents(spark, sf).withColumn("text", bare)


def chunk_fallback(spark, sf):
    """Documents with every separator replaced split into plain overlapping windows."""
    chunks = chunking.chunk(_without_separators(spark, sf), RUN_TS)
    return chunks.select("source", "chunk_index", "text")


def chunk_table(spark, sf):
    """Chunks written in two runs; the second replaces the German documents' chunks."""
    path = scratch_path(spark, "chunks")
    docs = documents(spark, sf)
    tables.write_chunks(chunking.chunk(docs, RUN_TS), path, write_seq=1)
    german = docs.filter("lang = 'de'").withColumn("text", F.concat_ws(" ", "text", "text"))
    tables.write_chunks(chunking.chunk(german, RUN_TS, min_chars=500), path, write_seq=2)
    return tables.read_chunks(spark, path).select("source", "chunk_index", "text")


def chunk_failures(spark, sf):
    """No document of the table fails to split."""
    split = chunking.split_documents(documents(spark, sf), RUN_TS)
    failures = chunking.chunk_failures(split, RUN_TS)
    return failures.withColumn("timestamp", stamp("timestamp"))


def event_times(spark, sf):
    return load(spark, sf, "events").select("event_id", format_ts("ts").alias("formatted"))


def json_documents(spark, sf):
    """Whole documents written as JSON, the English ones as arrays and the others wrapped, and read back."""
    path = scratch_path(spark, "documents-json")
    docs = documents(spark, sf)
    meta = F.struct(
        F.col("url"), F.col("last_modified"), F.lit("e-\"tag\"").alias("etag"), F.lit("text/html").alias("content_type"),
        F.col("n_chars").cast("bigint").alias("content_length"), F.lit(None).cast("timestamp_ntz").alias("scraped_at"),
    )
    rows = docs.select(
        "url", "text", "type", F.lit(1).alias("depth"), F.when(F.col("lang") != "fr", meta).alias("metadata"), "lang"
    )
    json_files.write_documents(rows.filter("lang = 'en'"), f"{path}/arrays")
    json_files.write_documents(rows.filter("lang <> 'en'"), f"{path}/wrapped", wrapped=True)
    back = json_files.read_documents(spark, f"{path}/*")
    return back.select(
        "url", "text", "type", "depth", stamp("metadata.last_modified").alias("last_modified"),
        "metadata.etag", "metadata.content_length",
    )


QUERIES = {
    f.__name__: f
    for f in (
        word_counts, stripped_text, doc_filter_meta, combine_small, combine_keep_pending,
        combine_report, combined_table, chunk_documents, chunks_per_document, chunk_fallback,
        chunk_table, chunk_failures, event_times, json_documents,
    )
}


def combine_ctes(min_words: int = _MIN_WORDS, docs: str = DOCS) -> str:
    """The fold over each section in URL order, one recursion step per document."""
    base = base_path_sql("url")
    return f"""
    {docs},
    counted as (
        select *, {base} as base, len({words_sql("text")}) as n_words,
               len({words_sql("'From ' || url || ':'")}) as heading,
               len({words_sql(f"'Combined content from ' || {base} || ':'")}) as intro,
               row_number() over (partition by {base} order by url, doc_id) as pos
        from docs),
    fold as (
        select base, pos, doc_id,
               case when n_words >= {min_words} then 0 else intro + heading + n_words end as total,
               case when n_words >= {min_words} then null else pos end as grp,
               cast(null as bigint) as given_up
        from counted where pos = 1
        union all
        select c.base, c.pos, c.doc_id,
               case when c.n_words >= {min_words} then 0
                    when f.total = 0 or f.total >= {min_words} then c.intro + c.heading + c.n_words
                    else f.total + c.heading + c.n_words end,
               case when c.n_words >= {min_words} then null
                    when f.total = 0 or f.total >= {min_words} then c.pos else f.grp end,
               case when c.n_words >= {min_words} and f.total > 0 and f.total < {min_words} then f.grp end
        from fold f join counted c on c.base = f.base and c.pos = f.pos + 1),
    lost as (select base, given_up as grp from fold where given_up is not null),
    members as (select f.base, f.grp, c.* exclude (base) from fold f join counted c using (doc_id)
                where f.grp is not null)"""


LOST = "exists (select 1 from lost l where l.base = m.base and l.grp = m.grp)"
MERGED_TEXT = (
    "'Combined content from ' || base || ':' || chr(10) || chr(10) || "
    "string_agg(chr(10) || 'From ' || url || ':' || chr(10) || text || chr(10), '' order by pos)"
)


def _merged_sql(keep_pending: bool) -> str:
    lost = "false" if keep_pending else LOST
    return f"""
        with recursive {combine_ctes()}
        select url, text, type, cast(null as varchar) as sources, false as combined,
               cast(null as varchar) as base_path, {stamp_sql("last_modified")} as last_modified
        from counted where n_words >= {_MIN_WORDS}
        union all
        select base as url,
               'Combined content from ' || base || ':' || chr(10) || chr(10) ||
               string_agg(chr(10) || 'From ' || url || ':' || chr(10) || text || chr(10), '' order by pos) as text,
               'combined' as type, string_agg(url, ' ' order by pos) as sources, true as combined,
               base as base_path, {stamp_sql("max(last_modified)")} as last_modified
        from members m where not {lost} group by base, grp"""


SPLIT_SIZE, SPLIT_OVERLAP = 500, 50
_SEPARATORS = ("chr(10) || chr(10)", "chr(10)", "'.'", "'!'", "'?'", "','", "' '", "''")


def chunk_ctes(docs: str, min_chars: int = 50) -> str:
    """Recursive splitting in SQL, from a relation (url, text) to ``chunks``.

    ``nodes`` are the stretches still to be split and the separator chosen for
    each; ``pieces`` what it splits them into; ``runs`` neighbouring short
    pieces; ``windows`` the greedy windows over a run's cut positions.
    """
    choice = " ".join(
        f"when lv <= {i} and contains(text, {s}) then {i}" for i, s in enumerate(_SEPARATORS[:-1], 1)
    )
    split = " ".join(f"when {i} then string_split(text, {s})" for i, s in enumerate(_SEPARATORS, 1))
    glue = " ".join(f"when {i} then {s}" for i, s in enumerate(_SEPARATORS, 1))
    parts = f"""
        select url, path, sep, i, piece, text from (
            select url, path, sep, text, unnest(range(1, len(raw) + 1)) as i,
                   unnest(list_transform(raw, lambda x, n: case when n = 1 then x else glue || x end)) as piece
            from (select url, path, sep, text, case sep {split} end as raw, case sep {glue} end as glue
                  from %s))
        where piece <> ''"""
    choose = "case " + choice + " else 8 end"
    return f"""
    kept as (select url, text from {docs} where length(text) >= {min_chars}),
    nodes(url, path, sep, text) as (
        select url, cast([] as integer[]), {choose}, text from (select url, text, 1 as lv from kept)
        union all
        select url, path, {choose}, text
        from (select url, list_append(path, i::integer) as path, sep + 1 as lv, piece as text
              from ({parts % "nodes"}) where sep < 8 and length(piece) >= {SPLIT_SIZE})),
    pieces as (select * exclude (text) from ({parts % "nodes"})),
    small as (
        select *, i - row_number() over (partition by url, path order by i) as run
        from pieces where length(piece) < {SPLIT_SIZE}),
    cum as (
        select url, path, run, i, piece,
               sum(length(piece)) over (partition by url, path, run order by i) as upto
        from small),
    runs as (
        select url, list_append(path, min(i)::integer) as key, string_agg(piece, '' order by i) as text,
               list_prepend(0, list(upto::bigint order by i)) as cuts
        from cum group by url, path, run),
    windows(url, key, text, cuts, f, e) as (
        select url, key, text, cuts, 1, len(list_filter(cuts, lambda x: x <= {SPLIT_SIZE})) from runs
        union all
        select url, key, text, cuts, f, len(list_filter(cuts, lambda x: x <= cuts[f] + {SPLIT_SIZE}))
        from (select url, key, text, cuts,
                     1 + len(list_filter(cuts, lambda x:
                         x < greatest(cuts[e] - {SPLIT_OVERLAP}, cuts[e + 1] - {SPLIT_SIZE}))) as f
              from windows where e < len(cuts))),
    trimmed as (
        select url, key, f, {trim_sql("substr(text, cuts[f] + 1, cuts[e] - cuts[f])")} as text from windows),
    chunks as (
        select url as source, (row_number() over (partition by url order by key, f) - 1)::integer as chunk_index, text
        from trimmed where text <> '')"""


CHUNK_ID = "sha256(c.source || chr(1) || c.chunk_index || chr(1) || c.text)"
_FALLBACK = """
        select url as source, i::integer as chunk_index, substr(text, 450 * i + 1, 500) as text
        from (select url, text, unnest(range(case when length(text) <= 500 then 1
                     else 1 + cast(ceil((length(text) - 500) / 450.0) as bigint) end)) as i
              from bare where length(text) >= 50)"""

ORACLES = {
    "word_counts": f"select doc_id, len({words_sql('text')}) as words from documents",
    "stripped_text": f"select doc_id, md5({trim_sql('text')}) as text_md5 from documents",
    "doc_filter_meta": f"""
        with {DOCS}
        select doc_id, case when lang <> 'de' then url else 'unknown' end as source,
               case when lang <> 'fr' then 'pdf' else 'html' end as type,
               case when lang = 'en' then 2 else 0 end as depth,
               {stamp_sql(f"case when lang in ('es', 'fr') then timestamp '{RUN_TS}' else last_modified end")}
                   as last_modified
        from docs where length(text) >= 50""",
    "combine_small": _merged_sql(False),
    "combine_keep_pending": _merged_sql(True),
    "combine_report": f"""
        select (select count(*) from documents) as documents_in, count(*) as documents_out
        from ({_merged_sql(False)})""",
    "combined_table": f"""
        select type, combined, count(*) as n, sum(length(text))::bigint as chars
        from ({_merged_sql(False)}) group by type, combined""",
    "chunk_documents": f"""
        with recursive {DOCS}, {chunk_ctes("docs")}
        select {CHUNK_ID} as chunk_id, c.source, chunk_index, c.text, 'html' as type, 0 as depth,
               {stamp_sql("d.last_modified")} as last_modified
        from chunks c join docs d on d.url = c.source""",
    "chunks_per_document": f"""
        with recursive {DOCS}, {chunk_ctes("docs")}
        select source, count(*) as chunks_count, count(*) > 100 as is_large from chunks group by source""",
    "chunk_fallback": f"""
        with {DOCS}, bare as (select url, regexp_replace(text, '[\\s\\x0b.!?,]', '_', 'g') as text from docs)
        {_FALLBACK}""",
    "chunk_table": f"""
        with recursive {DOCS},
        final as (
            select url, case when lang = 'de' and 2 * length(text) + 1 >= 500 then text || ' ' || text else text end as text
            from docs),
        {chunk_ctes("final")}
        select * from chunks""",
    "chunk_failures": f"""
        select url, text as error, 'chunking' as stage, '{RUN_TS}' as timestamp
        from (select '' as url, text from documents where text is null)""",
    "event_times": f"select event_id, {stamp_sql('ts')} as formatted from events",
}
ORACLES["json_documents"] = f"""
    with {DOCS}
    select url, text, type, 1 as depth, case when lang <> 'fr' then {stamp_sql("last_modified")} end as last_modified,
           case when lang <> 'fr' then 'e-"tag"' end as etag, case when lang <> 'fr' then n_chars end as content_length
    from docs where lang is not null"""

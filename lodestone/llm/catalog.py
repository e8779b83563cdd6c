"""The operators of this package as queries over the given tables, with SQL where it can say the same."""

from __future__ import annotations

import string

import public_tokenizers
from pyspark.sql import functions as F

import corpus_pipeline

from lodestone.catalog.frames import load
from lodestone.llm import (
    bpe,
    codes,
    exact,
    extract,
    language,
    merkle,
    mixing,
    neardup,
    packing,
    quality,
    sharding,
    topk,
    warc,
)
from lodestone.session import scratch_path

TOKENIZER = public_tokenizers.path("word_bpe_49k.json")
RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
SHARD_BYTES = 16 * 2**20

_WORDS = r"coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)"


def op1_pack(spark, sf):
    return packing.pack_pieces(load(spark, sf, "documents"), TOKENIZER)


def op2_language(spark, sf):
    return language.identify(load(spark, sf, "documents"))


def op3_warc(spark, sf):
    path = scratch_path(spark, "warc")
    warc.write_archives(load(spark, sf, "pages"), path)
    return warc.page_records(warc.read_archives(spark, path, with_payload=False))


def op4_mix(spark, sf):
    return mixing.mix_sizes(load(spark, sf, "documents"))


def op5_extract(spark, sf):
    return extract.extract(load(spark, sf, "pages"))


def op6_quality(spark, sf):
    return quality.score_quality(load(spark, sf, "documents"), load(spark, sf, "labels"))


def op7_exact_dedup(spark, sf):
    return exact.find_duplicates(load(spark, sf, "documents"))


def op8_shard(spark, sf):
    return sharding.assign_shards(load(spark, sf, "documents"), SHARD_BYTES)


def op9_topk(spark, sf):
    return topk.top_k(load(spark, sf, "embeddings"))


def op10_near_dedup(spark, sf):
    return neardup.near_duplicates(load(spark, sf, "documents"))


def op11_bpe(spark, sf):
    encoded = bpe.encode(load(spark, sf, "documents"), RANKS, public_tokenizers.PATTERN)
    return bpe.decode(encoded, RANKS).select(
        "doc_id", "n_tokens", F.sha2("ids_le", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256")
    )


def op12_codes(spark, sf):
    return codes.compress(load(spark, sf, "embeddings")).select(
        "vec_id", "code", "error", "label_error", "codebooks_sha256"
    )


def op13_manifest(spark, sf):
    found = merkle.manifest(
        load(spark, sf, "documents"),
        fields=["doc_id", "source", "lang", "n_chars", "text"],
        tree="lang",
        order="doc_id",
        changed={"n_chars": F.col("r.n_chars") + 1},
        changed_where=F.crc32(F.col("r.doc_id").cast("string")) % 7 == 0,
    )
    folded = merkle.fold(F.coalesce("changed_leaf", "leaf"), F.col("path")).alias("folded_root")
    shown = found.select(
        "doc_id", "leaf", "subroot", "root", F.sha2(merkle.siblings(F.col("path")), 256).alias("proof_sha256"), folded
    )
    return shown.withColumn("verified", F.col("folded_root") == F.col("root"))


QUERIES = {
    "pipeline": corpus_pipeline.run,
    "op1_pack": op1_pack,
    "op2_language": op2_language,
    "op3_warc": op3_warc,
    "op4_mix": op4_mix,
    "op5_extract": op5_extract,
    "op6_quality": op6_quality,
    "op7_exact_dedup": op7_exact_dedup,
    "op8_shard": op8_shard,
    "op9_topk": op9_topk,
    "op10_near_dedup": op10_near_dedup,
    "op11_bpe": op11_bpe,
    "op12_codes": op12_codes,
    "op13_manifest": op13_manifest,
}

# DuckDB has no base32: the 160 bits of a SHA-1 are spelled five at a time.
_BASE32 = """array_to_string(list_transform(range(0, 32), lambda i:
    substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + list_sum(list_transform(range(0, 5), lambda j:
        (((instr('0123456789abcdef', substr(hex, ((5 * i + j) // 4 + 1)::int, 1)) - 1)
          >> (3 - (5 * i + j) % 4)::int) & 1) << (4 - j)::int))::int, 1)), '')"""

# CRC-32 has no function in DuckDB: eight steps of the polynomial per byte, over the digits of an id.
_CRC32 = """
    xor(4294967295, list_reduce(list_concat([4294967295::ubigint], list_transform(string_split(doc_id::varchar, ''),
        lambda c: ascii(c)::ubigint)), lambda h, c: list_reduce(list_concat([xor(h, c)], range(8)::ubigint[]),
        lambda x, i: xor(x >> 1, (x & 1) * 3988292384))))"""


def _field(column: str) -> str:
    return f"coalesce(strlen({column}::varchar)::varchar || ':' || {column}::varchar, '-')"


_LEAF = " || ".join(map(_field, ("doc_id", "source", "lang", "n_chars", "text")))


def _nearest(name: str, books: str) -> str:
    """Each part with its least distance to an entry, and the first entry that has it."""
    return f"""
        {name} as (
            select p.vec_id, p.part, p.x, min(struct_pack(gap := list_sum(list_transform(
                       list_zip(p.x, b.x), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::bigint, entry := b.entry)) as near
            from parts p join {books} b on b.part = p.part group by p.vec_id, p.part, p.x)"""


def _moved(name: str, books: str, near: str) -> str:
    """Entries at the floor of their parts' mean; ``%`` takes the sign of the sum."""
    return f"""
        {name} as (
            select b.part, b.entry, coalesce(m.x, b.x) as x
            from {books} b left join (
                select part, near.entry as entry, list_transform(range(1, len(any_value(x)) + 1), lambda i:
                           (list_sum(list_transform(list(x), lambda v: v[i]))
                            - (list_sum(list_transform(list(x), lambda v: v[i])) % count(*) + count(*)) % count(*))
                           // count(*)) as x
                from {near} group by part, near.entry) m on m.part = b.part and m.entry = b.entry)"""


ORACLES = {
    "op3_warc": f"""
        with p as (
            select page_id, strlen(coalesce(html, ''))::bigint as payload_bytes, sha1(coalesce(html, '')) as hex,
                   max(page_id) over (partition by coalesce(html, '')) as last from pages)
        select page_id, payload_bytes, {_BASE32} as payload_digest,
               case when page_id = last then 'response' else 'revisit' end as record_type,
               case when page_id <> last then last end as refers_to
        from p""",
    "op4_mix": f"""
        with d as (
            select doc_id, source, {_WORDS}::bigint as size,
                   md5('17:' || coalesce(doc_id::varchar, '')) as key from documents),
        w as (
            select source, [3.0::double, 1.0, 2.0][(row_number() over (order by source nulls last) - 1) % 3 + 1]
                   as weight
            from (select distinct source from documents)),
        s as (
            select w.source, weight, sum(size)::bigint as source_size, 2.0::double * sum(size) as cap,
                   2.0::double * sum(size) / weight as per_weight
            from d join w on d.source is not distinct from w.source group by w.source, weight),
        l as (
            select *, (1.5::double * sum(source_size) over ()
                       - coalesce(sum(cap) over (order by per_weight, source nulls last
                                  rows between unbounded preceding and 1 preceding), 0))
                   / sum(weight) over (order by per_weight, source nulls last
                                       rows between current row and unbounded following) as level
            from s),
        t as (select *, least(cap, max(level) over () * weight) as target from l),
        n as (
            select *, case when source_size > 0 then floor(target / source_size) else 0 end as whole from t),
        c as (
            select doc_id, size, source_size, target, whole, target - whole * source_size as need,
                   sum(size) over (partition by d.source order by key, doc_id, size
                                   rows unbounded preceding) as run
            from d join n on d.source is not distinct from n.source)
        select doc_id, size, source_size, target,
               (size * (whole + case when need > 0 and 2 * run - size <= 2 * need then 1 else 0 end))::bigint
               as taken
        from c""",
    # The given pages name their articles and use few kinds of blocks and references.
    "op5_extract": r"""
        with a as (
            select page_id, url, regexp_extract(coalesce(html, ''), '(?s)<article>(.*?)</article>', 1) as a
            from pages),
        b as (
            select page_id, url, list_transform(
                string_split_regex(replace(a, '<br>', ' '), '</?(p|h1)>'),
                lambda x: trim(regexp_replace(regexp_replace(replace(replace(replace(
                    regexp_replace(x, '<[^>]*>', '', 'g'), '&quot;', '"'), '&lt;', '<'), '&gt;', '>'),
                    '&amp;?', '&', 'g'), '\s+', ' ', 'g'))) as b
            from a),
        t as (select page_id, url, array_to_string(list_filter(b, lambda x: x <> ''), chr(10) || chr(10)) as text from b)
        select page_id, url, text, length(text)::bigint as n_chars from t""",
    "op7_exact_dedup": """
        select doc_id, max(doc_id) over w as keep_id, count(*) over w as group_size,
               doc_id = max(doc_id) over w as kept, sha256(coalesce(text, '')) as text_sha256
        from documents window w as (partition by coalesce(text, ''))""",
    "op8_shard": f"""
        with d as (
            select doc_id, strlen(coalesce(text, ''))::bigint as bytes,
                   ('0x' || substr(md5(coalesce(doc_id::varchar, '')), 1, 15))::bigint as key
            from documents),
        l as (
            select doc_id, depth, key >> (60 - depth)::int as prefix,
                   sum(bytes) over (partition by depth, key >> (60 - depth)::int) as shard_bytes,
                   count(*) over (partition by depth, key >> (60 - depth)::int) as shard_docs
            from d, range(0, 41) r(depth)),
        f as (
            select doc_id, min(depth) as depth from l
            where shard_bytes <= {SHARD_BYTES} or shard_docs = 1 group by doc_id)
        select d.doc_id, bytes, case when depth = 0 then '' else lpad(bin(prefix), depth::int, '0') end as shard,
               depth, 0::bigint as overflow, shard_bytes::bigint as shard_bytes, shard_docs
        from d join f using (doc_id) join l using (doc_id, depth)""",
    "op9_topk": """
        with v as (
            select vec_id, list_transform(embedding, lambda x: floor(64 * x::double)) as q
            from embeddings
            where embedding is not null and vec_id is not null
              and list_count(list_filter(embedding, lambda x: isfinite(x))) = len(embedding)),
        s as (
            select a.vec_id as query_id, b.vec_id, list_inner_product(a.q, b.q)::bigint as score
            from v a join v b on a.vec_id % 20 = 0 and a.vec_id <> b.vec_id and len(a.q) = len(b.q))
        select query_id, row_number() over (partition by query_id order by score desc, vec_id)::int as rank,
               vec_id, score
        from s qualify rank <= 20""",
    "op12_codes": f"""
        with v as (
            select vec_id, label, list_transform(embedding, lambda x: floor(256 * x::double)::bigint) as q
            from embeddings
            where embedding is not null
              and list_count(list_filter(embedding, lambda x: isfinite(x))) = len(embedding)),
        parts as (
            select vec_id, p as part, q[p * (len(q) // 16) + 1 : (p + 1) * (len(q) // 16)] as x
            from v, range(0, 16) r(p)),
        b0 as (
            select part, row_number() over (partition by part order by vec_id) - 1 as entry, x
            from parts qualify entry < 64),
        {_nearest("n0", "b0")}, {_moved("b1", "b0", "n0")}, {_nearest("n1", "b1")}, {_moved("b2", "b1", "n1")},
        {_nearest("n2", "b2")},
        c as (
            select vec_id, string_agg(printf('%02x', near.entry), '' order by part) as code,
                   sum(near.gap)::bigint as error
            from n2 group by vec_id)
        select vec_id, code, error, sum(error) over (partition by label)::bigint as label_error,
               (select sha256(string_agg(array_to_string(x, ','), ',' order by part, entry)) from b2)
               as codebooks_sha256
        from c join v using (vec_id)""",
    "op13_manifest": f"""
        with recursive d as (
            select doc_id, lang, sha256({_LEAF}) as leaf,
                   sha256({_LEAF.replace("n_chars", "(n_chars + 1)")}) as changed,
                   {_CRC32} % 7 = 0 as tampered,
                   row_number() over (partition by lang order by doc_id nulls first) - 1 as idx,
                   count(*) over (partition by lang) as n
            from documents),
        t(lang, level, idx, n, h) as (
            select lang, 0, idx, n, leaf from d
            union all
            select lang, level + 1, idx // 2, (n + 1) // 2, sha256(string_agg(h, '' order by idx))
            from t where n > 1 group by lang, level, idx // 2, n),
        s as (select lang, level as height, h as subroot, row_number() over (order by lang nulls first) - 1 as idx,
                     count(*) over () as n from t where n = 1),
        u(level, idx, n, h) as (
            select 0, idx, n, subroot from s
            union all
            select level + 1, idx // 2, (n + 1) // 2, sha256(string_agg(h, '' order by idx))
            from u where n > 1 group by level, idx // 2, n),
        -- Every step from a leaf to the root: the slot of the node, and the other node of its run.
        p as (
            select d.doc_id, a.level, a.idx % 2 as slot, coalesce(b.h, '') as other
            from d join t a on a.lang is not distinct from d.lang and a.n > 1 and a.idx = d.idx >> a.level
            left join t b on b.lang is not distinct from a.lang and b.level = a.level and b.idx = xor(a.idx, 1)
            union all
            select d.doc_id, s.height + a.level, a.idx % 2, coalesce(b.h, '')
            from d join s on s.lang is not distinct from d.lang
            join u a on a.n > 1 and a.idx = s.idx >> a.level
            left join u b on b.level = a.level and b.idx = xor(a.idx, 1)),
        q as (
            select doc_id, sha256(string_agg(other, '' order by level)) as proof_sha256,
                   list(slot order by level) as slots, list(other order by level) as others
            from p group by doc_id),
        f(doc_id, step, h) as (
            select doc_id, 1, case when tampered and n_chars is not null then changed else leaf end
            from d join documents using (doc_id)
            union all
            select f.doc_id, step + 1,
                   sha256(case when slots[step] = 0 then f.h || others[step] else others[step] || f.h end)
            from f join q using (doc_id) where step <= len(slots)),
        r as (select h as root from u where n = 1)
        select d.doc_id, leaf, subroot, root, coalesce(proof_sha256, sha256('')) as proof_sha256,
               f.h as folded_root, f.h = root as verified
        from d join s on s.lang is not distinct from d.lang cross join r left join q using (doc_id)
        join f on f.doc_id = d.doc_id and f.step = coalesce(len(slots), 0) + 1""",
    "op10_near_dedup": rf"""
        with recursive w as (
            select doc_id, regexp_extract_all(
                translate(coalesce(text, ''), '{string.ascii_uppercase}', '{string.ascii_lowercase}'),
                '[^\x20\x09-\x0D]+') as w from documents),
        s as (
            select doc_id, list_distinct(case
                when len(w) >= 5 then list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))
                when len(w) > 0 then [array_to_string(w, ' ')] else [] end) as s from w),
        n as (select doc_id, len(s)::bigint as n from s),
        e as (select doc_id, unnest(s) as g from s),
        p as (
            select x.doc_id as a, y.doc_id as b, count(*) as c
            from e x join e y on x.g = y.g and x.doc_id < y.doc_id group by all),
        l as (
            select a, b from p join n x on x.doc_id = a join n y on y.doc_id = b
            where 100 * c >= 85 * (x.n + y.n - c)),
        sides as (select a, b from l union all select b, a from l),
        r(doc_id, id) as (
            select doc_id, doc_id from n union select sides.a, r.id from r join sides on sides.b = r.doc_id)
        select n.doc_id, n as n_shingles, min(id) as component_id, n.doc_id = min(id) as kept
        from n join r on r.doc_id = n.doc_id group by n.doc_id, n""",
}

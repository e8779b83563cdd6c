"""Input frames the queries share, and the SQL text of the same inputs.

Where both engines read the same SQL, one text serves as the Spark input and as
the input of the oracle; only the operators under test are written twice.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.session import spread

RUN_TS = "2024-06-01 12:00:00"
DIM = 64

# RE2 class of the characters Python treats as white space.
WS = (
    r"[\t\n\x0B\f\r\x1c-\x1f \x{85}\x{a0}\x{1680}\x{2000}-\x{200a}"
    r"\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
)

URL_OF_DOC = "'https://h.example/' || source || '/' || lang || '/' || doc_id"

# Inputs in SQL both engines run.
STATUS_INPUT = """
    select 'https://h.example/o/' || o_orderkey as url,
           case when o_totalprice < 50000 then null
                when o_orderstatus = 'F' then 'completed'
                when o_orderstatus = 'O' then 'pending' else 'failed' end as status,
           case when o_totalprice > 450000 then null
                when o_orderpriority = '1-URGENT' then 'discovered'
                when o_orderpriority = '2-HIGH' then 'scraped'
                when o_orderpriority = '3-MEDIUM' then 'chunked'
                when o_orderpriority = '4-NOT SPECIFIED' then 'embedded'
                else 'uploaded' end as stage,
           case when o_orderstatus = 'P' then 'error of ' || o_custkey end as error,
           case when o_orderpriority > '3' then o_custkey end as chunks_count,
           case when o_orderpriority > '4' then o_custkey + 1 end as embeddings_count,
           case when o_orderstatus = 'F' then o_orderdate end as last_updated
    from orders"""

DISCOVERED_INPUT = """
    select 'https://h.example/o/' || o_orderkey as url from orders where o_orderdate > '1994-01-01'
    union all
    select 'https://h.example/c/' || c_custkey as url from customer"""

# One row per URL with what a stage made of it.
RESULTS_INPUT = """
    select 'https://h.example/o/' || l_orderkey as url, count(*) as n,
           case when sum(l_quantity) > 150 then 'too much: ' || count(*) end as error
    from lineitem group by l_orderkey"""

FAILURES_INPUT = """
    select 'https://h.example/u/' || user_id as url, props as error, 'uploading' as stage,
           case when value < 2 then null else ts end as timestamp, event_id as write_seq
    from events where event_type = 'error'"""

# Events as a fetch log.
FETCHES_INPUT = """
    select 'https://h.example/e/' || event_id || case when event_type = 'purchase' then '.pdf' else '' end as url,
           case when event_type = 'error' then 404 else 200 end as status,
           case when event_type = 'click' then 'text/html; charset=utf-8'
                when event_type = 'view' then 'TEXT/HTML'
                when event_type = 'purchase' then 'Application/PDF'
                when event_type = 'error' then 'text/html' end as content_type,
           props as etag,
           case when event_type = 'signup' then 'unknown' else cast(event_id as varchar(20)) end as content_length,
           case when event_type = 'error' then 'timed out' end as error,
           event_type, ts
    from events"""

# Events as vectors of numbered checkpoint files.
CHECKPOINT_INPUT = """
    select case when event_type = 'signup' then null
                when event_type = 'view' then 'https://h.example/u/' || user_id
                else 'https://h.example/o/' || user_id end as source,
           props as id, extract(day from ts) as checkpoint_no, event_id as pos
    from events"""


def load(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


TABLES = ("orders", "customer", "lineitem", "events", "documents", "embeddings", "labels",
          "supplier", "part", "conversations", "benchmark", "pages")


def from_sql(spark: SparkSession, sf: str, text: str) -> DataFrame:
    """An input text as a Spark frame, its table names bound to the given tables."""
    used = {name: load(spark, sf, name) for name in TABLES if f"from {name}" in text}
    for name in used:
        text = text.replace(f"from {name}", "from {" + name + "}")
    return spark.sql(text, **used)


def documents(spark: SparkSession, sf: str) -> DataFrame:
    """Documents under synthetic URLs, with a time that grows with their number."""
    docs = spread(load(spark, sf, "documents"))
    return docs.withColumns(
        {
            "url": F.concat_ws("/", F.lit("https://h.example"), "source", "lang", "doc_id"),
            "type": F.lit("html"),
            "last_modified": F.lit("2024-01-01 00:00:00").cast("timestamp_ntz")
            + F.make_dt_interval(hours=F.col("doc_id").cast("int")),
        }
    ).select("doc_id", "url", "text", "type", "last_modified", "lang", "n_chars")


DOCS = f"""docs as (
    select doc_id, {URL_OF_DOC} as url, text, 'html' as type,
           timestamp '2024-01-01 00:00:00' + to_hours(doc_id) as last_modified, lang, n_chars
    from documents)"""


def stamp(column: Column | str) -> Column:
    return F.date_format(column, "yyyy-MM-dd HH:mm:ss")


def stamp_sql(column: str) -> str:
    return f"strftime({column}, '%Y-%m-%d %H:%M:%S')"


def words_sql(text: str) -> str:
    return f"list_filter(string_split_regex({text}, '{WS}+'), lambda x: x <> '')"


def trim_sql(text: str) -> str:
    return f"regexp_replace({text}, '^{WS}+|{WS}+$', '', 'g')"


def base_path_sql(url: str) -> str:
    """Path up to its second segment, for absolute URLs."""
    path = f"regexp_replace(regexp_extract({url}, '^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*([^?#]*)', 1), ';[^/]*$', '')"
    return f"array_to_string(string_split({path}, '/')[1:3], '/')"

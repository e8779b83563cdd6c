"""Row layouts of the tables the jobs exchange (Spark DDL)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

DISCOVERED = "url string, depth int, is_pdf boolean, discovered_at timestamp_ntz"
DISCOVERY_RUN = "start_url string, max_depth int, domain string, discovery_time timestamp_ntz"
PAGE_METADATA = (
    "url string, last_modified timestamp_ntz, etag string, content_type string, "
    "content_length bigint, scraped_at timestamp_ntz"
)
DOCUMENT = (
    "url string, text string, type string, depth int, "
    "metadata struct<url:string,last_modified:timestamp_ntz,etag:string,"
    "content_type:string,content_length:bigint,scraped_at:timestamp_ntz>"
)
COMBINED = (
    "url string, text string, type string, last_modified timestamp_ntz, "
    "sources array<string>, combined boolean, base_path string"
)
CHUNK = (
    "chunk_id string, source string, chunk_index int, text string, type string, "
    "depth int, last_modified timestamp_ntz"
)
VECTOR = (
    "namespace string, id string, values array<float>, "
    "metadata struct<source:string,type:string,depth:int,last_modified:timestamp_ntz,text:string>"
)
STATUS = (
    "url string, status string, stage string, error string, chunks_count bigint, "
    "embeddings_count bigint, last_updated timestamp_ntz"
)
FAILURE = "url string, error string, stage string, timestamp timestamp_ntz"
SOURCE_IDS = "url string, vector_id string"
REGISTRY = "url string, last_modified timestamp_ntz, vector_count bigint, last_vector_id string"
PDF_PAGE = "path string, page int, text string"
PDF_MANIFEST = "url string, filename string, error string, timestamp timestamp_ntz"
LINEAGE = "url string, source string, doc_key string"
EDGE = "src string, dst string"
LINK = f"{EDGE}, bucket int"

STATUS_COLUMNS = [part.split()[0] for part in STATUS.split(", ")]


def empty(spark: SparkSession, ddl: str) -> DataFrame:
    """No rows of the given layout, in a form the optimizer recognises as empty."""
    nulls = [F.lit(None).cast(f.dataType).alias(f.name) for f in StructType.fromDDL(ddl).fields]
    return spark.range(1).select(*nulls).filter(F.lit(False))


def conform(df: DataFrame, ddl: str) -> DataFrame:
    """Project to the columns of ``ddl``, adding the missing ones as typed nulls."""
    have = set(df.columns)
    return df.select(
        *[
            (F.col(f.name) if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name)
            for f in StructType.fromDDL(ddl).fields
        ]
    )

"""The JSON and PDF file layouts of an existing corpus folder.

Tables are written as folders of files, each a whole JSON document in the layout that
the readers know: a task writes its rows between the opening and the closing of the
document, so that no task holds a document and none has to see the whole table. Spark
commits the files: those of a task that fails are never seen.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone import schemas
from lodestone.sources.files import path_exists

_METADATA_JSON = (
    "struct<url:string,last_modified:string,etag:string,content_type:string,"
    "content_length:string,scraped_at:string>"
)
_DOCUMENT_FIELDS = ("url", "text", "type", "depth", "metadata")
_DOCUMENT_JSON = f"url string, text string, type string, depth int, metadata {_METADATA_JSON}"
_VECTOR_JSON = (
    "id:string,values:array<float>,"
    "metadata:struct<source:string,type:string,depth:int,last_modified:string,text:string>"
)


def read_discovered(spark: SparkSession, path: str) -> DataFrame:
    """Discovered URLs of a run file: a header object and an array of URLs."""
    ddl = "urls array<struct<url:string,depth:int,is_pdf:boolean,discovered_at:string>>"
    if not path_exists(spark, path):
        return schemas.empty(spark, schemas.DISCOVERED)
    urls = spark.read.schema(ddl).json(path, multiLine=True).select(F.inline("urls"))
    return urls.withColumn("discovered_at", F.col("discovered_at").try_cast("timestamp_ntz"))


def read_discovery_run(spark: SparkSession, path: str) -> DataFrame:
    """The header of a run file as one row."""
    ddl = "metadata struct<start_url:string,max_depth:int,domain:string,discovery_time:string>"
    if not path_exists(spark, path):
        return schemas.empty(spark, schemas.DISCOVERY_RUN)
    header = spark.read.schema(ddl).json(path, multiLine=True).select("metadata.*")
    return header.withColumn("discovery_time", F.col("discovery_time").try_cast("timestamp_ntz"))


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """Documents stored as an array, as one object, or under a ``documents`` key.

    The three forms may be mixed under one path; each file is parsed on its own.
    """
    if not path_exists(spark, path):
        return schemas.empty(spark, schemas.DOCUMENT)
    wrapped = _DOCUMENT_JSON.replace(", ", ",").replace(" ", ":")
    files = spark.read.schema(f"{_DOCUMENT_JSON}, documents array<struct<{wrapped}>>").json(
        path, multiLine=True
    )
    alone = F.array(F.struct(*_DOCUMENT_FIELDS))
    rows = files.select(F.inline(F.coalesce("documents", alone)))
    meta = F.col("metadata")
    return rows.withColumn(
        "metadata",
        F.when(
            meta.isNotNull(),
            F.struct(
                meta["url"].alias("url"),
                meta["last_modified"].try_cast("timestamp_ntz").alias("last_modified"),
                meta["etag"].alias("etag"),
                meta["content_type"].alias("content_type"),
                meta["content_length"].try_cast("bigint").alias("content_length"),
                meta["scraped_at"].try_cast("timestamp_ntz").alias("scraped_at"),
            ),
        ),
    )


def read_failures_json(spark: SparkSession, path: str) -> DataFrame:
    """The failure log file; a missing or unreadable one reads as empty."""
    ddl = "urls array<struct<url:string,error:string,stage:string,timestamp:string>>"
    if not path_exists(spark, path):
        return schemas.empty(spark, schemas.FAILURE)
    log = spark.read.schema(ddl).json(path, multiLine=True, mode="PERMISSIVE")
    rows = log.select(F.inline("urls"))
    return rows.withColumn("timestamp", F.col("timestamp").try_cast("timestamp_ntz"))


def read_status_json(spark: SparkSession, path: str) -> DataFrame:
    """The status file, an object keyed by URL; a missing one reads as empty."""
    value = (
        "struct<status:string,stage:string,error:string,chunks_count:bigint,"
        "embeddings_count:bigint,last_updated:string>"
    )
    if not path_exists(spark, path):
        return schemas.empty(spark, schemas.STATUS)
    entries = F.from_json("value", f"map<string,{value}>")
    rows = (
        spark.read.text(path, wholetext=True)
        .select(F.explode(entries).alias("url", "entry"))
        .select("url", "entry.*")
    )
    return rows.withColumn("last_updated", F.col("last_updated").try_cast("timestamp_ntz"))


def _iso(column: Column | str) -> Column:
    """A time as ISO text with microseconds."""
    return F.date_format(column, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")


def _write_documents(rows: DataFrame, path: str, opening: str, closing: str, mode: str) -> None:
    """Write the one column of ``rows``, JSON texts, as documents: a file per partition."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def lines(values):
            return pa.RecordBatch.from_arrays([values.cast(pa.string())], ["value"])

        yield lines(pa.array([opening]))
        first = True
        for batch in batches:
            if batch.num_rows:
                texts = batch.column(0).cast(pa.string())
                after = pc.binary_join_element_wise(",", texts, "")
                yield lines(pa.concat_arrays([texts.slice(0, 1), after.slice(1)]) if first else after)
                first = False
        yield lines(pa.array([closing]))

    rows.mapInArrow(run, "value string").write.mode(mode).text(path)


def write_discovered(urls: DataFrame, run: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Discovered URLs, each file with the header of the run, which is one row."""
    header = run.select(F.to_json(F.struct("start_url", "max_depth", "domain", _iso("discovery_time").alias("discovery_time"))))
    first = header.first()
    entry = F.struct("url", "depth", "is_pdf", _iso("discovered_at").alias("discovered_at"))
    opening = f'{{"metadata": {first[0] if first else "{}"}, "urls": ['
    _write_documents(urls.select(F.to_json(entry).alias("value")), path, opening, "]}", mode)


def write_failures_json(failures: DataFrame, path: str, mode: str = "errorifexists") -> None:
    entry = F.struct("url", "error", "stage", _iso("timestamp").alias("timestamp"))
    _write_documents(failures.select(F.to_json(entry).alias("value")), path, '{"urls": [', "]}", mode)


def write_status_json(status: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Objects keyed by URL. A row without a URL has no key and is left out."""
    fields = [c for c in schemas.STATUS_COLUMNS if c not in ("url", "last_updated")]
    entry = F.to_json(F.create_map("url", F.struct(*fields, _iso("last_updated").alias("last_updated"))))
    pair = F.substring(entry, F.lit(2), F.length(entry) - 2)
    _write_documents(status.filter("url is not null").select(pair.alias("value")), path, "{", "}", mode)


def write_documents(docs: DataFrame, path: str, wrapped: bool = False, mode: str = "errorifexists") -> None:
    """Documents as arrays, or with ``wrapped`` under a ``documents`` key."""
    meta = F.col("metadata")
    metadata = F.struct(
        meta["url"].alias("url"),
        _iso(meta["last_modified"]).alias("last_modified"),
        meta["etag"].alias("etag"),
        meta["content_type"].alias("content_type"),
        meta["content_length"].cast("string").alias("content_length"),
        _iso(meta["scraped_at"]).alias("scraped_at"),
    )
    entry = F.struct("url", "text", "type", "depth", F.when(meta.isNotNull(), metadata).alias("metadata"))
    opening, closing = ('{"documents": [', "]}") if wrapped else ("[", "]")
    _write_documents(docs.select(F.to_json(entry).alias("value")), path, opening, closing, mode)


def write_checkpoint(vectors: DataFrame, folder: str, number: int, *order: str, mode: str = "errorifexists") -> None:
    """Vectors (id, values, metadata) as the checkpoint of a number, in the order of the columns ``order``."""
    meta = F.col("metadata")
    metadata = F.struct(
        *(meta[c].alias(c) for c in ("source", "type", "depth")),
        _iso(meta["last_modified"]).alias("last_modified"),
        meta["text"].alias("text"),
    )
    entry = F.to_json(F.struct("id", "values", metadata.alias("metadata")))
    rows = vectors.repartitionByRange(*order).sortWithinPartitions(*order).select(entry.alias("value"))
    _write_documents(rows, f"{folder.rstrip('/')}/embeddings_checkpoint_{number}.json", "[", "]", mode)


def read_checkpoints(spark: SparkSession, folder: str) -> DataFrame:
    """Vectors of every numbered checkpoint, a file or a folder of parts, with its number and their position.

    ``pos`` comes of the number of the part and the place in its array, so it is the same
    whichever tasks read the files. A file that can't be parsed gives no rows.
    """
    glob = f"{folder.rstrip('/')}/embeddings_checkpoint_*.json"
    if path_exists(spark, glob):
        files = spark.read.text(glob, wholetext=True).select("value", F.col("_metadata.file_path").alias("file"))
    else:
        files = schemas.empty(spark, "value string, file string")
    entries = F.from_json("value", f"array<struct<{_VECTOR_JSON}>>")
    rows = files.select("file", F.posexplode(entries).alias("place", "entry")).select("file", "place", "entry.*")
    number = F.regexp_extract("file", r"embeddings_checkpoint_(\d+)\.json", 1).try_cast("bigint")
    part = F.regexp_extract("file", r"/part-(\d+)[^/]*$", 1).try_cast("bigint")
    when = F.col("metadata.last_modified").try_cast("timestamp_ntz")
    return rows.select(
        number.alias("checkpoint_no"),
        (F.coalesce(part, F.lit(0)) * 2**32 + F.col("place")).alias("pos"),
        "id",
        "values",
        F.col("metadata").withField("last_modified", when).alias("metadata"),
    )


def list_pdf_files(spark: SparkSession, folder: str) -> DataFrame:
    """PDF files directly inside one folder; file contents are not read."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.pdf").load(folder)
    return files.select("path", "length", "modificationTime")

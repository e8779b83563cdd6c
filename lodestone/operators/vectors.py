"""Namespaced vectors: upserts, statistics, checks."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from lodestone import schemas
from lodestone.functions.times import as_ntz
from lodestone.operators.selecting import drop_keys
from lodestone.session import stored
from lodestone.sources import tables

# The index definition and its namespaces.
DIMENSION = 1536
METRIC = "cosine"
DEFAULT_NAMESPACE = "prod"
NAMESPACES = ("prod", "development", "test")

_INDEX = "dimension int, metric string, created_at timestamp_ntz, log string"


def one_per_key(rows: DataFrame, key: list[str], order: list[str], newest: bool) -> DataFrame:
    """The first or last row of each key by ``order``.

    An aggregate, not a window: each map task reduces its own copies first, so
    a key that makes up much of the table still sends one row per task.
    """
    others = [c for c in rows.columns if c not in key]
    pick = F.max_by if newest else F.min_by
    best = pick(F.struct(*others), F.struct(*order))
    return rows.groupBy(*key).agg(best.alias("_row")).select(*key, "_row.*").select(*rows.columns)


def distinct_ids(vectors: DataFrame) -> DataFrame:
    return vectors.select("id").distinct()


def union_vectors(old: DataFrame, new: DataFrame) -> DataFrame:
    """All vectors of both; repeats stay."""
    return old.unionByName(new)


def update_processed_ids(processed: DataFrame, vectors: DataFrame) -> DataFrame:
    return processed.select("id").unionByName(vectors.select("id")).distinct()


def new_chunks(chunks: DataFrame, processed: DataFrame) -> DataFrame:
    """Chunks whose id has not been embedded yet."""
    return drop_keys(chunks, processed.select(F.col("id").alias("chunk_id")), "chunk_id")


def vectors_per_document(vectors: DataFrame) -> DataFrame:
    """Vector count per source; vectors without a source are left out."""
    sources = vectors.select(F.col("metadata.source").alias("source"))
    return sources.filter("source is not null").groupBy("source").agg(
        F.count("*").alias("embeddings_count")
    )


def namespace_stats(vectors: DataFrame, namespaces: list[str] | None = None) -> DataFrame:
    """Vector count per namespace; those named in ``namespaces`` count 0 when absent."""
    stats = vectors.groupBy("namespace").agg(F.count("*").alias("vector_count"))
    if not namespaces:
        return stats
    named = F.explode(F.array(*[F.lit(n) for n in namespaces])).alias("namespace")
    zero = vectors.sparkSession.range(1).select(named, F.lit(0).cast("bigint").alias("vector_count"))
    return stats.unionByName(zero).groupBy("namespace").agg(
        F.sum("vector_count").alias("vector_count")
    )


def validate_vectors(vectors: DataFrame, dimension: int = DIMENSION) -> tuple[DataFrame, DataFrame]:
    """Vectors of the index dimension, and failure rows for the others."""
    fits = F.coalesce(F.size("values") == dimension, F.lit(False))
    wrong = vectors.filter(~fits).select(
        F.col("metadata.source").alias("url"),
        F.format_string(
            "vector %s has %d values instead of %d",
            F.col("id"),
            F.coalesce(F.size("values"), F.lit(0)),
            F.lit(dimension),
        ).alias("error"),
        F.lit("uploading").alias("stage"),
    )
    return vectors.filter(fits), wrong


def upsert(current: DataFrame, new: DataFrame, replace_sources: bool = False) -> DataFrame:
    """``current`` after writing ``new``: the last write of each (namespace, id) wins.

    ``new`` may carry ``write_seq`` to order repeated ids. Vectors of an older
    form of a document stay, unless ``replace_sources`` removes what the sources
    in ``new`` had before.
    """
    if "write_seq" not in new.columns:
        new = new.withColumn("write_seq", F.lit(1).cast("bigint"))
    if replace_sources:
        source = F.col("metadata.source")
        written = new.filter(source.isNotNull()).withColumn("_source", source)
        current = current.withColumn("_source", source)
        current = drop_keys(current, written, "namespace", "_source").drop("_source")
    rows = current.withColumn("write_seq", F.lit(None).cast("bigint")).unionByName(new)
    order = ["write_seq", "values", "metadata"]
    return one_per_key(rows, ["namespace", "id"], order, newest=True).drop("write_seq")


def create_index(
    spark: SparkSession,
    path: str,
    run_ts: Column | str | None = None,
    dimension: int = DIMENSION,
    metric: str = METRIC,
    confirm: bool = False,
) -> None:
    """Start an empty index. An existing one, all namespaces, needs ``confirm=True``.

    Each index keeps its vectors in a folder with a name of its own, which the
    header holds, so it can't find those of another one, dropped or unfinished.
    """
    if tables.current_version(spark, f"{path}/index") is not None and not confirm:
        raise ValueError("an index exists; pass confirm=True to drop all of its namespaces")
    header = spark.range(1).select(
        F.lit(dimension).alias("dimension"),
        F.lit(metric).alias("metric"),
        as_ntz(run_ts).alias("created_at"),
        F.lit(_new_log()).alias("log"),
    )
    tables.write_table(header, f"{path}/index")


def _new_log() -> str:
    return f"vectors-{uuid.uuid4().hex}"


def _vector_log(spark: SparkSession, path: str) -> str:
    header = index_header(spark, path).first()
    return f"{path}/{header['log'] if header else 'no-vectors'}"


def index_header(spark: SparkSession, path: str) -> DataFrame:
    return tables.read_table(spark, f"{path}/index", _INDEX)


_SOURCE = "namespace string, source string"


def append_vectors(
    vectors: DataFrame,
    path: str,
    write_seq: int,
    writer: str = "build",
    replace_sources: bool = False,
    replaced: DataFrame | None = None,
) -> int:
    """Store one run's vectors and return how many rows came in.

    With ``replace_sources`` the sources in ``vectors`` lose, in their namespace, all that
    earlier runs stored for them; ``replaced`` (namespace, source) names the sources
    instead, also some that have no vector any more. Vectors without a source replace
    nothing. A record of these sources is written beside the log, so that replacing
    costs as much as the run and not as the table; until the run is complete, readers
    see what was there before.

    Runs are numbered by each ``writer`` on its own; of an id that several have
    written, the one that began its run last counts. Vectors that don't have the
    dimension of the index raise before anything is written; an index that isn't
    there yet is created with the dimension of the first vector.

    An id repeated within the run is written once. Repeats are looked for on
    the ids alone, so that vectors with an id of their own, as a rule all, are
    written without a shuffle; pass stored vectors, as they are read twice.
    Cost follows the run, not the table: earlier runs are not rewritten.
    """
    spark = vectors.sparkSession
    key = ["namespace", "id"]
    rows = vectors.select(*key, "values", "metadata")
    if tables.current_version(spark, f"{path}/index") is None:
        first = rows.select(F.size("values").alias("n")).filter("n > 0").first()
        if first is None:
            return 0  # nor is there anything to replace
        create_index(spark, path, dimension=first["n"])
    dimension = index_header(spark, path).first()["dimension"]
    seen = Observation()
    wrong = F.count_if(~F.coalesce(F.size("values") == dimension, F.lit(False))).alias("wrong")
    copies = rows.groupBy(*key).agg(F.count("*").alias("n"), wrong)
    counted = copies.observe(
        seen,
        F.coalesce(F.sum("n"), F.lit(0)).alias("rows"),
        F.coalesce(F.sum("wrong"), F.lit(0)).alias("wrong"),
    )
    repeated = stored(counted.filter("n > 1").select(*key), "repeated-ids")
    if seen.get["wrong"]:
        raise ValueError(f"{seen.get['wrong']} vectors don't have the index's {dimension} dimensions")
    once = one_per_key(
        rows.join(repeated, key, "left_semi"), key, ["values", "metadata"], newest=True
    )
    written = rows.join(repeated, key, "left_anti").unionByName(once)
    log = _vector_log(spark, path)
    run = tables.claim_run(spark, log, writer, write_seq)
    if not replace_sources:
        tables.append_log(written, log, run, "namespace")
        return seen.get["rows"]
    tables.open_replacing(spark, log, run)
    tables.append_log(written, log, run, "namespace")
    if replaced is None:
        replaced = rows.select("namespace", F.col("metadata.source").alias("source"))
    replaced = replaced.select("namespace", "source").filter("source is not null")
    tables.publish_replaced(schemas.conform(replaced, _SOURCE), log, run)
    return seen.get["rows"]


def compact_vectors(spark: SparkSession, path: str, write_seq: int) -> None:
    """Rewrite the current vectors as one run, so that readers resolve nothing.

    The rewritten vectors become current with the new index version, the last
    thing written.
    """
    header, current, log = index_header(spark, path), read_vectors(spark, path), _new_log()
    number = tables.claim_run(spark, f"{path}/{log}", "compaction", write_seq)
    tables.append_log(current, f"{path}/{log}", number, "namespace")
    tables.write_table(header.withColumn("log", F.lit(log)), f"{path}/index")


def read_vectors(spark: SparkSession, path: str) -> DataFrame:
    """Current vectors. A filter on ``namespace`` prunes folders.

    Of an id the newest run counts, unless a later run replaced its source. Records
    of replaced sources are reduced to one row per source and stored, so that the
    join with the vectors is planned by their real size. Rows of the newest run are
    read as they are; of the others those of replaced sources go first, by their
    keys alone, so that mostly no id is left to be looked up.
    """
    log = _vector_log(spark, path)
    hidden, records = tables.replaced(spark, log, _SOURCE)
    key = ["namespace", "id"]
    if records is None:
        return tables.read_latest(spark, log, schemas.VECTOR, *key, hidden=hidden)
    gone = stored(records.toDF("_namespace", "_source", "_replaced"), "replaced")
    rows = tables.read_log(spark, log, schemas.VECTOR).filter(~F.col("write_seq").isin(hidden))
    last = gone.agg(F.max("_replaced")).first()[0] or 0
    newest = max([last, *(run for run in tables.run_numbers(spark, log) if run not in hidden)])

    def remaining(old: DataFrame, source: str) -> DataFrame:
        same = (F.col("namespace") == F.col("_namespace")) & (F.col(source) == F.col("_source"))
        kept = old.join(gone, same, "left").filter("_replaced is null or write_seq >= _replaced")
        return kept.select(*old.columns)

    final, old = rows.filter(F.col("write_seq") == newest), rows.filter(F.col("write_seq") != newest)
    keys = rows.select(*key, "write_seq", F.lit(None).cast("bigint").alias("_kept"))
    left = remaining(old.select(*key, "write_seq", F.col("metadata.source").alias("_from")), "_from")
    left = left.select(*key, "write_seq", F.col("write_seq").alias("_kept"))
    runs = keys.unionByName(left).groupBy(*key).agg(F.min("_kept").alias("_kept"), F.max("write_seq").alias("_latest"))
    # Ids of which a row is left that is not of the newest run.
    rewritten = stored(runs.filter("_kept < _latest").drop("_kept"), "rewritten")
    current = remaining(old, "metadata.source").join(rewritten, key, "left")
    current = current.filter("_latest is null or write_seq = _latest").drop("_latest")
    return current.unionByName(final).drop("write_seq")


def upload_if_empty(
    vectors: DataFrame, path: str, namespace: str, write_seq: int, force: bool = False
) -> bool:
    """Store ``vectors`` unless the namespace already holds some; tells whether it did."""
    spark = vectors.sparkSession
    present = read_vectors(spark, path).filter(F.col("namespace") == namespace)
    if not force and not present.isEmpty():
        return False
    append_vectors(vectors.withColumn("namespace", F.lit(namespace)), path, write_seq)
    return True

"""Stage tables on any shared file system, without a table format.

Two layouts cover every stage:

* a *versioned* table is rewritten as a whole into ``v<n+1>``; the newest folder
  that Spark's committer finished (``_SUCCESS``) is the current one, so a reader
  never sees half a write and a job may read the table it is replacing;
* a *log* table grows by one ``write_seq`` partition per run. Writing the same
  run again replaces all that its earlier attempt left, in every parent folder,
  and nothing else, which makes retries harmless and costs nothing for rows
  already stored. Writers that number their runs on their own get numbers of the
  log from ``claim_run``, so that none replaces another's rows.

A run of a log can also take back rows of earlier runs. It says which in a record
beside the log, ``<log>-replaced/run=<n>``, and is hidden as a whole, rows and
record, until the record is complete (``_SUCCESS``), the last thing it writes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone import schemas
from lodestone.session import stored
from lodestone.sources.files import create_new, delete_folder, folder_names, glob_paths, path_exists


def current_version(spark: SparkSession, path: str) -> int | None:
    numbers = sorted(
        (int(n[1:]) for n in folder_names(spark, path) if n[0] == "v" and n[1:].isdigit()),
        reverse=True,
    )
    done = (n for n in numbers if path_exists(spark, f"{path}/v{n}/_SUCCESS"))
    return next(done, None)


def read_table(spark: SparkSession, path: str, ddl: str) -> DataFrame:
    """The current version; a table never written reads as empty."""
    version = current_version(spark, path)
    if version is None:
        return schemas.empty(spark, ddl)
    return spark.read.schema(ddl).parquet(f"{path}/v{version}")


def next_version(spark: SparkSession, path: str) -> int:
    taken = (int(n[1:]) for n in folder_names(spark, path) if n[0] == "v" and n[1:].isdigit())
    return max(taken, default=0) + 1


def write_table(df: DataFrame, path: str, *partitions: str) -> int:
    """Write ``df`` as the next version and return its number."""
    version = next_version(df.sparkSession, path)
    df.write.mode("overwrite").partitionBy(*partitions).parquet(f"{path}/v{version}")
    return version


def append_log(df: DataFrame, path: str, write_seq: int, *partitions: str) -> None:
    """Add one run's rows. Repeating a ``write_seq`` replaces the whole of that run, and only it.

    What an earlier attempt left is removed first, also in folders the new
    attempt has no rows for, so ``df`` must not read this run of this log.
    """
    spark = df.sparkSession
    for depth in range(len(partitions) + 1):
        for left in glob_paths(spark, path + "/*" * depth + f"/write_seq={write_seq}"):
            delete_folder(spark, left)
    (
        df.withColumn("write_seq", F.lit(write_seq).cast("bigint"))
        .write.mode("append")
        .partitionBy(*partitions, "write_seq")
        .parquet(path)
    )


def claim_run(spark: SparkSession, path: str, writer: str, run: int) -> int:
    """The number in the log at ``path`` of a writer's own run ``run``.

    The first call takes the next free number, a later one for the same run finds
    it again. Numbers are taken one at a time by creating a file, so writers at
    the same time get different ones, and later claims get larger ones.
    """
    folder, mine = f"{path}/_runs", f"{writer}.{run}"
    names = folder_names(spark, folder)
    held = [int(n.split("--")[0]) for n in names if n.endswith(f"--{mine}")]
    if held:
        return held[0]
    number = max((int(n.split("--")[0]) for n in names), default=0) + 1
    while not create_new(spark, f"{folder}/{number}"):
        number += 1
    create_new(spark, f"{folder}/{number}--{mine}")
    return number


def open_replacing(spark: SparkSession, path: str, write_seq: int) -> None:
    """Begin a run that replaces rows of earlier ones: nothing of it counts until ``publish_replaced``."""
    create_new(spark, f"{path}-replaced/_open/{write_seq}")
    delete_folder(spark, f"{path}-replaced/run={write_seq}")


def publish_replaced(keys: DataFrame, path: str, write_seq: int) -> None:
    """End a replacing run: rows of earlier runs with one of ``keys`` are gone, the run's own count."""
    keys.distinct().write.mode("overwrite").parquet(f"{path}-replaced/run={write_seq}")


def replaced(spark: SparkSession, path: str, ddl: str) -> tuple[list[int], DataFrame | None]:
    """Runs that are hidden, and per key of ``ddl`` the last run that replaced its rows (``_replaced``)."""
    opened = {int(n) for n in folder_names(spark, f"{path}-replaced/_open") if n.isdigit()}
    done = glob_paths(spark, f"{path}-replaced/run=*/_SUCCESS")
    folders = {int(f.split("/")[-2].removeprefix("run=")): f.rsplit("/", 1)[0] for f in done}
    hidden = sorted(opened - set(folders))
    if not folders:
        return hidden, None
    records = spark.read.schema(f"{ddl}, run bigint").option("basePath", f"{path}-replaced").parquet(*folders.values())
    keys = [c for c in records.columns if c != "run"]
    return hidden, records.groupBy(*keys).agg(F.max("run").alias("_replaced"))


def append_results(df: DataFrame, path: str, write_seq: int) -> None:
    """Add one run's rows, good and failed ones apart, in a single write.

    Rows with an ``error`` go to the log ``<path>/result=failed``, the others to
    ``<path>/result=ok``, so that expensive work (parsing, embedding) is done
    once although two tables come of it.
    """
    result = F.when(F.col("error").isNull(), "ok").otherwise("failed")
    append_log(df.withColumn("result", result), path, write_seq, "result")


def read_log(spark: SparkSession, path: str, ddl: str) -> DataFrame:
    schema = f"{ddl}, write_seq bigint"
    if not log_runs(spark, path):
        return schemas.empty(spark, schema)
    return spark.read.schema(schema).parquet(path)


def log_runs(spark: SparkSession, path: str) -> dict[str, int]:
    """Number of runs stored per partition folder, from the folder names alone."""
    runs: dict[str, int] = {}
    for name in glob_paths(spark, f"{path}/write_seq=*") + glob_paths(spark, f"{path}/*/write_seq=*"):
        parent = name.rsplit("/", 1)[0]
        runs[parent] = runs.get(parent, 0) + 1
    return runs


def run_numbers(spark: SparkSession, path: str) -> set[int]:
    """Numbers of the runs stored in any folder, from the folder names alone."""
    found = glob_paths(spark, f"{path}/write_seq=*") + glob_paths(spark, f"{path}/*/write_seq=*")
    return {int(name.rsplit("=", 1)[1]) for name in found}


def latest_runs(log: DataFrame, *key: str) -> DataFrame:
    """Rows of each key's newest run.

    Only keys and run numbers are aggregated, never the payload. Keys written
    more than once are few in normal use. They are stored first, so that the
    join is planned by their real size: Spark broadcasts them when they are
    small, leaving the wide rows in place, and shuffles otherwise.
    """
    rewritten = stored(
        log.groupBy(*key)
        .agg(F.min("write_seq").alias("_first"), F.max("write_seq").alias("_latest"))
        .filter("_first < _latest")
        .drop("_first")
    )
    rows = log.join(rewritten, list(key), "left")
    return rows.filter("_latest is null or write_seq = _latest").drop("_latest")


def read_latest(
    spark: SparkSession,
    path: str,
    ddl: str,
    *key: str,
    only: DataFrame | None = None,
    hidden: list[int] | None = None,
    keep_run: bool = False,
) -> DataFrame:
    """A log as a keyed table. With one run per folder there is nothing to resolve.

    ``only`` restricts the table to its keys before anything is aggregated; runs in
    ``hidden`` don't count; ``keep_run`` keeps the column ``write_seq``.
    """
    log = read_log(spark, path, ddl)
    if hidden:
        log = log.filter(~F.col("write_seq").isin(hidden))
    if only is not None:
        log = log.join(only.select(*key).distinct(), list(key), "left_semi")
    single = all(count == 1 for count in log_runs(spark, path).values())
    rows = log if single else latest_runs(log, *key)
    return rows if keep_run else rows.drop("write_seq")


def write_chunks(chunks: DataFrame, path: str, write_seq: int) -> None:
    """Store one run's chunks; they replace earlier runs' chunks of the same source."""
    append_log(schemas.conform(chunks, schemas.CHUNK), path, write_seq)


def read_chunks(spark: SparkSession, path: str) -> DataFrame:
    return read_latest(spark, path, schemas.CHUNK, "source")


def write_status(status: DataFrame, path: str) -> int:
    return write_table(schemas.conform(status, schemas.STATUS), path)


def read_status(spark: SparkSession, path: str) -> DataFrame:
    return read_table(spark, path, schemas.STATUS)


def append_failures(failures: DataFrame, path: str, write_seq: int) -> None:
    append_log(schemas.conform(failures, schemas.FAILURE), path, write_seq)


def read_failures(spark: SparkSession, path: str) -> DataFrame:
    """The failure log, oldest run first by ``write_seq``."""
    return read_log(spark, path, schemas.FAILURE)


def write_combined(documents: DataFrame, path: str) -> int:
    return write_table(schemas.conform(documents, schemas.COMBINED), path)


def read_combined(spark: SparkSession, path: str) -> DataFrame:
    return read_table(spark, path, schemas.COMBINED)

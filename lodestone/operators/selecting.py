"""Keeping or dropping the rows of given keys without moving wide rows needlessly.

Which keys of a table are meant is settled on the key columns alone, and both
sides of the answer are written out. The join with the wide rows then uses the
smaller side: few documents due and nearly all of them due both leave a small
one. Its size is known from its files before the join is planned, so Spark
broadcasts it when it is under ``spark.sql.autoBroadcastJoinThreshold`` and the
texts are not shuffled; otherwise it plans an ordinary shuffled join.
"""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from lodestone.session import scratch_path
from lodestone.sources.files import path_exists


def _match(rows: DataFrame, keys: DataFrame, on: tuple[str, ...], how: str) -> DataFrame:
    """Join on equal keys, nulls being equal too."""
    renamed = keys.toDF(*[f"_k{i}" for i in range(len(keys.columns))])
    same = (rows[c].eqNullSafe(renamed[f"_k{i}"]) for i, c in enumerate(on))
    return rows.join(renamed, reduce(and_, same), how)


def _restrict(rows: DataFrame, keys: DataFrame, on: tuple[str, ...], keep: bool) -> DataFrame:
    spark = rows.sparkSession
    present = rows.select(*on).distinct()
    hits = keys.select(*on).distinct().withColumn("_hit", F.lit(True))
    marked = _match(present, hits, on, "left").select(
        *on, F.coalesce(f"_k{len(on)}", F.lit(False)).alias("_hit")
    )
    counts = Observation()
    path = scratch_path(spark, "keys")
    marked.observe(
        counts, F.count_if("_hit").alias("hits"), F.count_if(~F.col("_hit")).alias("others")
    ).write.partitionBy("_hit").parquet(path)

    def side(hit: bool) -> DataFrame:
        folder = f"{path}/_hit={str(hit).lower()}"
        if not path_exists(spark, folder):
            return present.limit(0)
        return spark.read.schema(present.schema).parquet(folder)

    found = counts.get
    use_hits = found["hits"] <= found["others"]
    return _match(rows, side(use_hits), on, "left_semi" if use_hits == keep else "left_anti")


def keep_keys(rows: DataFrame, keys: DataFrame, *on: str) -> DataFrame:
    """Rows whose key occurs in ``keys``."""
    return _restrict(rows, keys, on, keep=True)


def drop_keys(rows: DataFrame, keys: DataFrame, *on: str) -> DataFrame:
    """Rows whose key does not occur in ``keys``."""
    return _restrict(rows, keys, on, keep=False)

"""Joins with groups of very uneven size, and components of links."""

from __future__ import annotations

import ctypes
import gc
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.session import stored

# A group is hot when it holds more than this share of the rows, so at most this many are hot.
HOT_SHARE = 1024


@contextmanager
def small_batches(spark: SparkSession, size: int = 8 * 2**20):
    """Arrow batches of about ``size`` bytes for what is stored inside, so that workers stay small."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(size))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def _return_memory() -> None:
    """Give memory that Python, Arrow, and the C library keep for later back to the system."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def tidy(run):
    """``run``, for ``mapInArrow``, in a worker that holds little before and after it.

    Spark keeps workers for later tasks, and what they keep counts against the
    executor while others work.
    """

    def tidied(batches):
        _return_memory()
        try:
            yield from run(batches)
        finally:
            _return_memory()

    return tidied


def words(text: Column | str) -> Column:
    """Number of runs of anything but ASCII white space; null text has none."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def fold(text: Column | str) -> Column:
    """Null text as empty text."""
    column = F.col(text) if isinstance(text, str) else text
    return F.coalesce(column.cast("string"), F.lit(""))


def held_out(doc_id: Column) -> Column:
    """Rows that are never learned from: CRC-32 of the id as text leaves 2 when divided by 4."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))


def whole_row(df: DataFrame) -> Column:
    """All columns of a row in one struct, so that no column of ours can clash with one of them."""
    return F.struct(*[F.col(f"`{c}`") for c in df.columns])


def attach_groups(rows: DataFrame, groups: DataFrame, on: list[str], size: str) -> DataFrame:
    """Inner join of rows with the one row of their group, whatever the group's size.

    ``size`` is the column of ``groups`` with the number of rows of a group. The
    groups with more than 1/HOT_SHARE of all rows, at most HOT_SHARE of them, are
    broadcast, so their rows stay where they are; the others meet in a shuffled
    join in which no key has more than that share. Keys must not be null.
    ``groups`` is read three times and should be stored.
    """
    total = groups.agg(F.sum(size)).first()[0] or 0
    is_hot = F.col(size) * HOT_SHARE > F.lit(total)
    hot = F.broadcast(groups.filter(is_hot))
    cold = groups.filter(~is_hot)
    few = rows.join(hot.select(*on), on, "left_anti").join(cold, on)
    return rows.join(hot, on).unionByName(few)


def _stars(edges: DataFrame) -> DataFrame:
    """One round: every node's larger neighbours, then its smaller ones, move to its least neighbour."""
    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    large = (
        both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    ).distinct()
    lower = large.groupBy("u").agg(F.min("v").alias("m"))
    joined = large.join(lower, "u")
    small = joined.filter("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    own = lower.select("u", F.col("m").alias("v"))
    return small.union(own).distinct()


def components(links: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 60) -> DataFrame:
    """Connected components of links between ids: one row ``node, component`` per linked id.

    ``component`` is the least id that can be reached. Rounds of large and small
    stars, each written to the shared folder, until no edge changes: the number
    of rounds grows with the logarithm of the longest path, and minima of a node
    with very many links are reduced before they are shuffled.
    """
    edges = stored(
        links.filter(F.col(a) != F.col(b))
        .select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
        .distinct(),
        "edges",
    )
    mark = [F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))]
    before = tuple(edges.agg(*mark).first())
    for _ in range(max_rounds):
        edges = stored(_stars(edges), "edges")
        after = tuple(edges.agg(*mark).first())
        if after == before:
            break
        before = after
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    roots = edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).union(roots)

"""Sharding by extendible hashing: only buckets over the byte limit split on another bit.

Ids are hashed to 60 bits. A directory of sums by hash prefix is grown a few bits
at a time; a bucket becomes a shard at the first prefix under which it fits, and
only the rows of buckets that still don't fit go on to the next bits. No step
sees more of a document than its hash and its length.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lodestone.llm.common import fold
from lodestone.session import stored

BITS = 60
STEP = 8


def hash_bits(doc_id: Column) -> Column:
    """The first 60 bits of the MD5 of the id as text; a missing id counts as empty text."""
    text = F.coalesce(doc_id.cast("string"), F.lit(""))
    return F.conv(F.substring(F.md5(text), 1, BITS // 4), 16, 10).cast("long")


def _leaves(rows: DataFrame, depth: int, top: int, limit: int) -> DataFrame:
    """For each prefix of ``top`` bits that lies in a bucket that fits: that bucket.

    ``bin, depth, prefix, shard_bytes, shard_docs``; a bucket is the shortest
    prefix longer than those tried before, with at most ``limit`` bytes or with
    one document.
    """
    bins = rows.groupBy(F.shiftright("key", BITS - top).alias("bin")).agg(
        F.sum("bytes").alias("b"), F.count("*").alias("n")
    )
    first = depth + 1 if depth else 0
    spread = stored(bins, "bins").select(
        "bin", "b", "n", F.explode(F.sequence(F.lit(first), F.lit(top))).alias("depth")
    )
    placed = spread.withColumn("prefix", F.expr(f"shiftright(bin, {top} - depth)"))
    fitting = (
        placed.groupBy("depth", "prefix")
        .agg(F.sum("b").alias("shard_bytes"), F.sum("n").alias("shard_docs"))
        .filter(f"shard_bytes <= {limit} or shard_docs = 1")
    )
    found = placed.select("bin", "depth", "prefix").join(fitting, ["depth", "prefix"])
    best = F.min(F.struct("depth", "prefix", "shard_bytes", "shard_docs")).alias("s")
    return found.groupBy("bin").agg(best).select("bin", "s.*")


def _overflow(rows: DataFrame, limit: int) -> DataFrame:
    """Buckets of one hash value that exceed the limit, as after all 60 bits: cut into runs.

    A row over half the limit is a shard alone; the others are cut where their
    running size passes a multiple of half the limit, so no run exceeds the limit.
    """
    half = max(1, limit // 2)
    small = F.when(F.col("bytes") <= half, F.col("bytes")).otherwise(0)
    order = W.partitionBy("key").orderBy("bytes", "doc_id")
    before = F.sum(small).over(order.rowsBetween(W.unboundedPreceding, 0)) - small
    place = F.row_number().over(order)
    run = F.when(F.col("bytes") <= half, F.floor(before / half)).otherwise(-place)
    cut = rows.withColumn("overflow", run.cast("long"))
    sums = cut.groupBy("key", "overflow").agg(
        F.sum("bytes").alias("shard_bytes"), F.count("*").alias("shard_docs")
    )
    return cut.join(sums, ["key", "overflow"]).select(
        "doc_id", "bytes", F.lit(BITS).alias("depth"), F.col("key").alias("prefix"), "overflow",
        "shard_bytes", "shard_docs",
    )


def assign_shards(
    docs: DataFrame, limit: int, id_col: str = "doc_id", text: str = "text", step: int = STEP
) -> DataFrame:
    """One row per row of ``docs``: doc_id, bytes, shard, depth, overflow, shard_bytes, shard_docs.

    ``bytes`` is the length of the text in UTF-8, 0 for null. ``shard`` is the
    hash prefix in bits, empty for the only bucket. A document over the limit has
    a shard of its own. Rows with the same id share all bits; where they exceed
    the limit together, ``overflow`` numbers their runs, otherwise it is 0.
    An empty table has no shards.
    """
    rows = stored(
        docs.select(
            F.col(id_col).alias("doc_id"),
            hash_bits(F.col(id_col)).alias("key"),
            F.octet_length(fold(text)).cast("long").alias("bytes"),
        ),
        "keys",
    )
    done, depth = [], 0
    while True:
        top = min(depth + step, BITS)
        leaves = stored(_leaves(rows, depth, top, limit), "leaves")
        bin_of = rows.withColumn("bin", F.shiftright("key", BITS - top))
        done.append(
            bin_of.join(leaves, "bin").select(
                "doc_id", "bytes", "depth", "prefix", F.lit(0).cast("long").alias("overflow"),
                "shard_bytes", "shard_docs",
            )
        )
        rest = stored(bin_of.join(leaves.select("bin"), "bin", "left_anti").drop("bin"), "keys")
        if rest.isEmpty():
            break
        if top == BITS:
            done.append(_overflow(rest, limit))
            break
        rows, depth = rest, top
    named = reduce(DataFrame.unionByName, done)
    shard = F.expr("lpad(bin(prefix), depth, '0')")
    return named.withColumn("shard", shard).select(
        "doc_id", "bytes", "shard", F.col("depth").cast("long"), "overflow", "shard_bytes", "shard_docs"
    )

"""Mixing sources to target weights by capped water-filling and seeded repetition.

All is decided by one narrow table of ids, sources, and sizes and one row per
source. A document's copies follow from its own key and its source's row, so the
texts are never shuffled and a source of any size is spread over all tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lodestone.llm.common import whole_row, words
from lodestone.session import stored

_BIN = 4  # hex digits of a key that name its bin: 65,536 bins per source


def sample_key(doc_id: Column, seed: int) -> Column:
    """The place of a document in the seeded order of its source."""
    return F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))))


def sizes(docs: DataFrame, id_col: str, source: str, text: str, seed: int, *more: Column) -> DataFrame:
    """``doc_id, source, size, key`` per row: size in words, key for sampling."""
    return docs.select(
        F.col(id_col).alias("doc_id"),
        F.col(source).alias("source"),
        words(text).alias("size"),
        sample_key(F.col(id_col), seed).alias("key"),
        *more,
    )


def repeating_weights(sources: DataFrame, pattern: tuple[int, ...]) -> DataFrame:
    """A weight per source: the pattern over sources by code point, null last, again and again."""
    place = F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())) - 1
    values = F.array(*[F.lit(float(w)) for w in pattern])
    return sources.select("source").distinct().withColumn("weight", F.get(values, place % len(pattern)))


def targets(sources: DataFrame, share: float, max_epochs: float) -> DataFrame:
    """Water-filling over ``source, weight, source_size``; adds ``target``.

    ``share`` of all sizes is dealt out by weight; no source gets more than
    ``max_epochs`` times its size, and what it can't take goes to the others by
    weight. Sources are clamped in the order of cap per weight; filling the rest
    evenly gives a level at every source, rising up to the first unclamped one
    and falling after it, so the greatest level is the final one. One row per
    source passes a single window.
    """
    ranked = sources.withColumns(
        {"cap": max_epochs * F.col("source_size"), "total": share * F.sum("source_size").over(W.partitionBy())}
    ).withColumn("per_weight", F.col("cap") / F.col("weight"))
    order = W.orderBy("per_weight", F.col("source").asc_nulls_last())
    before = F.coalesce(F.sum("cap").over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0))
    rest = F.sum("weight").over(order.rowsBetween(0, W.unboundedFollowing))
    level = ranked.withColumn("level", (F.col("total") - before) / rest)
    filled = level.withColumn("level", F.max("level").over(W.partitionBy()))
    return filled.withColumn("target", F.least("cap", F.col("level") * F.col("weight"))).select(
        "source", "weight", "source_size", "target"
    )


def _order() -> Column:
    return F.struct(
        F.col("key"),
        F.coalesce(F.col("doc_id").cast("long"), F.lit(-(2**63))).alias("doc_id"),
        F.col("size"),
    )


def plan(rows: DataFrame, sources: DataFrame) -> DataFrame:
    """How often each source's documents are taken: ``whole`` times, and once more up to ``cut``.

    The fraction left after whole repetitions is taken from the front of the
    source's seeded order, to the document that comes nearest to the target.
    Sizes are summed by bins of keys first; only the bin in which a source
    reaches its target is looked at by document.
    """
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    wanted = sources.withColumn("whole", F.floor(ratio)).withColumn(
        "need", F.col("target") - F.col("whole") * F.col("source_size")
    )
    named = rows.withColumn("bin", F.substring("key", 1, _BIN))
    ahead = W.partitionBy("source").orderBy("bin").rowsBetween(W.unboundedPreceding, -1)
    bins = named.groupBy("source", "bin").agg(F.sum("size").alias("in_bin"))
    bins = bins.withColumn("before", F.coalesce(F.sum("in_bin").over(ahead), F.lit(0)))
    b, s = bins.alias("b"), wanted.filter("need > 0").alias("s")
    crossing = stored(
        b.join(s, F.col("b.source").eqNullSafe(F.col("s.source")))
        .filter("before <= need and before + in_bin >= need")
        .select("b.source", "bin", "before", "need"),
        "crossing",
    )
    n, c = named.alias("n"), crossing.alias("c")
    close = n.join(c, F.col("n.source").eqNullSafe(F.col("c.source")) & (F.col("n.bin") == F.col("c.bin")))
    close = close.select("n.source", "n.bin", "doc_id", "size", "key", "before", "need")
    run = W.partitionBy("source", "bin").orderBy(_order()).rowsBetween(W.unboundedPreceding, 0)
    middle = 2 * (F.col("before") + F.sum("size").over(run)) - F.col("size")
    taken = close.withColumn("middle", middle).filter("middle <= 2 * need")
    start = F.struct(
        F.col("bin").alias("key"), F.lit(-(2**63)).alias("doc_id"), F.lit(0).cast("long").alias("size")
    )
    cuts = taken.select("source", _order().alias("cut")).union(crossing.select("source", start))
    cuts = cuts.groupBy("source").agg(F.max("cut").alias("cut"))
    s, c = wanted.alias("s"), cuts.alias("c")
    return s.join(c, F.col("s.source").eqNullSafe(F.col("c.source")), "left").select("s.*", "c.cut")


def mixed(
    rows: DataFrame, weights: DataFrame, share: float, max_epochs: float
) -> tuple[DataFrame, DataFrame]:
    """Sources with target, whole repetitions and cut, and the rows with their ``copies``."""
    found = rows.groupBy("source").agg(F.sum("size").alias("source_size")).alias("f")
    w = weights.alias("w")
    sources = found.join(w, F.col("f.source").eqNullSafe(F.col("w.source"))).select(
        "f.source", "weight", "source_size"
    )
    planned = stored(plan(rows, targets(sources, share, max_epochs)), "mix")
    return planned, _with_copies(rows, planned)


def _with_copies(rows: DataFrame, planned: DataFrame) -> DataFrame:
    r, p = rows.alias("r"), planned.alias("p")
    more = F.coalesce((_order() <= F.col("cut")).cast("long"), F.lit(0))
    return r.join(p, F.col("r.source").eqNullSafe(F.col("p.source"))).select(
        "r.*", "source_size", "target", (F.col("whole") + more).alias("copies")
    )


def mix_sizes(
    docs: DataFrame,
    pattern: tuple[int, ...] = (3, 1, 2),
    share: float = 1.5,
    max_epochs: float = 2.0,
    seed: int = 17,
    id_col: str = "doc_id",
    source: str = "source",
    text: str = "text",
) -> DataFrame:
    """One row per row of ``docs``: doc_id, size, source_size, target, taken.

    Null text has size 0; a null source is a source of its own; rows repeated are
    documents of their own that are taken alike, but for the one at a source's
    cut; rows without an id share one place in the order. No rows: no rows.
    """
    rows = stored(sizes(docs, id_col, source, text, seed), "sizes")
    weights = repeating_weights(rows, pattern)
    _, taken = mixed(rows, weights, share, max_epochs)
    return taken.select(
        "doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken")
    )


def mix(
    docs: DataFrame,
    weights: DataFrame | tuple[int, ...] = (3, 1, 2),
    share: float = 1.5,
    max_epochs: float = 2.0,
    seed: int = 17,
    id_col: str = "doc_id",
    source: str = "source",
    text: str = "text",
) -> DataFrame:
    """The mix itself: the rows of ``docs``, each as often as it is taken.

    ``weights`` is a table ``source, weight`` or a pattern for the sources by code
    point. A source without a weight is left out; weights must be positive.
    """
    rows = stored(sizes(docs, id_col, source, text, seed), "sizes")
    table = weights if isinstance(weights, DataFrame) else repeating_weights(rows, weights)
    planned, _ = mixed(rows, table, share, max_epochs)
    keyed = sizes(docs, id_col, source, text, seed, whole_row(docs).alias("row"))
    taken = _with_copies(keyed, planned).filter("copies > 0")
    return taken.select("row", F.explode(F.sequence(F.lit(1).cast("long"), "copies"))).select("row.*")

"""Merging small documents of one site section into larger ones.

Within a section, documents are taken in URL order. Small ones (fewer than
``min_words`` words) are gathered until the gathered text, headings included,
reaches ``min_words``; a large document passes unchanged and ends whatever was
being gathered.

Gathering is a running fold that starts over, so no window sum expresses it,
and one section may hold a large share of the corpus, so no task may own a
whole section. The work is therefore cut by *range*: documents are range
partitioned in (section, URL) order, a large section spanning many partitions.
The only thing one partition needs from the ones before it is the word count
gathered so far, a number below ``min_words``. A first pass computes for each
partition how it maps that number to the one it passes on; composing these few
numbers on the driver gives every partition its start, and a second pass
assigns documents to their merged groups.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.functions.text import word_count
from lodestone.functions.urls import base_path
from lodestone.session import checkpointed, stored

_CARRIED = -1
_SUMMARY = "block int, first_base string, last_base string, counts array<int>, starts array<bigint>"
_MEMBER_COLUMNS = ["base", "url", "tie", "row", "text", "last_modified"]


@dataclass
class Gathering:
    """Words gathered so far in a section, and the group they belong to."""

    base: str | None = None
    words: int = 0
    label: str | None = None


def _intro(base: Column) -> Column:
    return F.concat(F.lit("Combined content from "), base, F.lit(":"))


def _heading(url: Column) -> Column:
    return F.concat(F.lit("From "), url, F.lit(":"))


def _in_url_order(docs: DataFrame, min_words: int, order_col: str | None) -> DataFrame:
    """Documents in (section, URL) order, range partitioned and made stable.

    Texts of large documents stay behind: only the small ones are moved. Equal
    URLs follow ``order_col`` when given, else their text; exact copies are told
    apart by a row id so that even they spread over partitions.
    """
    text = F.coalesce("text", F.lit(""))
    small = F.col("n_words") < min_words
    rows = (
        docs.withColumn("base", base_path("url"))
        .withColumn("n_words", word_count("text"))
        .select(
            "base",
            "url",
            (F.col(order_col) if order_col else F.xxhash64(text)).alias("tie"),
            F.monotonically_increasing_id().alias("row"),
            F.when(small, F.col("n_words") + word_count(_heading(F.col("url")))).alias("weight"),
            word_count(_intro(F.col("base"))).alias("intro"),
            F.when(small, text).alias("text"),
            F.when(small, F.col("last_modified")).alias("last_modified"),
        )
    )
    # Stored before it is ordered: range partitioning samples its input first, and
    # the whole corpus should be read and counted only once.
    rows = stored(rows)
    order = ["base", "url", "tie", "row"]
    ordered = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    return checkpointed(ordered.withColumn("block", F.spark_partition_id()))


def _summaries(min_words: int):
    """First pass: how each partition carries gathered words through."""

    def summarise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = base = block = None
        # Entry s: words after the rows so far, had s words been gathered before.
        counts = np.arange(min_words)
        starts = np.full(min_words, _CARRIED)
        position = -1
        for batch in batches:
            columns = (batch.column(c).to_pylist() for c in ("block", "base", "weight", "intro"))
            for block, row_base, weight, intro in zip(*columns):
                position += 1
                if position == 0:
                    first = base = row_base
                if row_base != base or weight is None:
                    base = row_base
                    counts, starts = np.zeros(1, int), np.full(1, _CARRIED)
                if weight is None:
                    continue
                starts = np.where(counts == 0, position, starts)
                counts = np.where(counts == 0, intro + weight, counts + weight)
                closed = (counts >= min_words) | (counts == 0)
                counts, starts = np.where(closed, 0, counts), np.where(closed, _CARRIED, starts)
                if len(counts) > 1 and (counts == counts[0]).all() and (starts == starts[0]).all():
                    counts, starts = counts[:1], starts[:1]
        if position < 0:
            return
        yield pa.RecordBatch.from_pydict(
            {
                "block": pa.array([block], pa.int32()),
                "first_base": pa.array([first], pa.string()),
                "last_base": pa.array([base], pa.string()),
                "counts": pa.array([counts.tolist()], pa.list_(pa.int32())),
                "starts": pa.array([starts.tolist()], pa.list_(pa.int64())),
            }
        )

    return summarise


def _starting_points(ordered: DataFrame, min_words: int) -> dict[int, Gathering]:
    """What each partition starts with; one short row per partition is collected."""
    summary = ordered.select("block", "base", "weight", "intro").mapInArrow(_summaries(min_words), _SUMMARY)
    points: dict[int, Gathering] = {}
    state = Gathering()
    for block in sorted(summary.collect(), key=lambda r: r["block"]):
        if state.base != block["first_base"]:
            state = Gathering()
        points[block["block"]] = state
        at = state.words if len(block["counts"]) > 1 else 0
        words, start = block["counts"][at], block["starts"][at]
        label = state.label if start == _CARRIED else f"{block['block']}:{start}"
        state = Gathering(block["last_base"], words, label if words else None)
    return points


def _assign(min_words: int, keep_pending: bool, points: dict[int, Gathering]):
    """Second pass: label every small document with its group.

    A large document that ends an unfinished group is passed on with that
    group's label, marked as giving it up.
    """

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base = words = label = block = None
        position = -1
        for batch in batches:
            if block is None and batch.num_rows:
                block = batch.column("block")[0].as_py()
                start = points[block]
                base, words, label = start.base, start.words, start.label
            taken, labels, dropped = [], [], []
            columns = (batch.column(c).to_pylist() for c in ("base", "weight", "intro"))
            for i, (row_base, weight, intro) in enumerate(zip(*columns)):
                position += 1
                if row_base != base:
                    base, words = row_base, 0
                ends = weight is None
                if ends and (words == 0 or keep_pending):
                    words = 0
                    continue
                if not ends and words == 0:
                    words, label = intro, f"{block}:{position}"
                taken.append(i)
                labels.append(label)
                dropped.append(ends)
                words = 0 if ends else words + weight
                if words >= min_words:
                    words = 0
            kept = batch.take(pa.array(taken, pa.int64())).select(_MEMBER_COLUMNS)
            yield pa.RecordBatch.from_arrays(
                [*kept.columns, pa.array(labels, pa.string()), pa.array(dropped, pa.bool_())],
                names=[*_MEMBER_COLUMNS, "label", "dropped"],
            )

    return assign


def _merge(members: DataFrame) -> DataFrame:
    """One document per group. A group has fewer than ``min_words`` members."""
    member = F.when(~F.col("dropped"), F.struct("url", "tie", "row", "text"))
    ordered = F.array_sort(F.collect_list(member))
    body = F.transform(
        ordered, lambda m: F.concat(F.lit("\n"), _heading(m["url"]), F.lit("\n"), m["text"], F.lit("\n"))
    )
    groups = members.groupBy("base", "label").agg(
        F.max("dropped").alias("dropped"),
        F.concat(_intro(F.col("base")), F.lit("\n\n"), F.array_join(body, "")).alias("text"),
        F.transform(ordered, lambda m: m["url"]).alias("sources"),
        F.max("last_modified").alias("last_modified"),
    )
    return groups.filter(~F.col("dropped")).select(
        F.col("base").alias("url"),
        "text",
        F.lit("combined").alias("type"),
        "last_modified",
        "sources",
        F.lit(True).alias("combined"),
        F.col("base").alias("base_path"),
    )


def combine_small(
    docs: DataFrame,
    min_words: int = 100,
    keep_pending: bool = False,
    order_col: str | None = None,
) -> DataFrame:
    """Merge small documents by site section; see the module text for the rule.

    ``docs`` is (url, text, type[, last_modified]). By default a group that a
    large document cuts short is left out, with the small documents in it, as
    the original rule has it; ``keep_pending=True`` writes it out instead. A
    merged document takes the newest ``last_modified`` of its members, so that
    change detection works on it.
    """
    if "last_modified" not in docs.columns:
        docs = docs.withColumn("last_modified", F.lit(None).cast("timestamp_ntz"))
    large = docs.filter(word_count("text") >= min_words).select(
        "url",
        "text",
        "type",
        "last_modified",
        F.lit(None).cast("array<string>").alias("sources"),
        F.lit(False).alias("combined"),
        F.lit(None).cast("string").alias("base_path"),
    )
    ordered = _in_url_order(docs, min_words, order_col)
    points = _starting_points(ordered, min_words)
    fields = {f.name: f.dataType.simpleString() for f in ordered.schema.fields}
    ddl = ", ".join(f"{c} {fields[c]}" for c in _MEMBER_COLUMNS)
    members = ordered.mapInArrow(
        _assign(min_words, keep_pending, points), f"{ddl}, label string, dropped boolean"
    )
    return large.unionByName(_merge(members))


def combine_report(before: DataFrame, after: DataFrame) -> DataFrame:
    """Number of documents before and after merging, as one row."""
    return before.agg(F.count("*").alias("documents_in")).crossJoin(
        after.agg(F.count("*").alias("documents_out"))
    )

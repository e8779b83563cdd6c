"""Exact nearest vectors by cosine similarity.

Questions, measured to be small, go to every task, and the corpus stays where it is:
each task keeps the best k per question while it streams its share of the corpus
and emits only those, as question, row and score. More questions than that meet the
corpus in a grid: both are dealt into groups of bounded size, a cell takes one group
of each, and only the best k of a cell leave it. Nothing of a grid passes through
the driver.

The other columns of the corpus, texts above all, take no part in this. They are
fetched at the end, for the rows that were found.

Similarities are rounded to ``DIGITS`` before ranking, ties going to the lower
id, so the ranking does not depend on how the work was split.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestone.session import stored

TOP_K = 5
DIGITS = 9
BROADCAST_BYTES = 64 * 1024 * 1024
BLOCK_BYTES = 64 * 1024 * 1024
# What a found row takes in a broadcast, its id included, at a generous guess.
HIT_BYTES = 256
# Similarities held at once while a batch meets the questions.
TILE_CELLS = 1_000_000
# Questions whose hits a task gathers at a time.
HIT_ROWS = 8192
# What a cell of the grid holds of questions, and of the corpus, in double precision.
GROUP_BYTES = 16 * 1024 * 1024
# Groups of either side at least, so that a small grid has work for many tasks.
MIN_GROUPS = 8


def _unit_rows(rows: pa.Table) -> tuple[np.ndarray, pa.Table]:
    """Vectors at unit length in double precision, and the other columns.

    Rows a cosine is not defined for (a missing or infinite value, or all
    zeros) are left out of both.
    """
    values = rows.column("values").combine_chunks()
    lengths = pc.unique(pc.list_value_length(values)).to_pylist()
    if len(lengths) > 1:
        raise ValueError(f"vectors of different dimensions: {sorted(lengths)}")
    flat = values.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    matrix = flat.reshape(len(values), -1)
    length = np.sqrt((matrix * matrix).sum(axis=1))
    usable = np.isfinite(length) & (length > 0)
    others = rows.drop_columns(["values"])
    if not usable.all():
        matrix, length, others = matrix[usable], length[usable], others.filter(pa.array(usable))
    return matrix / length[:, None], others


def _first_k(q: np.ndarray, c: np.ndarray, s: np.ndarray, place: np.ndarray, k: int):
    """Of the pairs (question, row, score), the k best of each question."""
    order = np.lexsort((place[c], -s, q))
    q, c, s = q[order], c[order], s[order]
    keep = np.arange(len(q)) - np.searchsorted(q, q, side="left") < k
    return q[keep], c[keep], s[keep]


def _prepared(corpus: pa.Table, dimension: int) -> tuple[np.ndarray, pa.Table, np.ndarray] | None:
    """Unit vectors, other columns and places in id order of one batch; none when it has no usable row."""
    if not corpus.num_rows:
        return None
    matrix, payload = _unit_rows(corpus)
    if not len(matrix):
        return None
    if matrix.shape[1] != dimension:
        raise ValueError(f"vectors have {matrix.shape[1]} dimensions, questions {dimension}")
    # Position of each row in id order, so that ties are settled on integers.
    place = np.empty(len(matrix), dtype=np.int64)
    place[pc.sort_indices(payload.column("id")).to_numpy()] = np.arange(len(matrix))
    return matrix, payload, place


def _candidates(
    questions: np.ndarray,
    names: pa.Array,
    corpus: tuple[np.ndarray, pa.Table, np.ndarray],
    k: int,
    floor: np.ndarray | None = None,
) -> pa.Table:
    """The k best rows of one prepared batch for every question; with ``floor``, of those that reach the question's."""
    matrix, payload, place = corpus
    found = []
    step = max(1, TILE_CELLS // len(matrix))
    for start in range(0, len(questions), step):
        scores = questions[start : start + step] @ matrix.T
        np.round(scores, DIGITS, out=scores)
        least = None if floor is None else floor[start : start + step, None]
        if k < scores.shape[1] and (least is None or np.count_nonzero(scores >= least) > 2 * k * len(scores)):
            best = np.partition(scores, -k, axis=1)[:, -k, None].copy()
            least = best if least is None else np.maximum(best, least)
        if least is not None:
            q, c = np.nonzero(scores >= least)
        else:
            q, c = (a.ravel() for a in np.indices(scores.shape))
        q, c, s = _first_k(q, c, scores[q, c], place, k)
        found.append((q + start, c, s))
    q, c, s = (np.concatenate(a) for a in zip(*found))
    hits = payload.take(pa.array(c))
    hits = hits.append_column("query_id", names.take(pa.array(q)))
    return hits.append_column("similarity", pa.array(s)).append_column("_q", pa.array(q))


def _raise_floor(floor: np.ndarray, kept: pa.Table, k: int) -> None:
    """Set the floor of each question that has k rows to the score of the last; ``kept`` is as ``_best`` gives it."""
    q = kept.column("_q").to_numpy()
    last = np.flatnonzero(np.append(q[1:] != q[:-1], True)) if len(q) else np.empty(0, np.int64)
    full = last[np.diff(last, prepend=-1) >= k]
    floor[q[full]] = kept.column("similarity").to_numpy()[full]


def _questions(rows: pa.Table) -> tuple[np.ndarray | None, pa.Array]:
    if not rows.num_rows:
        return None, rows.column("query_id").combine_chunks()
    matrix, names = _unit_rows(rows)
    return matrix, names.column("query_id").combine_chunks()


def _best(hits: pa.Table, k: int) -> pa.Table:
    """The k best rows of each question, ties by id."""
    order = pc.sort_indices(
        hits, sort_keys=[("_q", "ascending"), ("similarity", "descending"), ("id", "ascending")]
    )
    q = hits.column("_q").to_numpy()[order.to_numpy()]
    first = np.searchsorted(q, q, side="left")
    return hits.take(order.filter(pa.array(np.arange(len(q)) - first < k)))


def _merge(kept: pa.Table | None, fresh: pa.Table, k: int) -> pa.Table:
    return _best(fresh if kept is None else pa.concat_tables([kept, fresh]), k)


def _rank(hits: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.desc("similarity"), F.asc("id"))
    return hits.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def search(
    questions: DataFrame,
    corpus: DataFrame,
    k: int = TOP_K,
    broadcast_bytes: int = BROADCAST_BYTES,
    block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """The ``k`` most similar corpus rows for every question, best first.

    ``questions`` is (query_id, values); ``corpus`` is (id, values) and any
    further columns but maps, which come back with the hits. Vectors must be of one
    dimension. Filter the corpus by namespace before the call, so that the
    partition filter reaches the scan.

    Questions of up to ``broadcast_bytes`` are answered in one pass over the
    vectors. More of them meet the vectors in a grid, where a task multiplies at most
    ``block_bytes`` of questions at a time. Further columns are read in a pass of their
    own, so pass a stored corpus.
    """
    questions = questions.select("query_id", "values").filter("values is not null")
    columns = [c for c in corpus.columns if c != "values"]
    carried = [c for c in columns if c != "id"]
    if carried:
        # Rows of one id are told apart by their columns; those equal in all may stand for one another.
        corpus = corpus.withColumn("_row", F.xxhash64(*carried))
    key = ["id", "_row"] if carried else ["id"]
    vectors = corpus.filter("values is not null").select(*key, "values")
    head = questions.select(F.size("values").alias("n")).take(1)
    dimension = head[0]["n"] if head else 1
    bound = max(1, broadcast_bytes // (8 * dimension))
    small = questions.limit(bound + 1).toArrow()
    types = {f.name: f.dataType.simpleString() for f in [*vectors.schema.fields, *questions.schema.fields]}
    ddl = ", ".join(f"{c} {types[c]}" for c in [*key, "query_id"]) + ", similarity double"
    if small.num_rows <= bound:
        found = _rank(_hits(small, vectors, k, ddl), k)
    else:
        found = _grid(questions, vectors, k, ddl, dimension, min(HIT_ROWS, max(1, block_bytes // (8 * dimension))))
    if carried:
        if small.num_rows <= bound and small.num_rows * k * HIT_BYTES <= broadcast_bytes:
            found = F.broadcast(found)
        else:
            found = stored(found, "found")
        found = _fetch(found, corpus.select(*key, *carried), key)
    return found.select("query_id", "rank", *columns, "similarity")


def _fetch(found: DataFrame, corpus: DataFrame, key: list[str]) -> DataFrame:
    """The rows that were found, with their other columns.

    They are broadcast, or stored so that the join is planned by their real size;
    the corpus is moved only where they are many. Equal rows of the corpus all
    match, so each rank takes one.
    """
    wanted = found.withColumnsRenamed({c: f"_found_{c}" for c in key})
    same = [corpus[c].eqNullSafe(wanted[f"_found_{c}"]) for c in key]
    matched = corpus.join(wanted, same).drop(*[f"_found_{c}" for c in key])
    return matched.dropDuplicates(["query_id", "rank"])


def _hits(block: pa.Table, vectors: DataFrame, k: int, ddl: str) -> DataFrame:
    """What the tasks find best for one block of questions."""
    shared = vectors.sparkSession.sparkContext.broadcast(_questions(block))

    def best_of_partition(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matrix, names = shared.value
        blocks = [slice(at, at + HIT_ROWS) for at in range(0, len(names), HIT_ROWS)]
        floor = np.full(len(names), -np.inf)
        kept = [None] * len(blocks)
        for batch in batches if blocks else ():
            corpus = _prepared(pa.Table.from_batches([batch]), matrix.shape[1])
            for n, block in enumerate(blocks if corpus else ()):
                fresh = _candidates(matrix[block], names[block], corpus, k, floor[block])
                kept[n] = _merge(kept[n], fresh, k)
                _raise_floor(floor[block], kept[n], k)
        for best in kept:
            if best is not None:
                yield from best.drop_columns(["_q"]).to_batches()

    return vectors.mapInArrow(best_of_partition, ddl)


def _grid(questions: DataFrame, vectors: DataFrame, k: int, ddl: str, dimension: int, block_rows: int) -> DataFrame:
    """Every group of questions meets every group of vectors in a cell of its own.

    Places are dealt in turn, so that groups are of one size whatever the ids are.
    Each row goes to as many cells as the other side has groups.
    """
    questions, vectors = stored(questions, "questions"), stored(vectors, "corpus-vectors")
    group_rows = max(1, GROUP_BYTES // (8 * dimension))
    across, down = (max(MIN_GROUPS, -(-side.count() // group_rows)) for side in (questions, vectors))

    def dealt(side: DataFrame, own: str, groups: int, other: str, others: int) -> DataFrame:
        place = F.pmod(F.monotonically_increasing_id(), F.lit(groups)).cast("int")
        cells = F.explode(F.sequence(F.lit(0), F.lit(others - 1)))
        return side.withColumn(own, place).withColumn(other, cells).groupBy("_across", "_down")

    found = [f.split(" ")[0] for f in ddl.split(", ")]

    def best_of_cell(asked: pa.Table, rows: pa.Table) -> pa.Table:
        matrix, names = _questions(asked.select(["query_id", "values"]))
        rows = rows.drop_columns(["_across", "_down"])
        none = rows.drop_columns(["values"]).slice(0, 0).append_column("query_id", names.slice(0, 0))
        best = [none.append_column("similarity", pa.array([], pa.float64())).select(found)]
        corpus = _prepared(rows, matrix.shape[1]) if len(names) else None
        for at in range(0, len(names) if corpus else 0, block_rows):
            block = slice(at, at + block_rows)
            best.append(_candidates(matrix[block], names[block], corpus, k).select(found))
        return pa.concat_tables(best)

    asked = dealt(questions, "_across", across, "_down", down)
    cells = asked.cogroup(dealt(vectors, "_down", down, "_across", across)).applyInArrow(best_of_cell, ddl)
    # An id that several questions share is ranked as one question.
    return _rank(cells, k)

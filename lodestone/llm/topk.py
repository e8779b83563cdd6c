"""Exact top-k by inner product, block at a time.

Vectors are sorted so that alike ones lie together, and cut into ranges and blocks
that keep, for every dimension, the least and greatest value in them. The sum over
dimensions of what a query can gain at most bounds its score in a block. A query
first scores the range it lies in, which gives a k-th score to beat; in every
other range the blocks are taken in the order of their bounds and scored until a
bound falls below the k-th score so far.

Blocks of queries meet ranges in an equi-join on the number of a group of ranges,
after whole groups have been ruled out by their own bounds. Tasks return at most k
rows per query and range, and only those that can still matter.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lodestone.session import stored

SCALE = 64
BLOCK = 256  # vectors of a block
RANGE_ROWS = 4_096  # vectors of a range, at most
MOST_GROUPS = 1_024  # groups of ranges, at most

_RANGES = "group int, dims int, n int, ids binary, matrix binary"
_BOUNDS = "group int, dims int, low binary, high binary"
_QUERIES = "dims int, n int, ids binary, matrix binary, floor binary"
_HITS = "query_id long, vec_id long, score long"


def quantized(vectors: DataFrame, id_col: str, vector: str) -> DataFrame:
    """``vec_id, q``: components as floor(SCALE * x); vectors with a missing or non-finite one are left out."""
    x = F.col(vector).cast("array<double>")
    bad = F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    kept = vectors.filter(x.isNotNull() & ~bad & F.col(id_col).isNotNull())
    q = F.transform(x, lambda v: F.floor(SCALE * v).cast("long"))
    return kept.select(F.col(id_col).cast("long").alias("vec_id"), q.alias("q"))


def _alike(q) -> list:
    """A sort key that puts vectors with the same large components together."""
    place = F.transform(q, lambda v, i: F.struct(F.abs(v).alias("a"), F.when(v < 0, -i - 1).otherwise(i + 1).alias("i")))
    top = F.slice(F.reverse(F.array_sort(place)), 1, 3)
    return [F.size(q).alias("dims"), F.transform(top, lambda s: s["i"]).alias("alike")]


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of integer rows: in floating point where nothing can be lost, and
    in numbers of any size where 64 bits may not do."""
    if a.size == 0 or b.size == 0:
        return np.zeros((len(a), len(b)), np.int64)
    most = np.abs(a.astype(np.float64)).max() * np.abs(b.astype(np.float64)).max() * a.shape[1]
    if most < 2.0**53:
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    return a @ b.T if most < 2.0**61 else a.astype(object) @ b.T.astype(object)


def _long(numbers: np.ndarray) -> np.ndarray:
    """As 64-bit numbers; what is beyond them becomes the nearest."""
    most = 2**63 - 1
    return np.clip(numbers, -most, most).astype(np.int64)


def bounds(queries: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """The most each query can score in each block, given the blocks' least and greatest values."""
    positive, negative = np.maximum(queries, 0), np.minimum(queries, 0)
    return _long(products(positive, high) + products(negative, low))


def _best(ids: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    """Places of the k best by score, then by smaller id."""
    return np.lexsort((ids, -scores))[:k]


class _Search:
    """The k best of each query so far, over blocks in any order."""

    def __init__(self, ids: np.ndarray, matrix: np.ndarray, floor: np.ndarray, k: int):
        self.ids, self.matrix, self.floor, self.k = ids, matrix, floor.copy(), k
        self.found = [(np.zeros(0, np.int64), np.zeros(0, np.int64)) for _ in ids]

    def scan(self, ids: np.ndarray, matrix: np.ndarray) -> None:
        """Score the blocks of a range, best bound first, until none can reach the floor."""
        blocks = [(ids[i : i + BLOCK], matrix[i : i + BLOCK]) for i in range(0, len(ids), BLOCK)]
        low, high = (np.array([f(m, axis=0) for _, m in blocks]) for f in (np.min, np.max))
        bound = bounds(self.matrix, low, high)
        order = np.argsort(-bound, axis=1, kind="stable")
        active = np.arange(len(self.ids))
        for step in range(len(blocks)):
            turn = order[active, step]
            go = bound[active, turn] >= self.floor[active]
            active, turn = active[go], turn[go]
            if not len(active):
                return
            for b in np.unique(turn):
                rows = active[turn == b]
                self._score(rows, *blocks[b])

    def _score(self, rows: np.ndarray, ids: np.ndarray, matrix: np.ndarray) -> None:
        scores = _long(products(self.matrix[rows], matrix))
        hits = scores >= self.floor[rows, None]
        for r, row, good in zip(rows, scores, hits, strict=True):
            take = np.flatnonzero(good & (ids != self.ids[r]))
            if not len(take):
                continue
            kept, kept_scores = self.found[r]
            every, every_scores = np.concatenate([kept, ids[take]]), np.concatenate([kept_scores, row[take]])
            best = _best(every, every_scores, self.k)
            self.found[r] = every[best], every_scores[best]
            if len(best) == self.k:
                self.floor[r] = max(self.floor[r], every_scores[best[-1]])

    def hits(self) -> pa.RecordBatch:
        counts = [len(ids) for ids, _ in self.found]
        empty = [np.zeros(0, np.int64)]
        return pa.RecordBatch.from_arrays(
            [
                pa.array(np.repeat(self.ids, counts)),
                pa.array(np.concatenate([ids for ids, _ in self.found] or empty)),
                pa.array(np.concatenate([scores for _, scores in self.found] or empty)),
            ],
            ["query_id", "vec_id", "score"],
        )


def _matrix(lists: pa.Array) -> np.ndarray:
    """Lists of equal length as rows."""
    return lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(len(lists), -1)


def _runs(batch: pa.RecordBatch, most: int):
    """Rows of a batch that have the same number of dimensions, at most ``most`` at a time."""
    dims = batch.column(0).to_numpy()
    start = 0
    while start < len(dims):
        other = np.flatnonzero(dims[start : start + most] != dims[start])
        stop = start + (int(other[0]) if len(other) else min(most, len(dims) - start))
        yield batch.slice(start, stop - start)
        start = stop


def _numbers(raw: bytes, rows: int | None = None) -> np.ndarray:
    flat = np.frombuffer(raw, np.int64)
    return flat if rows is None else flat.reshape(rows, -1)


def _one(schema: str, *values) -> pa.RecordBatch:
    """A row of ints and of arrays as bytes."""
    names = [field.split()[0] for field in schema.split(", ")]
    columns = [
        pa.array([v], pa.int32()) if isinstance(v, int) else pa.array([np.ascontiguousarray(v).tobytes()], pa.binary())
        for v in values
    ]
    return pa.RecordBatch.from_arrays(columns, names)


def _rows(batches):
    for batch in batches:
        yield from zip(*(c.to_pylist() for c in batch.columns), strict=True)


def build_ranges(vectors: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Ranges of all vectors ``vec_id, q``, and the bounds of their groups; both stored.

    Groups are the partitions of a sort by likeness.
    """
    groups = max(1, min(MOST_GROUPS, -(-vectors.count() // RANGE_ROWS)))
    order = ("dims", "alike", "vec_id")
    keyed = vectors.select("vec_id", "q", *_alike(F.col("q")))
    ordered = keyed.repartitionByRange(groups, *order).sortWithinPartitions(*order)

    def pack(batches):
        from pyspark import TaskContext

        group = TaskContext.get().partitionId()
        for batch in batches:
            for run in _runs(batch, RANGE_ROWS):
                matrix = _matrix(run.column(2))
                yield _one(_RANGES, group, matrix.shape[1], len(matrix), run.column(1).to_numpy(), matrix)

    ranges = stored(ordered.select("dims", "vec_id", "q").mapInArrow(pack, _RANGES), "ranges")

    def bound(batches):
        seen: dict[tuple[int, int], tuple[np.ndarray, np.ndarray]] = {}
        for group, dims, n, _, matrix in _rows(batches):
            m = _numbers(matrix, n)
            low, high = seen.get((group, dims), (m[0], m[0]))
            seen[group, dims] = np.minimum(low, m.min(axis=0)), np.maximum(high, m.max(axis=0))
        for (group, dims), (low, high) in seen.items():
            yield _one(_BOUNDS, group, dims, low, high)

    return ranges, stored(ranges.mapInArrow(bound, _BOUNDS), "bounds")


def _ask_own(divisor: int, k: int):
    """Queries by range, with the k-th score each has within it as the floor to beat."""

    def run(batches):
        for _, dims, n, ids, matrix in _rows(batches):
            ids, matrix = _numbers(ids), _numbers(matrix, n)
            asked = np.flatnonzero(ids % divisor == 0)
            if len(asked):
                search = _Search(ids[asked], matrix[asked], np.full(len(asked), np.iinfo(np.int64).min), k)
                search.scan(ids, matrix)
                yield _one(_QUERIES, dims, len(asked), search.ids, search.matrix, search.floor)

    return run


def _rule_out(batches):
    """Of a block of queries and the bounds of a group: the queries that may find something there."""
    for dims, n, ids, matrix, floor, group, _, low, high in _rows(batches):
        matrix, floor = _numbers(matrix, n), _numbers(floor)
        keep = bounds(matrix, _numbers(low)[None, :], _numbers(high)[None, :])[:, 0] >= floor
        if keep.any():
            yield _one("group int, " + _QUERIES, group, dims, int(keep.sum()), _numbers(ids)[keep], matrix[keep], floor[keep])


def _search(k: int):
    def run(batches):
        for n, ids, matrix, floor, rows, range_ids, range_matrix in _rows(batches):
            search = _Search(_numbers(ids), _numbers(matrix, n), _numbers(floor), k)
            search.scan(_numbers(range_ids), _numbers(range_matrix, rows))
            yield search.hits()

    return run


def top_k(
    vectors: DataFrame, k: int = 20, divisor: int = 20, id_col: str = "vec_id", vector: str = "embedding"
) -> DataFrame:
    """The k best rows for every row whose id is divisible by ``divisor``: query_id, rank, vec_id, score.

    The score is the inner product of components floor(64 * x). The query's own
    row is no candidate; ties go to the smaller id; a query with fewer candidates
    has fewer rows. Vectors that are null or hold a null or non-finite component,
    and rows without an id, take no part. Vectors meet only those with as many
    dimensions. Scores and components beyond 64 bits become the nearest number
    of 64 bits. Rows that share an id are scored each and as queries share one
    list. No rows: no rows.
    """
    ranges, group_bounds = build_ranges(quantized(vectors, id_col, vector))
    queries = stored(ranges.mapInArrow(_ask_own(divisor, k), _QUERIES), "queries").alias("q")
    # At most MOST_GROUPS rows of two vectors, unless vectors differ in their dimensions.
    bound = F.broadcast(group_bounds).alias("b")
    facing = queries.join(bound, F.col("q.dims") == F.col("b.dims"))
    facing = facing.toDF("dims", "n", "ids", "matrix", "floor", "group", "group_dims", "low", "high")
    asked = facing.mapInArrow(_rule_out, "group int, " + _QUERIES).alias("a")
    r = ranges.alias("r")
    met = asked.join(r, (F.col("a.group") == F.col("r.group")) & (F.col("a.dims") == F.col("r.dims")))
    met = met.select("a.n", "a.ids", "a.matrix", "a.floor", "r.n", "r.ids", "r.matrix")
    hits = met.toDF("n", "ids", "matrix", "floor", "rows", "range_ids", "range_matrix").mapInArrow(_search(k), _HITS)
    best = W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = hits.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")

"""Near-duplicates by MinHash bands, odd sketches, and a comparison of whole shingle sets.

Documents with the same shingle set are one class from the start, so a group of
copies of any size is one row. MinHash bands give buckets of classes; in a bucket
each class is compared with a few centres only, and where that leaves parts of a
bucket unconnected, those parts are compared with the rest of it in blocks. An
odd sketch folds a class's MinHash samples into a parity bitmap; the population
count of the XOR of two sketches estimates their similarity and drops most
candidates before any set is built. What remains is confirmed on whole sets.
"""

from __future__ import annotations

from functools import reduce
from hashlib import blake2b
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import attach_groups, components, fold, small_batches, whole_row
from lodestone.llm.shingles import byte_slices, mix64, shingle_sets
from lodestone.session import stored

BANDS, ROWS = 24, 5
SAMPLES = BANDS * ROWS
SKETCH_BITS = 256
CENTRES = 4  # orders in which buckets choose their centre
BLOCK = 512  # classes of a bucket compared at a time, about
BLOCK_SHINGLES = 500_000  # and their shingles

_SIG = (
    "doc_id long, n_shingles long, d1 long, d2 long, bands array<long>, s0 long, s1 long, s2 long, s3 long"
)
_SETS = "doc_id long, d1 long, hashes array<long>"


def _digest(hashes: np.ndarray) -> tuple[int, int]:
    raw = np.frombuffer(blake2b(hashes.tobytes(), digest_size=16).digest(), np.int64)
    return int(raw[0]), int(raw[1])


def sketches(values: np.ndarray) -> np.ndarray:
    """Odd sketches of samples (documents x samples): four longs per document."""
    parity = np.zeros((len(values), SKETCH_BITS), np.uint8)
    rows = np.arange(len(values))
    for j in range(values.shape[1]):
        parity[rows, mix64(values[:, j] + np.uint64(j + 1)) % np.uint64(SKETCH_BITS)] ^= 1
    return np.packbits(parity, axis=1).view(np.int64)


def min_hashes(hashes: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """The samples of each set; sets lie one after the other and are not empty."""
    draw = np.random.default_rng(20)
    odd = draw.integers(0, 2**63, SAMPLES, np.uint64) * np.uint64(2) + np.uint64(1)
    add = draw.integers(0, 2**63, SAMPLES, np.uint64)
    out = np.empty((len(starts), SAMPLES), np.uint64)
    for j in range(SAMPLES):
        out[:, j] = np.minimum.reduceat(hashes * odd[j] + add[j], starts)
    return out


def bands_of(values: np.ndarray) -> np.ndarray:
    """One bucket number per band, different in every band."""
    grouped = values.reshape(len(values), BANDS, ROWS)
    key = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64), grouped.shape[:2]).copy()
    for r in range(ROWS):
        key = mix64(key * np.uint64(0x9E3779B97F4A7C15) + grouped[:, :, r])
    return key.view(np.int64)


def _sign(batches):
    for batch in batches:
        for rows in byte_slices(batch, 1):
            hashes, offsets = shingle_sets(rows.column(1))
            counts = np.diff(offsets)
            full = np.flatnonzero(counts)
            digests = np.zeros((len(counts), 2), np.int64)
            for i in full:
                digests[i] = _digest(hashes[offsets[i] : offsets[i + 1]])
            bands = np.zeros((len(counts), BANDS), np.int64)
            sketch = np.zeros((len(counts), 4), np.int64)
            if len(full):
                values = min_hashes(hashes, offsets[:-1][full])
                bands[full], sketch[full] = bands_of(values), sketches(values)
            edges = pa.array(np.arange(0, bands.size + 1, BANDS, dtype=np.int32))
            yield pa.RecordBatch.from_arrays(
                [
                    rows.column(0),
                    pa.array(counts.astype(np.int64)),
                    pa.array(digests[:, 0].copy()),
                    pa.array(digests[:, 1].copy()),
                    pa.ListArray.from_arrays(edges, pa.array(bands.ravel())),
                    *[pa.array(sketch[:, j].copy()) for j in range(4)],
                ],
                names=[field.split()[0] for field in _SIG.split(", ")],
            )


def _build_sets(batches):
    """One set per id and digest, as far as the rows of an id lie together."""
    last, seen = None, set()
    for batch in batches:
        for rows in byte_slices(batch, 1):
            hashes, offsets = shingle_sets(rows.column(1))
            spans = zip(offsets[:-1], offsets[1:], strict=True)
            firsts = [_digest(hashes[a:b])[0] if b > a else 0 for a, b in spans]
            lists = pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(hashes.view(np.int64)))
            fresh = []
            for i, key in enumerate(zip(rows.column(0).to_pylist(), firsts, strict=True)):
                if key[0] != last:
                    last, seen = key[0], set()
                if key not in seen:
                    seen.add(key)
                    fresh.append(i)
            made = pa.RecordBatch.from_arrays(
                [rows.column(0), pa.array(firsts, pa.int64()), lists], ["doc_id", "d1", "hashes"]
            )
            yield made if len(fresh) == made.num_rows else made.take(pa.array(fresh, pa.int64()))


def band_miss(similarity: float) -> float:
    """The chance that a pair has no band in common."""
    return (1 - similarity**ROWS) ** BANDS


def sketch_miss(similarity: float) -> np.ndarray:
    """For each number of bits from 0 on, the chance that the sketches of a pair differ in more.

    Each sample that differs, one in ``1 - similarity``, flips two bits anywhere,
    and bits flipped twice agree again: the distribution is followed flip by flip.
    """
    differ = np.zeros(SKETCH_BITS + 1)
    odd = np.eye(1, SKETCH_BITS + 1)[0]
    bits = np.arange(SKETCH_BITS + 1)
    for d in range(SAMPLES + 1):
        differ += comb(SAMPLES, d) * (1 - similarity) ** d * similarity ** (SAMPLES - d) * odd
        for _ in range(2):
            up, down = odd * (SKETCH_BITS - bits) / SKETCH_BITS, odd * bits / SKETCH_BITS
            odd = np.append(0, up[:-1]) + np.append(down[1:], 0)
    return np.append(np.cumsum(differ[:0:-1])[::-1], 0)


def _estimate_allows(threshold: float) -> int:
    """The fewest bits so that sketches lose a pair at the threshold more rarely than bands, and than one in a million."""
    return int(np.argmax(sketch_miss(threshold) <= min(band_miss(threshold), 1e-6)))


def _apart(a: str, b: str) -> Column:
    """Bits in which the sketches of a pair differ."""
    differ = [F.bit_count(F.col(f"{a}.s{j}").bitwiseXOR(F.col(f"{b}.s{j}"))) for j in range(4)]
    return reduce(Column.__add__, differ)


def _alike(a: str, b: str, percent: int) -> Column:
    """Set sizes of a pair that don't rule it out."""
    least, most = F.least(f"{a}.n", f"{b}.n"), F.greatest(f"{a}.n", f"{b}.n")
    return 100 * least >= percent * most


def _parts_of(rows: Column, shingles: Column) -> Column:
    """Into how many blocks so many classes with so many shingles are cut."""
    return F.ceil(F.greatest(rows / BLOCK, shingles / BLOCK_SHINGLES, F.lit(1))).cast("int")


def _buckets(classes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Members ``bucket, rep, d1, n`` of all bands; the buckets with more than one: their centres and sizes."""
    members = classes.select(F.explode("bands").alias("bucket"), "rep", "d1", "n")
    order = F.xxhash64(F.pmod("bucket", F.lit(CENTRES)), "rep", "d1")
    found = members.groupBy("bucket").agg(
        F.count("*").alias("size"),
        F.sum("n").alias("shingles"),
        F.min_by("rep", order).alias("centre"),
        F.min_by("d1", order).alias("centre_d1"),
    )
    return members, stored(found.filter("size > 1"), "buckets")


def _nearest_centres(members: DataFrame, buckets: DataFrame, classes: DataFrame, most: int, percent: int) -> DataFrame:
    """For each member of a bucket, the one of its centres with the nearest sketch, if it is near at all."""
    facts = classes.select("rep", "d1", "n", "s0", "s1", "s2", "s3")
    seen = members.join(buckets, "bucket").filter("rep != centre or d1 != centre_d1")
    pairs = seen.select("rep", "d1", "centre", "centre_d1").distinct().alias("p")
    x, y = facts.alias("x"), facts.alias("y")
    both = pairs.join(x, (F.col("p.rep") == F.col("x.rep")) & (F.col("p.d1") == F.col("x.d1"))).join(
        y, (F.col("p.centre") == F.col("y.rep")) & (F.col("p.centre_d1") == F.col("y.d1"))
    )
    near = both.withColumn("apart", _apart("x", "y")).filter(_alike("x", "y", percent) & (F.col("apart") <= most))
    best = F.min(F.struct("apart", "p.centre", "p.centre_d1")).alias("best")
    chosen = near.groupBy(F.col("p.rep"), F.col("p.d1"), F.col("x.n")).agg(best)
    return stored(chosen.select("rep", "d1", "n", "best.*"), "nearest")


def _centre_jobs(nearest: DataFrame) -> DataFrame:
    """Jobs of comparing a centre with a bounded number of members each."""
    sizes = nearest.groupBy("centre", "centre_d1").agg(
        _parts_of(F.count("*"), F.sum("n")).alias("parts")
    )
    part = F.pmod(F.xxhash64("rep", "d1"), F.col("parts")).alias("part")
    pair = F.struct(
        F.col("apart"), F.col("centre").alias("a"), F.col("centre_d1").alias("a1"), F.col("rep").alias("b"), F.col("d1").alias("b1")
    )
    rows = nearest.join(sizes, ["centre", "centre_d1"]).groupBy("centre", "centre_d1", part)
    return rows.agg(F.sort_array(F.collect_list(pair)).alias("pairs")).select(
        F.xxhash64("centre", "centre_d1", "part").alias("job"), "pairs"
    )


def _verify(jobs: DataFrame, docs: DataFrame, percent: int) -> DataFrame:
    """Links ``a, b`` among the pairs of jobs, confirmed on whole sets.

    A job's sets are brought together once, whatever the number of its pairs.
    Pairs are taken nearest first, and one that earlier links of the job have
    joined already is skipped. The joins with texts and sets are planned as
    shuffled ones at every size, as they must be at full scale; the merge join
    with texts leaves the rows of an id together, so that a row repeated gives
    a job one set.
    """
    with small_batches(docs.sparkSession):
        jobs = stored(jobs, "jobs")
    ends = F.array_union(
        F.transform("pairs", lambda p: F.struct(p["a"].alias("doc_id"), p["a1"].alias("d1"))),
        F.transform("pairs", lambda p: F.struct(p["b"].alias("doc_id"), p["b1"].alias("d1"))),
    )
    need = jobs.select("job", F.explode(ends).alias("e")).select("job", "e.*")
    texts = docs.join(need.select("doc_id").distinct().hint("merge"), "doc_id", "left_semi")
    sets = texts.mapInArrow(_build_sets, _SETS)
    held = need.join(sets.hint("merge"), ["doc_id", "d1"]).groupBy("job").agg(
        F.collect_list(F.struct("doc_id", "d1", "hashes")).alias("sets")
    )

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                yield _confirm(batch.column(0)[i].values, batch.column(1)[i].values, percent)

    both = jobs.join(held.hint("merge"), "job").select("pairs", "sets")
    with small_batches(docs.sparkSession):
        return stored(both.mapInArrow(run, "a long, b long"), "links")


def _confirm(pairs: pa.StructArray, sets: pa.StructArray, percent: int) -> pa.RecordBatch:
    ids = zip(sets.field("doc_id").to_pylist(), sets.field("d1").to_pylist(), strict=True)
    place = {key: i for i, key in enumerate(ids)}
    lists = sets.field("hashes")
    flat, offsets = lists.values.to_numpy().view(np.uint64), lists.offsets.to_numpy()
    root = list(range(len(sets)))

    def find(i):
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    found = []
    for a, a1, b, b1 in zip(*(pairs.field(c).to_pylist() for c in ("a", "a1", "b", "b1")), strict=True):
        i, j = place[a, a1], place[b, b1]
        if find(i) == find(j):
            continue
        x, y = flat[offsets[i] : offsets[i + 1]], flat[offsets[j] : offsets[j + 1]]
        if len(x) > len(y):
            x, y = y, x
        at = np.minimum(np.searchsorted(y, x), len(y) - 1)
        common = int((y[at] == x).sum())
        if 100 * common >= percent * (len(x) + len(y) - common):
            root[find(i)] = find(j)
            found.append((a, b))
    return pa.RecordBatch.from_pydict(
        {name: pa.array([f[i] for f in found], pa.int64()) for i, name in enumerate("ab")}
    )


_PAIRS = "job long, pairs array<struct<apart:int,a:long,a1:long,b:long,b1:long>>"


def _candidates(bucket: int, x: pa.StructArray, y: pa.StructArray, most: int, percent: int):
    """Pairs of two blocks of a bucket that are near, in different components, not tried, and meet here first."""
    fx, fy = ({k: side.field(k).to_numpy(zero_copy_only=False) for k in _FACTS} for side in (x, y))
    bx, by = (side.field("bands").flatten().to_numpy().reshape(-1, BANDS) for side in (x, y))
    # As unsigned numbers: of negative ones numpy counts the bits of the absolute value.
    sx, sy = ([f[s].view(np.uint64) for s in ("s0", "s1", "s2", "s3")] for f in (fx, fy))
    bits = sum(np.bitwise_count(a[:, None] ^ b[None, :]).astype(np.int32) for a, b in zip(sx, sy, strict=True))
    low = np.minimum(fx["n"][:, None], fy["n"][None, :])
    high = np.maximum(fx["n"][:, None], fy["n"][None, :])
    near = (bits <= most) & (100 * low >= percent * high)
    near &= fx["component"][:, None] != fy["component"][None, :]
    near &= (fx["tried"][:, None] != fy["d1"][None, :]) & (fy["tried"][None, :] != fx["d1"][:, None])
    # Both in smaller parts: the pair comes up from either side.
    near &= fy["main"][None, :] | (fx["d1"][:, None] < fy["d1"][None, :])
    i, j = np.nonzero(near)
    first = np.argmax(bx[i] == by[j], axis=1)
    here = bx[i, first] == bucket
    i, j = i[here], j[here]
    order = np.argsort(bits[i, j], kind="stable")
    i, j = i[order], j[order]
    return pa.StructArray.from_arrays(
        [
            pa.array(bits[i, j].astype(np.int32)),
            pa.array(fx["rep"][i]),
            pa.array(fx["d1"][i]),
            pa.array(fy["rep"][j]),
            pa.array(fy["d1"][j]),
        ],
        ["apart", "a", "a1", "b", "b1"],
    )


_FACTS = ("rep", "d1", "n", "component", "tried", "main", "s0", "s1", "s2", "s3")


def _part_jobs(
    members: DataFrame, buckets: DataFrame, classes: DataFrame, nearest: DataFrame, parts: DataFrame, most: int, percent: int
) -> DataFrame:
    """Jobs for buckets that hold several components: all but the largest part against the whole bucket."""
    known = members.join(buckets.select("bucket", "size", "shingles"), "bucket")
    labels = parts.select(F.col("node").alias("rep"), "component")
    known = known.join(labels, "rep", "left").withColumn("component", F.coalesce("component", "rep"))
    by_part = known.groupBy("bucket", "component").agg(F.count("*").alias("in_part"))
    mixed = (
        by_part.groupBy("bucket")
        .agg(F.count("*").alias("parts"), F.max(F.struct("in_part", "component")).alias("top"))
        .filter("parts > 1")
        .select("bucket", F.col("top.component").alias("largest"))
    )
    split = known.join(stored(mixed, "mixed"), "bucket").drop("n")
    tried = nearest.select("rep", "d1", F.col("centre_d1").alias("tried"))
    facts = classes.select("rep", "d1", "n", "bands", "s0", "s1", "s2", "s3").join(tried, ["rep", "d1"], "left")
    full = split.join(facts, ["rep", "d1"]).withColumns(
        {
            "tried": F.coalesce("tried", "d1"),
            "main": F.col("component") == F.col("largest"),
            "block": F.pmod(F.xxhash64("rep", "d1"), _parts_of(F.col("size"), F.col("shingles"))),
        }
    )
    full = stored(full, "split")

    def blocks(rows: DataFrame, name: str) -> DataFrame:
        listed = F.collect_list(F.struct(*_FACTS, "bands")).alias(name)
        return rows.groupBy("bucket", F.col("block").alias(f"{name}_block")).agg(listed)

    grid = blocks(full.filter("not main"), "x").join(blocks(full, "y"), "bucket")
    grid = grid.select(F.xxhash64("bucket", "x_block", "y_block").alias("job"), "bucket", "x", "y")

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                x, y = batch.column(2)[i].values, batch.column(3)[i].values
                pairs = _candidates(batch.column(1)[i].as_py(), x, y, most, percent)
                if len(pairs):
                    ends = pa.array([0, len(pairs)], pa.int32())
                    yield pa.RecordBatch.from_arrays(
                        [batch.column(0).slice(i, 1), pa.ListArray.from_arrays(ends, pairs)], ["job", "pairs"]
                    )

    return grid.mapInArrow(run, _PAIRS)


def find_links(classes: DataFrame, docs: DataFrame, percent: int) -> DataFrame:
    """Confirmed links ``a, b`` between classes, enough of them to join every component."""
    most = _estimate_allows(percent / 100)
    members, buckets = _buckets(classes)
    nearest = _nearest_centres(members, buckets, classes, most, percent)
    links = _verify(_centre_jobs(nearest), docs, percent)
    parts = stored(components(links), "parts")
    return links.union(_verify(_part_jobs(members, buckets, classes, nearest, parts, most, percent), docs, percent))


def near_duplicates(
    docs: DataFrame, percent: int = 85, id_col: str = "doc_id", text: str = "text"
) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_shingles, component_id, kept.

    Documents are linked when 100 * |A and B| >= percent * |A or B| for their sets
    of five-word shingles, words being lower-cased in A-Z. ``component_id`` is the
    least id that links reach. A text with fewer words is one shingle; null,
    empty, and blank texts have none and are linked with nothing. Rows that share
    an id count as one document in links. Rows without an id are linked with
    nothing, have no component, and are kept. No rows: no rows.
    """
    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), fold(text).alias("text"))
    with small_batches(docs.sparkSession):
        signed = stored(slim.mapInArrow(_sign, _SIG), "signatures")
    part = F.expr("n_shingles > 0 and doc_id is not null")
    linkable, alone = signed.filter(part), signed.filter(~part)
    shape = [F.first(c).alias(c) for c in ("bands", "s0", "s1", "s2", "s3")]
    classes = stored(
        linkable.groupBy("d1", "d2").agg(
            F.min("doc_id").alias("rep"), F.count("*").alias("members"), F.first("n_shingles").alias("n"), *shape
        ),
        "classes",
    )
    same = classes.select("d1", "d2", "rep", "members")
    parts = components(find_links(classes, slim, percent))
    labels = parts.select(F.col("node").alias("rep"), "component")
    groups = stored(
        same.join(labels, "rep", "left").select(
            "d1", "d2", "members", F.coalesce("component", "rep").alias("component_id")
        ),
        "groups",
    )
    found = attach_groups(linkable.select("doc_id", "n_shingles", "d1", "d2"), groups, ["d1", "d2"], "members")
    own = alone.select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    return (
        found.select("doc_id", "n_shingles", "component_id")
        .unionByName(own)
        .withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))
    )


def drop_near_duplicates(
    docs: DataFrame, percent: int = 85, id_col: str = "doc_id", text: str = "text"
) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns: one document per component.

    Rows that share an id stay or go together.
    """
    gone = near_duplicates(docs, percent, id_col, text).filter("not kept").select("doc_id").distinct()
    rows = docs.select(F.col(id_col).alias("doc_id"), whole_row(docs).alias("row"))
    return rows.join(stored(gone, "gone"), "doc_id", "left_anti").select("row.*")

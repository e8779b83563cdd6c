"""Vectors as short codes: every part of a vector by its nearest entry in a codebook.

Components become integers, ``floor(SCALE * x)``, and all that follows is exact. A
vector is cut into equal parts; each part position has a codebook, which starts as that
part of the first vectors by id. A round assigns every part to the nearest entry and
moves each entry to the floor of the mean of its parts. Tasks sum their own rows and
send one number per component of an entry, so what the driver collects follows the
size of the codebooks and not of the table.

Distances come of inner products, ``|x|^2 - 2 x.c + |c|^2``. Integers are split into
limbs of so few bits that a product of two limb matrices stays below 2^53 and loses
nothing in floating point; the products are shifted and added in 64-bit integers, and
the first least distance wins. Rows whose distances need more than 64 bits are
computed with integers of any size instead.
"""

from __future__ import annotations

import hashlib
import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import attach_groups
from lodestone.session import stored

SCALE = 256
PARTS = 16
ENTRIES = 64
ROUNDS = 2
_MOST = 2**63 - 1
_SUM_BITS = 30  # of the limbs in which tasks send their sums

_SUMS = "part int, entry int, place int, limb int, total long"


@dataclass(frozen=True)
class Codebooks:
    """``entries[part][entry]`` is a tuple of integers; ``dims`` is the length of a vector."""

    dims: int
    entries: tuple

    def digest(self) -> str:
        """SHA-256 of all components by part, entry and place, as decimal numbers joined by commas."""
        every = ",".join(str(v) for part in self.entries for entry in part for v in entry)
        return hashlib.sha256(every.encode()).hexdigest()


def limbs(values: np.ndarray, bits: int) -> list[np.ndarray]:
    """Integers as limbs of ``bits`` bits, lowest first, in floating point; the last limb has the sign."""
    most = max(1, int(np.abs(values).max(initial=0)))
    out = []
    for _ in range(-(-most.bit_length() // bits) - 1):
        out.append((values & ((1 << bits) - 1)).astype(np.float64))
        values = values >> bits
    return [*out, values.astype(np.float64)]


def inner_products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of the rows of two integer matrices, where they need no more than 64 bits."""
    terms = max(1, a.shape[1])
    bits = (53 - (terms - 1).bit_length() - 1) // 2
    out = np.zeros((len(a), len(b)), np.int64)
    for i, x in enumerate(limbs(a, bits)):
        for j, y in enumerate(limbs(b, bits)):
            if bits * (i + j) < 64:  # higher ones cancel out where the result fits
                out += (x @ y.T).astype(np.int64) << (bits * (i + j))
    return out


def integers(rows: np.ndarray, scale: int, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """``floor(scale * x)`` of a matrix as 64-bit integers, and which rows fit in ``bits`` bits."""
    with np.errstate(over="ignore"):
        scaled = np.floor(rows * scale)
    narrow = (np.abs(scaled) < 2.0**bits).all(axis=1)
    return np.where(narrow[:, None], scaled, 0).astype(np.int64), narrow


def big_integers(row, scale: int) -> list[int]:
    """``floor(scale * x)`` of one vector as integers of any size."""
    return [math.floor(v * scale) if abs(v) < 2.0**900 else int(v) * scale for v in map(float, row)]


class Coder:
    """Assigns parts of vectors to entries."""

    def __init__(self, books: Codebooks, scale: int):
        self.books, self.scale = books, scale
        self.width = books.dims // len(books.entries)
        most = max((abs(v) for part in books.entries for entry in part for v in entry), default=0)
        # Of so many bits that squared distances over all parts, dims * (2 * 2**bits)**2, need less than 64.
        self.bits = (61 - books.dims.bit_length()) // 2
        self.fits = most <= 2**self.bits
        if self.fits:
            self.small = [np.array(part, np.int64).reshape(len(part), self.width) for part in books.entries]

    def parts(self, values: np.ndarray):
        for p in range(len(self.books.entries)):
            yield p, values[:, p * self.width : (p + 1) * self.width]

    def assign(self, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Codes (rows x parts) and squared distances summed over parts, of integers of ``bits`` bits."""
        codes = np.zeros((len(values), len(self.books.entries)), np.int64)
        error = np.zeros(len(values), np.int64)
        for p, own in self.parts(values):
            entries = self.small[p]
            # Without |x|^2, which is the same for all entries.
            gap = (entries * entries).sum(axis=1) - 2 * inner_products(own, entries)
            codes[:, p] = gap.argmin(axis=1)
            error += gap.min(axis=1) + (own * own).sum(axis=1)
        return codes, error

    def assign_big(self, value: list[int]) -> tuple[list[int], int]:
        """The same for one vector of integers of any size."""
        codes, error = [], 0
        for p, part in enumerate(self.books.entries):
            own = value[p * self.width : (p + 1) * self.width]
            gaps = [sum((x - c) ** 2 for x, c in zip(own, entry, strict=True)) for entry in part]
            error += min(gaps)
            codes.append(gaps.index(min(gaps)))
        return codes, error


def _matrix(vectors: pa.Array, dims: int) -> np.ndarray:
    lengths = np.asarray(vectors.value_lengths())
    if (lengths != dims).any():
        raise ValueError(f"a vector has {lengths[lengths != dims][0]} components, the first by id {dims}")
    return vectors.flatten().to_numpy(zero_copy_only=False).reshape(len(vectors), dims)


def kept(vectors: DataFrame, id_col: str, vector: str, label: str) -> DataFrame:
    """``vec_id, label, x`` of the vectors that are not null and have neither null nor non-finite components."""
    x = F.col(vector).cast("array<double>")
    bad = F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    rows = vectors.filter(x.isNotNull() & ~bad)
    return rows.select(F.col(id_col).cast("long").alias("vec_id"), F.col(label).alias("label"), x.alias("x"))


def _sums(rows: DataFrame, books: Codebooks, scale: int) -> DataFrame:
    """Sums of the parts that go to each entry, by component and limb; place -1 counts the parts."""

    def run(batches):
        coder = Coder(books, scale)
        shape = (len(books.entries), max(map(len, books.entries)), coder.width)
        count, sums, big = np.zeros(shape[:2], np.int64), np.zeros(shape, np.int64), {}
        for batch in batches:
            matrix = _matrix(batch.column(0), books.dims)
            values, narrow = integers(matrix, scale, coder.bits)
            if not coder.fits:
                narrow[:] = False
            codes, _ = coder.assign(values[narrow]) if narrow.any() else (np.zeros((0, shape[0]), np.int64), None)
            for p, own in coder.parts(values[narrow]):
                count[p] += np.bincount(codes[:, p], minlength=shape[1])
                for place in range(shape[2]):
                    # Below 2^53, as a batch has less than 2^22 rows and a number at most 30 bits.
                    total = np.bincount(codes[:, p], own[:, place].astype(np.float64), shape[1])
                    sums[p, :, place] += total.astype(np.int64)
            for row in matrix[~narrow]:
                value = big_integers(row, scale)
                for p, code in enumerate(coder.assign_big(value)[0]):
                    count[p, code] += 1
                    for place in range(shape[2]):
                        at = (p, code, place)
                        big[at] = big.get(at, 0) + value[p * shape[2] + place]
        found = []
        for p, entry in zip(*(a.tolist() for a in np.nonzero(count)), strict=True):
            found.append((p, entry, -1, 0, int(count[p, entry])))
            for place in range(shape[2]):
                total, limb = int(sums[p, entry, place]) + big.get((p, entry, place), 0), 0
                while total not in (0, -1):
                    found.append((p, entry, place, limb, total & ((1 << _SUM_BITS) - 1)))
                    total, limb = total >> _SUM_BITS, limb + 1
                if total:
                    found.append((p, entry, place, limb, -1))
        if found:
            kinds = [pa.int32()] * 4 + [pa.int64()]
            columns = [pa.array(c, k) for c, k in zip(zip(*found, strict=True), kinds, strict=True)]
            yield pa.RecordBatch.from_arrays(columns, [field.split()[0] for field in _SUMS.split(", ")])

    found = rows.select("x").mapInArrow(run, _SUMS)
    return found.groupBy("part", "entry", "place", "limb").agg(F.sum("total").alias("total"))


def _moved(books: Codebooks, sums: DataFrame) -> Codebooks:
    """Each entry at the floor of the mean of its parts; one without parts stays."""
    totals: dict[tuple[int, int, int], int] = {}
    for r in sums.toLocalIterator():  # entries x components x limbs, whatever the number of rows
        at = (r["part"], r["entry"], r["place"])
        totals[at] = totals.get(at, 0) + (r["total"] << (_SUM_BITS * r["limb"]))

    def entry(p: int, e: int, old: tuple) -> tuple:
        count = totals.get((p, e, -1), 0)
        return tuple(totals.get((p, e, k), 0) // count for k in range(len(old))) if count else old

    return Codebooks(
        books.dims, tuple(tuple(entry(p, e, old) for e, old in enumerate(part)) for p, part in enumerate(books.entries))
    )


def learn(
    rows: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE
) -> Codebooks | None:
    """Codebooks of ``kept`` rows; None if there are no rows.

    They start with the ``entries`` rows of least id, rows with equal ids in the order
    of their components, those without an id last. All rows take part in every round.
    """
    first = rows.orderBy(F.asc_nulls_last("vec_id"), "x").select("x").limit(entries).collect()
    if not first:
        return None
    values = [big_integers(r["x"], scale) for r in first]
    dims = len(values[0])
    if dims % parts or any(len(v) != dims for v in values):
        raise ValueError(f"vectors of {dims} components can't be cut into {parts} equal parts")
    width = dims // parts
    books = Codebooks(dims, tuple(tuple(tuple(v[p * width : (p + 1) * width]) for v in values) for p in range(parts)))
    for _ in range(rounds):
        books = _moved(books, _sums(rows, books, scale))
    return books


def assigned(rows: DataFrame, books: Codebooks, scale: int = SCALE) -> DataFrame:
    """``vec_id, label, code, error`` of ``kept`` rows; an error beyond 64 bits is null."""

    def run(batches):
        coder = Coder(books, scale)
        for batch in batches:
            matrix = _matrix(batch.column(2), books.dims)
            values, narrow = integers(matrix, scale, coder.bits)
            if not coder.fits:
                narrow[:] = False
            texts, errors = np.empty(len(matrix), object), np.empty(len(matrix), object)
            if narrow.any():
                codes, error = coder.assign(values[narrow])
                raw = codes.astype(np.uint8).tobytes().hex()
                size = 2 * codes.shape[1]
                texts[narrow] = [raw[k : k + size] for k in range(0, size * len(codes), size)]
                errors[narrow] = error.tolist()
            for k in np.nonzero(~narrow)[0]:
                codes, error = coder.assign_big(big_integers(matrix[k], scale))
                texts[k], errors[k] = bytes(codes).hex(), error if error <= _MOST else None
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(errors, pa.int64())],
                ["vec_id", "label", "code", "error"],
            )

    kind = rows.schema["label"].dataType.simpleString()
    return rows.mapInArrow(run, f"vec_id long, label {kind}, code string, error long")


def compress(
    vectors: DataFrame,
    parts: int = PARTS,
    entries: int = ENTRIES,
    rounds: int = ROUNDS,
    scale: int = SCALE,
    id_col: str = "vec_id",
    vector: str = "embedding",
    label: str = "label",
) -> DataFrame:
    """``vec_id, label, code, error, label_error, codebooks_sha256`` of every vector that takes part.

    ``code`` has two hexadecimal digits per part, so at most 256 entries are allowed;
    ``error`` is the sum of squared distances, ``label_error`` its sum over all rows of
    a label, null labels together. Both are null where they need more than 64 bits,
    ``label_error`` also where an error of its label is. Vectors that are null, or hold a
    null or non-finite component, are left out; rows repeated are coded and counted each;
    rows without an id are coded too; ties go to the lower entry. With fewer vectors than
    ``entries`` the codebooks are smaller; an empty table gives no rows. Vectors of
    different lengths, or of one that ``parts`` doesn't divide, raise. Other columns are
    left out.
    """
    if not 0 < entries <= 256:
        raise ValueError("a code has room for 256 entries")
    rows = kept(vectors, id_col, vector, label)
    books = learn(rows, parts, entries, rounds, scale)
    if books is None:  # then there are no rows either
        none = [F.lit(None).cast(kind).alias(c) for c, kind in
                (("code", "string"), ("error", "long"), ("label_error", "long"), ("codebooks_sha256", "string"))]
        return rows.select("vec_id", "label", *none)
    coded = assigned(rows, books, scale)
    key = F.coalesce(F.concat(F.lit("="), F.col("label").cast("string")), F.lit("-"))
    coded = stored(coded.withColumn("_key", key), "codes")
    total = F.sum(F.col("error").cast("decimal(38,0)")).try_cast("long")
    whole = F.when(F.count("error") == F.count("*"), total)
    sums = stored(coded.groupBy("_key").agg(F.count("*").alias("_n"), whole.alias("label_error")), "label-errors")
    digest = F.lit(books.digest()).alias("codebooks_sha256")
    joined = attach_groups(coded, sums, ["_key"], "_n")
    return joined.select("vec_id", "label", "code", "error", "label_error", digest)

"""Packing tokenized documents into sequences: concatenate and cut.

The first pass tokenizes every document once and stores its ids with the number
of tokens before it in its partition. Prefix sums over the partitions' totals,
one row each, then give every document its place in one long row of tokens, and
the second pass cuts that row into windows of fixed length. A window that lies
within the rows of one task is made there; of one that crosses tasks each task
gives its part as a boundary record, and only these are shuffled.
"""

from __future__ import annotations

import os
import re
import zlib
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lodestone.llm.common import fold, small_batches, tidy
from lodestone.llm.shingles import byte_slices, text_bytes, word_hashes
from lodestone.session import stored

LENGTH = 2048
END = 1  # the id that closes a document
_REMEMBERED = 300_000  # words whose ids a task keeps, and the new ones of one slice
_SLICE = 1_000_000  # bytes of text encoded at once

_TOKENS = "doc_id long, part int, before long, n_tokens long, ids array<int>"
_PIECES = (
    "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
)
_PARTS = "sequence_id long, offset long, ids array<int>, doc_ids array<long>, starts array<int>, whole boolean"


class WordEncoder:
    """Ids of whole texts by a tokenizer that drops white space and so works word by word.

    It also splits between letters and marks, so a word and the marks around it
    are looked up each on their own. Each distinct word is tokenized once and
    remembered; texts are put together from the ids of their words. Names of added
    tokens in a text are cut out first and get the ids of these tokens, as the
    tokenizer itself does.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.added = {t.content: i for i, t in self.tokenizer.get_added_tokens_decoder().items()}
        longest_first = sorted(self.added, key=len, reverse=True)
        self.names = re.compile("(" + "|".join(map(re.escape, longest_first)) + ")") if self.added else None
        self._forget()

    def _forget(self) -> None:
        """Known words by sorted hash: where their ids begin in ``flat``, and how many they are."""
        self.hashes = np.zeros(0, np.uint64)
        self.begin, self.count = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.flat = np.zeros(0, np.int32)

    def _learn(self, hashes: np.ndarray, words: list[str]) -> None:
        # A word of a-z is one piece to the tokenizer and goes to its model as it is.
        plain = [w.isascii() and w.isalpha() for w in words]
        model = self.tokenizer.model
        others = [w for w, p in zip(words, plain, strict=True) if not p]
        encoded = self._encoded(others)
        found = [
            [t.id for t in model.tokenize(w.lower())] if p else next(encoded)
            for w, p in zip(words, plain, strict=True)
        ]
        count = np.fromiter(map(len, found), np.int64, len(found))
        begin = len(self.flat) + np.cumsum(count) - count
        self.flat = np.concatenate([self.flat, np.fromiter(chain.from_iterable(found), np.int32, int(count.sum()))])
        every = np.concatenate([self.hashes, hashes])
        order = np.argsort(every, kind="stable")
        self.hashes = every[order]
        self.begin = np.concatenate([self.begin, begin])[order]
        self.count = np.concatenate([self.count, count])[order]

    def _encoded(self, words: list[str]):
        """Ids of words, a few thousand at a time: an encoding is much larger than its word."""
        for start in range(0, len(words), 4_096):
            part = words[start : start + 4_096]
            for one in self.tokenizer.encode_batch_fast(part, add_special_tokens=False):
                yield one.ids

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, each closed by ``END``, and the offsets between texts."""
        found = [pc.match_substring(texts, name) for name in self.added]
        if not any(pc.any(f).as_py() for f in found):
            return self._encode(texts)
        # A text in the parts between names; each part ends in END, and all but the last in the name's id instead.
        split = [self.names.split(t or "") for t in texts.to_pylist()]
        parts = [part for one in split for part in one[::2]]
        ids, offsets = self._encode(pa.array(parts, pa.string()))
        last = np.cumsum([len(one[::2]) for one in split]) - 1
        inner = np.setdiff1d(np.arange(len(parts)), last)
        ids[offsets[1:][inner] - 1] = [self.added[name] for one in split for name in one[1::2]]
        return ids, np.concatenate([[0], offsets[1:][last]])

    def _encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """``encode`` of texts without names of added tokens."""
        data, offsets = text_bytes(texts)
        hashes, before, starts, ends = word_hashes(data, offsets, split_marks=True)
        distinct, first, place = np.unique(hashes, return_index=True, return_inverse=True)
        if len(self.hashes) > _REMEMBERED:
            self._forget()
        new = first[~np.isin(distinct, self.hashes, assume_unique=True)]
        if len(new):
            raw = data.tobytes()
            spans = zip(starts[new].tolist(), ends[new].tolist(), strict=True)
            self._learn(hashes[new], [raw[a:b].decode("utf-8", "replace") for a, b in spans])
        slot = np.searchsorted(self.hashes, distinct)
        lengths, flat_at, flat = self.count[slot], self.begin[slot], self.flat
        # Words in order, and END after the last word of each text.
        per_word = lengths[place]
        upto = np.concatenate([[0], np.cumsum(per_word)])
        closed = upto[before[1:]] + np.arange(1, len(texts) + 1)
        out = np.full(int(upto[-1]) + len(texts), END, np.int32)
        text_of = np.repeat(np.arange(len(texts)), np.diff(before))
        target = upto[:-1] + text_of
        inside = np.arange(int(upto[-1])) - np.repeat(upto[:-1], per_word)
        out[np.repeat(target, per_word) + inside] = flat[np.repeat(flat_at[place], per_word) + inside]
        return out, np.concatenate([[0], closed])


def tokenized(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """First pass, stored: ids of every document and the tokens before it in its partition."""

    def run(batches):
        encoder, part, total = WordEncoder(tokenizer), TaskContext.get().partitionId(), 0
        for batch in batches:
            for rows in byte_slices(batch, 1, _SLICE):
                ids, offsets = encoder.encode(rows.column(1))
                n = rows.num_rows
                yield pa.RecordBatch.from_arrays(
                    [
                        rows.column(0),
                        pa.array(np.full(n, part, np.int32)),
                        pa.array(offsets[:-1] + total),
                        pa.array(np.diff(offsets)),
                        pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(ids)),
                    ],
                    ["doc_id", "part", "before", "n_tokens", "ids"],
                )
                total += int(offsets[-1])

    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), fold(text).alias("text"))
    with small_batches(docs.sparkSession):
        return stored(slim.mapInArrow(tidy(run), _TOKENS), "tokens")


def placed(tokens: DataFrame) -> DataFrame:
    """Second prefix sum: ``first``, the place of a document's first token in the row of all tokens."""
    totals = tokens.groupBy("part").agg(F.max(F.col("before") + F.col("n_tokens")).alias("total"))
    ahead = W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    base = totals.select("part", F.coalesce(F.sum("total").over(ahead), F.lit(0)).alias("base"))
    # One row per task of the first pass, so never more rows than Spark can have tasks.
    joined = tokens.join(F.broadcast(base), "part")
    return joined.select("doc_id", (F.col("base") + F.col("before")).alias("first"), "n_tokens", "ids")


def _cuts(first: np.ndarray, n: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pieces of documents: row of the document, start and end in it."""
    windows = (first + n - 1) // length - first // length + 1
    row = np.repeat(np.arange(len(n)), windows)
    order = np.arange(len(row)) - np.repeat(np.cumsum(windows) - windows, windows)
    edge = (first[row] // length + order) * length - first[row]
    return row, np.maximum(edge, 0), np.minimum(edge + length, n[row])


def _arrays(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    ids = batch.column(3)
    offsets = ids.offsets.to_numpy()
    return batch.column(1).to_numpy(), batch.column(2).to_numpy(), ids.values.to_numpy(), offsets


def pieces(tokens: DataFrame, length: int = LENGTH) -> DataFrame:
    """Where the tokens of each document go: one row per piece, in windows of ``length``.

    ``doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset``. Every
    document has at least one piece, as the closing id is its own.
    """

    def run(batches):
        for batch in batches:
            first, n, flat, offsets = _arrays(batch)
            row, start, end = _cuts(first, n, length)
            raw = flat.astype("<u4").tobytes()
            at = (offsets[row] + start) * 4
            crc = [zlib.crc32(raw[a : a + 4 * k]) for a, k in zip(at.tolist(), (end - start).tolist(), strict=True)]
            place = first[row] + start
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).take(pa.array(row)),
                    pa.array(start),
                    pa.array(end - start),
                    pa.array(crc, pa.int64()),
                    pa.array(n[row]),
                    pa.array(place // length),
                    pa.array(place % length),
                ],
                [field.split()[0] for field in _PIECES.split(", ")],
            )

    return placed(tokens).mapInArrow(tidy(run), _PIECES)


def pack_pieces(
    docs: DataFrame, tokenizer: str, length: int = LENGTH, id_col: str = "doc_id", text: str = "text"
) -> DataFrame:
    """``pieces`` of a table of documents; null text is empty, rows repeated are packed each.

    Documents keep their order within partitions. No rows: no pieces.
    """
    return pieces(tokenized(docs, tokenizer, id_col, text), length)


def pack_sequences(
    docs: DataFrame,
    tokenizer: str,
    length: int = LENGTH,
    pad: int = 0,
    id_col: str = "doc_id",
    text: str = "text",
) -> DataFrame:
    """The sequences themselves: sequence_id, n_tokens, ids, doc_ids, starts.

    Null text is empty, rows repeated are packed each, an empty table gives no
    sequences. ``starts`` are the places in the sequence where the pieces of ``doc_ids``
    begin. Only the last sequence can be short: it is padded to ``length`` with
    ``pad``, unless its length is a power of two.
    """

    def run(batches):
        held: list[tuple[int, int, np.ndarray]] = []  # doc, place, ids of the window being filled
        filled, began, reached = 0, 0, None

        def window():
            ids = np.concatenate([x[2] for x in held])
            starts = [x[1] % length for x in held]
            whole = len(ids) == length
            return (began // length, began % length, ids, [x[0] for x in held], starts, whole)

        for batch in batches:
            first, n, flat, offsets = _arrays(batch)
            docs_, done = batch.column(0).to_pylist(), []
            for row, start, end in zip(*(x.tolist() for x in _cuts(first, n, length)), strict=True):
                place = int(first[row]) + start
                if held and (place != reached or place % length == 0):
                    done.append(window())
                    held, filled = [], 0
                if not held:
                    began = place
                held.append((docs_[row], place, flat[offsets[row] + start : offsets[row] + end].copy()))
                reached, filled = place + end - start, filled + end - start
            if done:
                yield _part_batch(done)
        if held:
            yield _part_batch([window()])

    parts = placed(tokenized(docs, tokenizer, id_col, text)).mapInArrow(tidy(run), _PARTS)
    with small_batches(docs.sparkSession):
        parts = stored(parts, "windows")
    order = F.sort_array(F.collect_list(F.struct("offset", "ids", "doc_ids", "starts")))
    crossing = parts.filter("not whole").groupBy("sequence_id").agg(order.alias("p"))
    stitched = crossing.select(
        "sequence_id", *[F.flatten(F.col(f"p.{c}")).alias(c) for c in ("ids", "doc_ids", "starts")]
    )
    every = parts.filter("whole").select("sequence_id", "ids", "doc_ids", "starts").unionByName(stitched)
    n = F.size("ids")
    short = (n < length) & (F.bit_count(n) != 1)
    padding = F.when(short, F.array_repeat(F.lit(pad), length - n)).otherwise(F.array().cast("array<int>"))
    return every.select(
        "sequence_id", n.cast("long").alias("n_tokens"), F.concat("ids", padding).alias("ids"), "doc_ids", "starts"
    )


def _part_batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int64(), pa.list_(pa.int32()), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.bool_()]
    names = [field.split()[0] for field in _PARTS.split(", ")]
    return pa.RecordBatch.from_arrays(
        [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names
    )

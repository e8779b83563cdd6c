"""Words and hashed word shingles of a column of texts, with numpy over the column's bytes."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

WIDTH = 5
_SLICE = 2_000_000  # bytes of text handled at once
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32
_LETTER = np.zeros(256, bool)
_LETTER[[*range(ord("A"), ord("Z") + 1), *range(ord("a"), ord("z") + 1)]] = True
_MARK = np.zeros(256, bool)
_MARK[0x21:0x7F] = True
_MARK[ord("'")] = False
_MARK &= ~_LETTER
_BYTE = np.random.default_rng(5).integers(0, 2**63, 256, np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = np.uint64(0x5851F42D4C957F2D)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit over all of them."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def byte_slices(batch: pa.RecordBatch, column: int, most: int = _SLICE):
    """A batch in runs of rows with about ``most`` bytes of text; a longer text is a run alone."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0)
    ends = np.cumsum(sizes.to_numpy(zero_copy_only=False))
    start = 0
    while start < batch.num_rows:
        base = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, base + most, "right")))
        yield batch.slice(start, stop - start)
        start = stop


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts, one after the other, and the offsets between them; null is empty."""
    texts = texts.fill_null("").cast(pa.large_binary())
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
    return data, offsets - offsets[0]


def word_hashes(data: np.ndarray, offsets: np.ndarray, split_marks: bool = False) -> tuple[np.ndarray, ...]:
    """A hash per word, lower-cased in A-Z; the number of words before each text; words' starts and ends.

    With ``split_marks`` a word also ends between a letter of a-z and a digit or
    mark of ASCII, but for the apostrophe.
    """
    inside = ~_SPACE[data]
    fresh = np.ones(len(data), bool)
    fresh[1:] = ~inside[:-1]
    fresh[offsets[:-1][offsets[:-1] < len(data)]] = True
    if split_marks:
        letter, mark = _LETTER[data], _MARK[data]
        fresh[1:] |= letter[:-1] & mark[1:] | mark[:-1] & letter[1:]
    starts = np.flatnonzero(inside & fresh)
    before = np.searchsorted(starts, offsets)
    if not len(starts):
        return np.zeros(0, np.uint64), before, starts, starts
    # Bytes from one start to the next hold one word and the white space after it, which adds nothing.
    spans = np.diff(np.append(starts, len(data)))
    place = np.arange(starts[0], len(data)) - np.repeat(starts, spans)
    powers = np.full(int(spans.max()), _BASE)
    powers[0] = 1
    values = _BYTE[_LOWER[data[starts[0] :]]] * np.multiply.accumulate(powers)[place]
    values[~inside[starts[0] :]] = 0
    lengths = np.add.reduceat(inside[starts[0] :].astype(np.int64), starts - starts[0])
    return mix64(np.add.reduceat(values, starts - starts[0])), before, starts, starts + lengths


def shingle_sets(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The distinct shingles of each text as sorted 64-bit hashes, and the offsets between texts.

    A text of fewer than ``WIDTH`` words is one shingle, a text without words none.
    """
    words, before, _, _ = word_hashes(*text_bytes(texts))
    counts = np.diff(before)
    step = np.uint64(0x9E3779B97F4A7C15)
    size = max(0, len(words) - WIDTH + 1)
    rolled = np.full(size, WIDTH, np.uint64)
    for k in range(WIDTH):
        rolled = mix64(rolled * step + words[k : k + size])
    sets = []
    for first, n in zip(before, counts, strict=False):
        if n >= WIDTH:
            sets.append(np.unique(rolled[first : first + n - WIDTH + 1]))
        elif n:
            one = np.full(1, n, np.uint64)
            for w in words[first : first + n]:
                one = mix64(one * step + w)
            sets.append(one)
        else:
            sets.append(np.zeros(0, np.uint64))
    offsets = np.zeros(len(sets) + 1, np.int64)
    np.cumsum([len(s) for s in sets], out=offsets[1:])
    return (np.concatenate(sets) if sets else np.zeros(0, np.uint64)), offsets

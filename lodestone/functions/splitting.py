"""Recursive text splitting, as offsets into one document.

A chunk is always a contiguous slice of its document, so the helper works on
cut positions and copies text only for the chunks it returns.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Iterator, Sequence

# Separators, strongest first.
SEPARATORS = ("\n\n", "\n", ".", "!", "?", ",", " ", "")


def _cuts(text: str, lo: int, hi: int, separator: str) -> Sequence[int]:
    """Piece boundaries of ``text[lo:hi]``; each separator starts the next piece."""
    if separator == "":
        return range(lo, hi + 1)
    cuts = [lo]
    at = text.find(separator, lo, hi)
    while at != -1:
        if at > lo:
            cuts.append(at)
        at = text.find(separator, at + len(separator), hi)
    cuts.append(hi)
    return cuts


def _windows(cuts: Sequence[int], size: int, overlap: int) -> Iterator[tuple[int, int]]:
    """Fill windows of at most ``size`` with whole pieces, each starting within
    the last ``overlap`` characters of the one before."""
    last = len(cuts) - 1
    first = 0
    while True:
        end = bisect_right(cuts, cuts[first] + size) - 1
        if end >= last:
            yield cuts[first], cuts[last]
            return
        end = max(end, first + 1)
        yield cuts[first], cuts[end]
        if end == last:
            return
        keep_from = max(cuts[end] - overlap, cuts[end + 1] - size)
        first = min(max(bisect_left(cuts, keep_from), first + 1), end)


def _chunks(text, lo, hi, level, separators, size, overlap) -> Iterator[str]:
    while level < len(separators) - 1 and text.find(separators[level], lo, hi) == -1:
        level += 1
    cuts = _cuts(text, lo, hi, separators[level])
    if isinstance(cuts, range) and size > 1:
        runs = [(cuts, False)]
    else:
        runs = _runs(cuts, size)
    for run, oversized in runs:
        if not oversized:
            for start, end in _windows(run, size, overlap):
                yield text[start:end].strip()
        elif level + 1 < len(separators):
            yield from _chunks(text, run[0], run[1], level + 1, separators, size, overlap)
        else:
            yield text[run[0] : run[1]]


def _runs(cuts: Sequence[int], size: int) -> Iterator[tuple[Sequence[int], bool]]:
    """Group neighbouring short pieces; a piece of ``size`` or more stands alone."""
    begin = 0
    for i in range(len(cuts) - 1):
        if cuts[i + 1] - cuts[i] >= size:
            if i > begin:
                yield cuts[begin : i + 1], False
            yield (cuts[i], cuts[i + 1]), True
            begin = i + 1
    if begin < len(cuts) - 1:
        yield cuts[begin:], False


def split_text(
    text: str, size: int = 500, overlap: int = 50, separators: Sequence[str] = SEPARATORS
) -> list[str]:
    """Chunks of ``text`` in order, trimmed; blank ones are left out."""
    if not text:
        return []
    return [c for c in _chunks(text, 0, len(text), 0, separators, size, overlap) if c]

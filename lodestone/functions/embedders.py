"""An embedder that needs no service, for tests and offline runs.

An embedder is any callable from a list of texts to a matrix with one row per
text; a hosted model is passed to ``operators.embedding.embed`` the same way.
"""

from __future__ import annotations

import hashlib

import numpy as np


def hashing_embedder(dim: int = 64):
    """Count words per md5 bucket and scale to unit length."""
    buckets: dict[str, int] = {}

    def bucket(word: str) -> int:
        found = buckets.get(word)
        if found is None:
            if len(buckets) > 100_000:
                buckets.clear()
            found = int(hashlib.md5(word.encode("utf-8")).hexdigest()[:4], 16) % dim
            buckets[word] = found
        return found

    def embed(texts: list[str]) -> np.ndarray:
        rows = np.zeros((len(texts), dim), dtype=np.float64)
        for i, text in enumerate(texts):
            hits = [bucket(word) for word in text.split()]
            rows[i] = np.bincount(hits, minlength=dim) if hits else 0
        norms = np.sqrt((rows * rows).sum(axis=1, keepdims=True))
        return np.divide(rows, norms, out=np.zeros_like(rows), where=norms > 0)

    return embed

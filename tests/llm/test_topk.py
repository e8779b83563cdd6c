import math
import random

from lodestone.llm import topk

SCHEMA = "vec_id long, embedding array<float>, q string, rank string, score string"


def frame(spark, rows):
    return spark.createDataFrame([(i, v, "?", "?", "?") for i, v in rows], SCHEMA)


def plain(rows, k, divisor):
    kept = [
        (i, [math.floor(64 * x) for x in v]) for i, v in rows
        if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)
    ]
    out = []
    for i, q in kept:
        if i % divisor == 0:
            scored = [(-sum(a * b for a, b in zip(q, v)), j) for j, v in kept if j != i and len(v) == len(q)]
            out += [(i, rank, j, -s) for rank, (s, j) in enumerate(sorted(scored)[:k], 1)]
    return sorted(out)


def vectors(n, dims, seed=1):
    draw = random.Random(seed)
    centres = [[draw.gauss(0, 0.3) for _ in range(dims)] for _ in range(6)]
    # Steps of 1/8 are exact as floats and give many ties.
    return [(i, [round(8 * (c + draw.gauss(0, 0.2))) / 8 for c in draw.choice(centres)]) for i in range(n)]


def test_the_best_match_all_pairs_with_ties_over_many_ranges(spark, monkeypatch):
    monkeypatch.setattr(topk, "RANGE_ROWS", 64)
    monkeypatch.setattr(topk, "BLOCK", 8)
    rows = vectors(700, 8)
    found = topk.top_k(frame(spark, rows), k=5, divisor=7).collect()
    assert sorted(map(tuple, found)) == plain(rows, 5, 7)


def test_bad_vectors_mixed_lengths_and_few_candidates(spark):
    nan, inf = float("nan"), float("inf")
    rows = [
        (0, [1.0, 2.0]), (20, [0.5, -0.5]), (1, None), (2, [1.0, None]), (3, [nan, 1.0]), (4, [inf, 1.0]), (5, [1.0, 1.0]),
        (40, [1.0, 2.0, 3.0]), (41, [0.0, 0.0, 1.0]), (60, [4.0]), (80, []), (None, [1.0, 1.0]), (100, [-1e9, 1e9]),
    ]
    found = topk.top_k(frame(spark, rows)).collect()
    assert sorted(map(tuple, found)) == plain(rows, 20, 20)


def test_many_equal_vectors(spark, monkeypatch):
    monkeypatch.setattr(topk, "RANGE_ROWS", 50)
    rows = [(i, [0.25, 0.5]) for i in range(300)]
    found = topk.top_k(frame(spark, rows), k=3, divisor=100).collect()
    assert sorted(map(tuple, found)) == plain(rows, 3, 100)


def test_a_bound_is_never_below_a_score():
    import numpy as np

    draw = np.random.default_rng(1)
    m, q = draw.integers(-70, 70, (40, 6)), draw.integers(-70, 70, (9, 6))
    most = topk.bounds(q, m.min(axis=0)[None, :], m.max(axis=0)[None, :])[:, 0]
    assert (topk.products(q, m).max(axis=1) <= most).all()


def test_no_rows(spark):
    assert topk.top_k(frame(spark, [])).count() == 0

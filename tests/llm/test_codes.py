"""Vector codes held against plain integers in Python."""

import hashlib
import math
import random

import numpy as np
import pytest

from lodestone.llm import codes

SCHEMA = "vec_id long, embedding array<float>, label int, code string, error int, x int, _key int"


def frame(spark, rows):
    return spark.createDataFrame([(*r, "?", 1, 2, 3) for r in rows], SCHEMA)


def plain(rows, parts=4, entries=5, rounds=2):
    """The rows that take part as (vec_id, code, error, label_error), and the digest."""
    good = [(i, [math.floor(256 * np.float32(x).item()) for x in v], lab) for i, v, lab in rows
            if v is not None and all(x is not None and math.isfinite(np.float32(x)) for x in v)]
    good.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    if not good:
        return [], hashlib.sha256(b"").hexdigest()
    width = len(good[0][1]) // parts
    cut = [[v[p * width : (p + 1) * width] for p in range(parts)] for _, v, _ in good]
    books = [[c[p] for c in cut[:entries]] for p in range(parts)]

    def nearest(part, p):
        gaps = [sum((a - b) ** 2 for a, b in zip(part, e, strict=True)) for e in books[p]]
        return gaps.index(min(gaps)), min(gaps)

    for _ in range(rounds):
        groups = [[[] for _ in b] for b in books]
        for c in cut:
            for p in range(parts):
                groups[p][nearest(c[p], p)[0]].append(c[p])
        books = [
            [[sum(x) // len(g) for x in zip(*g, strict=True)] if g else e for g, e in zip(gs, b, strict=True)]
            for gs, b in zip(groups, books, strict=True)
        ]
    found = []
    for (i, _, lab), c in zip(good, cut, strict=True):
        near = [nearest(c[p], p) for p in range(parts)]
        found.append((i, lab, "".join(f"{k:02x}" for k, _ in near), sum(g for _, g in near)))
    out = []
    for i, lab, code, error in found:
        errors = [e for _, other, _, e in found if other == lab]
        total = sum(errors) if max(errors) < 2**63 and sum(errors) < 2**63 else None
        out.append((i, lab, code, error if error < 2**63 else None, total))
    text = ",".join(str(v) for b in books for e in b for v in e)
    return sorted(out, key=repr), hashlib.sha256(text.encode()).hexdigest()


def check(spark, rows, parts=4, entries=5, rounds=2):
    want, digest = plain(rows, parts, entries, rounds)
    found = codes.compress(frame(spark, rows).repartition(3), parts, entries, rounds).collect()
    assert sorted((tuple(r)[:5] for r in found), key=repr) == want
    assert {r["codebooks_sha256"] for r in found} <= {digest}
    return found


def vectors(n, seed=1, size=1.0):
    draw = random.Random(seed)
    return [(i, [draw.gauss(0, size) for _ in range(8)], draw.choice([0, 0, 0, 1, None])) for i in range(n)]


def test_products_are_exact_whatever_the_number_of_limbs():
    draw = random.Random(3)
    for bits in (5, 23, 26, 27, 40, 59):
        for terms in (1, 4, 33):
            a, b = ([[draw.randint(-(2**bits), 2**bits) for _ in range(terms)] for _ in range(7)] for _ in range(2))
            small = [[v >> max(0, bits - 57 + bits) for v in row] for row in b] if 2 * bits > 57 else b
            want = [[sum(x * y for x, y in zip(r, s, strict=True)) for s in small] for r in a]
            if max(abs(v) for r in want for v in r) < 2**63:
                assert codes.inner_products(np.array(a), np.array(small)).tolist() == want
    assert codes.inner_products(np.zeros((0, 3), np.int64), np.ones((2, 3), np.int64)).shape == (0, 2)


def test_limbs_stay_small_and_add_up():
    values = np.array([0, -1, 5, -(2**40) + 3, 2**52, -(2**62)])
    parts = codes.limbs(values, 24)
    assert all(np.abs(p).max() <= 2**24 for p in parts)
    assert sum(p.astype(np.int64) << (24 * k) for k, p in enumerate(parts)).tolist() == values.tolist()


def test_vectors_of_all_kinds(spark):
    rows = vectors(60)
    odd = [(None, rows[3][1], 0), (None, [0.0] * 8, None), (7, rows[7][1], 1), (7, rows[7][1], 1), (7, [9.0] * 8, 0),
           (100, None, 0), (101, [None] * 8, 1), (102, [0.5] * 7 + [float("nan")], 1), (103, [0.5] * 7 + [-float("inf")], 0),
           (-5, [0.25] * 8, 2), (104, [-0.001] * 8, None), (105, [1e-9] * 8, None)]
    found = check(spark, rows + odd)
    assert len(found) == 60 + 5 + 3
    check(spark, rows + odd, parts=8, entries=64)
    check(spark, rows[:3], entries=64)


def test_large_components(spark):
    check(spark, vectors(40, size=3e5))
    far = [(200, [3e38] * 8, 1), (201, [-3e38] * 8, 0), (202, [5e6] * 8, 1), (203, [1e9] * 8, 2)]
    found = {r["vec_id"]: r for r in check(spark, vectors(40) + far)}
    assert found[200]["error"] is not None or found[201]["error"] is not None or found[202]["error"] is not None
    check(spark, [(-1, [2e30] * 8, 0), *vectors(30), (50, [-2e30, *[1.0] * 7], 2)])


def test_ties_go_to_the_lower_entry(spark):
    rows = [(0, [0.0] * 4, 0), (1, [2.0] * 4, 0), (2, [1.0] * 4, 0), (3, [2.0] * 4, 0)]
    assert {r["vec_id"]: r["code"] for r in check(spark, rows, parts=2, entries=2, rounds=0)} == {
        0: "0000", 1: "0101", 2: "0000", 3: "0101",
    }
    # The second of two equal entries is never used and stays.
    check(spark, [(0, [1.0] * 4, 0), (1, [1.0] * 4, 0), (2, [3.0] * 4, 0), (3, [2.0] * 4, 0)], parts=2, entries=3)


def test_a_hot_label_and_copies(spark):
    copies = [(1000 + k, [0.5] * 8, 0) for k in range(3000)]
    check(spark, vectors(50) + copies)


def test_no_rows_and_no_vectors(spark):
    assert codes.compress(frame(spark, [])).count() == 0
    assert codes.compress(frame(spark, [(1, None, 0)])).count() == 0


def test_lengths(spark):
    with pytest.raises(ValueError):
        codes.compress(frame(spark, [(1, [0.5] * 6, 0)]), parts=4)
    with pytest.raises(Exception, match="components"):
        codes.compress(frame(spark, [(1, [0.5] * 8, 0)] + [(9, [0.5] * 4, 0)]), parts=4, entries=1)

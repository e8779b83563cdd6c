import random
from collections import Counter

import pytest

from lodestone.llm import mixing

SCHEMA = "doc_id long, source string, text string, size string, copies int"


def frame(spark, rows):
    return spark.createDataFrame([(i, s, t, "?", 9) for i, s, t in rows], SCHEMA)


def fill(sizes, weights, share, cap):
    """Water-filling by repetition: clamp, share out the excess, until nothing is above its cap."""
    left, free, out = share * sum(sizes.values()), set(sizes), {}
    while free:
        total = sum(weights[s] for s in free)
        over = {s for s in free if left * weights[s] / total > cap * sizes[s] + 1e-9}
        if not over:
            out |= {s: left * weights[s] / total for s in free}
            break
        for s in over:
            out[s] = cap * sizes[s]
            left -= out[s]
        free -= over
    return out


def make(seed, counts):
    draw = random.Random(seed)
    rows, n = [], 0
    for source, count in counts.items():
        for _ in range(count):
            rows.append((n, source, "w " * draw.randint(0, 40)))
            n += 1
    return rows


@pytest.mark.parametrize("counts", [{"a": 300, "b": 20, "c": 5, None: 60}, {"x": 1}, {"a": 3, "é": 200, "Z": 50}])
def test_targets_and_takings(spark, counts):
    rows = make(3, counts)
    found = mixing.mix_sizes(frame(spark, rows)).collect()
    again = mixing.mix_sizes(frame(spark, list(reversed(rows)))).collect()
    assert sorted(map(tuple, found)) == sorted(map(tuple, again))
    names = sorted((s for s in counts if s is not None), key=lambda s: [ord(c) for c in s]) + [None] * (None in counts)
    weights = {s: (3, 1, 2)[i % 3] for i, s in enumerate(names)}
    source = {i: s for i, s, _ in rows}
    sizes = Counter()
    for i, s, t in rows:
        sizes[s] += len(t.split())
    wanted = fill(sizes, weights, 1.5, 2.0)
    taken = Counter()
    for r in found:
        s = source[r["doc_id"]]
        assert r["source_size"] == sizes[s]
        assert r["target"] == pytest.approx(wanted[s])
        assert r["taken"] <= 2 * r["size"]
        taken[s] += r["taken"]
    for s in sizes:
        assert abs(taken[s] - wanted[s]) <= 40


def test_the_mix_holds_each_row_as_often_as_it_is_taken(spark):
    rows = make(5, {"a": 200, "b": 30, None: 10})
    sizes = {r["doc_id"]: (r["taken"], r["size"]) for r in mixing.mix_sizes(frame(spark, rows)).collect()}
    mixed = mixing.mix(frame(spark, rows))
    assert mixed.columns == ["doc_id", "source", "text", "size", "copies"]
    copies = Counter(r["doc_id"] for r in mixed.collect())
    for doc_id, (taken, size) in sizes.items():
        assert copies[doc_id] * size == taken
        assert copies[doc_id] <= 2


def test_weights_from_a_table_leave_out_other_sources(spark):
    docs = frame(spark, [(1, "a", "x y"), (2, "b", "x y"), (3, "c", "x y")])
    weights = spark.createDataFrame([("a", 1.0), ("b", 3.0)], "source string, weight double")
    mixed = mixing.mix(docs, weights, share=1.0, max_epochs=2.0)
    assert {r["source"] for r in mixed.collect()} <= {"a", "b"}


def test_nulls_empty_texts_and_repeated_rows(spark):
    rows = [(None, None, None), (1, None, ""), (2, "a", "x"), (2, "a", "x"), (None, "a", "y z")]
    found = mixing.mix_sizes(frame(spark, rows)).collect()
    assert len(found) == 5
    assert {(r["size"], r["taken"], r["target"]) for r in found if r["source_size"] == 0} == {(0, 0, 0.0)}


def test_no_rows(spark):
    assert mixing.mix_sizes(frame(spark, [])).count() == 0
    assert mixing.mix(frame(spark, [])).count() == 0

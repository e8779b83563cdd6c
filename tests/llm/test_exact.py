import hashlib
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lodestone.llm import exact

SCHEMA = "doc_id long, text string, keep_id string, recipe int, row string"


def plain(rows):
    """Groups by text in one dictionary."""
    groups = {}
    for doc_id, text in rows:
        groups.setdefault(text or "", []).append(doc_id)
    out = []
    for text, ids in groups.items():
        named = [i for i in ids if i is not None]
        keep = max(named) if named else None
        stays = ids.index(keep)
        sha = hashlib.sha256(text.encode()).hexdigest()
        out += [(i, keep, len(ids), place == stays, sha) for place, i in enumerate(ids)]
    return sorted(out, key=str)


LONG = "lorem ipsum dolor sit amet " * 4000
ROWS = [
    (1, "one text"), (2, "one text"), (3, None), (4, ""), (5, LONG), (6, LONG), (7, LONG + "!"), (8, "One text"),
    (9, "one text "), (9, "one text "), (None, "one text"), (None, "nobody's"), (None, "nobody's"), (10, "日本語 " * 3000),
]


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "x", 1, "y") for i, t in rows], SCHEMA)


def test_groups_match_a_plain_grouping(spark):
    found = exact.find_duplicates(frame(spark, ROWS)).collect()
    assert sorted(map(tuple, found), key=str) == plain(ROWS)


def test_identifiers_that_collide_are_drawn_anew(spark):
    def weak(chunk, seed):
        made = exact.identifier(chunk, seed)
        return made if seed else F.array(F.length(chunk).cast("long"))

    docs = frame(spark, [(1, "aaa"), (2, "bbb"), (3, "aaa")])
    assert exact.shared_identifiers(docs, "text", weak, 0) == 1
    found = exact.find_duplicates(docs, make=weak).collect()
    assert sorted(map(tuple, found), key=str) == plain([(1, "aaa"), (2, "bbb"), (3, "aaa")])


def test_identifiers_that_always_collide_are_an_error(spark):
    docs = frame(spark, [(1, "aaa"), (2, "bbb")])
    with pytest.raises(RuntimeError):
        exact.find_duplicates(docs, make=lambda chunk, seed: F.array(F.lit(1).cast("long")))


@settings(max_examples=15, deadline=None)
@given(texts=st.lists(st.text(max_size=3000), max_size=8))
def test_chunks_put_together_are_the_text(spark, texts):
    rows = spark.createDataFrame([(t,) for t in [*texts, LONG, "x" * 9000]], "t string")
    for r in rows.select("t", exact.chunks(F.col("t")).alias("c")).collect():
        assert "".join(r["c"]) == r["t"]
        assert all(0 < len(c) <= exact.MOST + 1 for c in r["c"])


def test_an_edit_leaves_most_chunks_alone(spark):
    draw = random.Random(1)
    text = " ".join("".join(draw.choices("etaoinshrdlucmé.,4", k=draw.randint(1, 9))) for _ in range(40000))
    other = text[:5000] + "inserted here " + text[5000:150_000] + text[150_007:]
    rows = spark.createDataFrame([(text,), (other,)], "t string").select(exact.chunks(F.col("t")).alias("c"))
    a, b = (r["c"] for r in rows.collect())
    assert 100 < len(text) / len(a) < 1500
    assert len(set(a) & set(b)) > 0.97 * len(a)


def test_rows_that_stay_keep_all_columns(spark):
    kept = exact.drop_duplicates(frame(spark, ROWS))
    assert kept.columns == ["doc_id", "text", "keep_id", "recipe", "row"]
    assert sorted((r["doc_id"], r["text"]) for r in kept.collect() if r["doc_id"]) == sorted(
        [(2, "one text"), (4, ""), (6, LONG), (7, LONG + "!"), (8, "One text"), (9, "one text "), (10, "日本語 " * 3000)]
    )
    assert [r["text"] for r in kept.collect() if r["doc_id"] is None] == ["nobody's"]


def test_no_rows(spark):
    assert exact.find_duplicates(frame(spark, [])).count() == 0
    assert exact.drop_duplicates(frame(spark, [])).count() == 0

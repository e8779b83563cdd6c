"""The manifest held against trees built in plain Python."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from lodestone.llm import merkle

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, tree string, idx int, hash int, path int, r int"
FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]


def frame(spark, rows):
    return spark.createDataFrame([(*r, "?", 1, 2, 3, 4) for r in rows], SCHEMA)


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def leaf(row):
    doc_id, text, lang, source, n_chars = row
    values = (doc_id, source, lang, n_chars, text)
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def tree(hashes, fanout):
    """The root, and the path of every leaf as (before, after) per level."""
    ways, at, level = [[] for _ in hashes], list(range(len(hashes))), list(hashes)
    while len(level) > 1:
        for k, way in enumerate(ways):
            run = at[k] - at[k] % fanout
            way.append(("".join(level[run : at[k]]), "".join(level[at[k] + 1 : run + fanout])))
            at[k] //= fanout
        level = [sha("".join(level[i : i + fanout])) for i in range(0, len(level), fanout)]
    return level[0], ways


def plain(rows, fanout=2, tamper=lambda r: False):
    out, subroots = [], []
    for lang in sorted({r[2] for r in rows}, key=lambda x: (x is not None, (x or "").encode())):
        own = sorted((r for r in rows if r[2] == lang), key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
        subroots.append((lang, own, *tree([leaf(r) for r in own], fanout)))
    if not rows:
        return []
    root, over = tree([s[2] for s in subroots], fanout)
    for (_, own, subroot, ways), top in zip(subroots, over, strict=True):
        for r, way in zip(own, ways, strict=True):
            way = way + top
            now = leaf((*r[:4], r[4] + 1)) if tamper(r) and r[4] is not None else leaf(r)
            for before, after in way:
                now = sha(before + now + after)
            out.append((r[0], leaf(r), subroot, root, sha("".join(b + a for b, a in way)), now, now == root))
    return sorted(out, key=repr)


def found(spark, rows, fanout=2, modulus=3, parts=4):
    made = merkle.manifest(
        frame(spark, rows).repartition(parts), FIELDS, "lang", "doc_id", fanout,
        {"n_chars": F.col("r.n_chars") + 1}, F.col("r.doc_id") % modulus == 0,
    )
    folded = merkle.fold(F.coalesce("changed_leaf", "leaf"), F.col("path"))
    shown = made.select("doc_id", "leaf", "subroot", "root", F.sha2(merkle.siblings(F.col("path")), 256), folded.alias("f"),
                        (folded == F.col("root")).alias("ok"))
    return sorted((tuple(r) for r in shown.collect()), key=repr)


def make(n, seed=1):
    draw = random.Random(seed)
    langs = ["en", "en", "en", "de", "fr", None, "日本", ""]
    rows = [(i * 3 + draw.randint(0, 2), draw.choice(["", "a", "12:x", "é - ", None]), draw.choice(langs),
             draw.choice(["s", None]), draw.choice([None, 0, 7])) for i in range(n)]
    return rows + [(10**6, "alone", "xx", "s", 1)]


def tampered(modulus=3):
    return lambda r: r[0] is not None and r[0] % modulus == 0


@pytest.mark.parametrize(("fanout", "foot"), [(2, 256), (2, 4), (3, 9), (5, 5)])
def test_trees_of_any_fanout(spark, fanout, foot, monkeypatch):
    monkeypatch.setattr(merkle, "_FOOT", foot)
    rows = make(90)
    assert found(spark, rows, fanout) == plain(rows, fanout, tampered())


def test_nulls_ties_and_repeated_rows(spark):
    rows = make(20)
    rows += [(None, "x", "en", "s", 1), (None, None, None, None, None), rows[3], rows[3], (rows[4][0], "other", *rows[4][2:])]
    rows += [(500, "copy", "en", "s", 4)] * 70 + [(501, "word " * 200_000, "de", "s", 1_000_000)]
    assert found(spark, rows, modulus=5) == plain(rows, 2, tampered(5))


def test_one_row_and_no_rows(spark):
    assert found(spark, [(4, "x", "en", None, 1)]) == plain([(4, "x", "en", None, 1)])
    assert found(spark, []) == []


def test_every_proof_holds_without_changes_and_fails_with_one(spark):
    rows = make(40)
    got = {r[0]: r[-1] for r in found(spark, rows)}
    count = {r[0]: r[4] for r in rows}
    assert all(ok == (i % 3 != 0 or count[i] is None) for i, ok in got.items())


def test_numbering_spans_tasks(spark):
    rows = spark.range(5_000).select(F.lit("t").alias("tree"), (F.col("id") % 7).alias("a"), "id").repartition(6)
    got = merkle.numbered(rows, ["a", "id"]).orderBy("idx").collect()
    assert [r["idx"] for r in got] == list(range(5_000)) and {r["n"] for r in got} == {5_000}
    assert [(r["a"], r["id"]) for r in got] == sorted((r["a"], r["id"]) for r in got)


def test_fields_are_kept_apart(spark):
    rows = [(1, "2:a", None, "s", 1), (1, "a", "2:", "s", 1), (1, "-", "en", None, 1), (1, None, "en", "-", 1)]
    assert len({r[1] for r in found(spark, rows)}) == 4


def test_a_fanout_of_one(spark):
    with pytest.raises(ValueError):
        merkle.manifest(frame(spark, []), FIELDS, "lang", "doc_id", 1)

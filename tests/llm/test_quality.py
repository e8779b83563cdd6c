import random
import zlib

from lodestone.llm import quality

SCHEMA = "doc_id long, text string, score string, label int, w int"


def make(n):
    draw = random.Random(2)
    docs, labels = [], []
    for i in range(n):
        words = ["".join(draw.choices("abcdefghij", k=draw.randint(2, 9))) for _ in range(draw.randint(20, 90))]
        good = draw.random() < 0.7
        if good:
            text = ". ".join(" ".join(words[k : k + 9]) for k in range(0, len(words), 9)) + "."
        else:
            text = draw.choice([" ".join(words).upper() + "!!", " ".join(w for w in words for _ in range(9)), " | ".join(words)])
        docs.append((i, text))
        labels.append((i, int(good)))
    return docs, labels


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "?", 5, 6) for i, t in rows], SCHEMA)


def marks(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, quality int")


def test_held_out_documents_are_ranked(spark):
    docs, labels = make(600)
    shown = [(i, q) for i, q in labels if i % 3]
    found = {r["doc_id"]: r for r in quality.score_quality(frame(spark, docs), marks(spark, shown)).collect()}
    assert len(found) == 600
    tried = [(found[i], q) for i, q in labels if zlib.crc32(str(i).encode()) % 4 == 2]
    assert all(r["held_out"] for r, _ in tried)
    good = [r["score"] for r, q in tried if q]
    bad = [r["score"] for r, q in tried if not q]
    assert sum(g > b for g in good for b in bad) > 0.98 * len(good) * len(bad)
    assert all(r["predicted"] == (r["score"] >= 0.7) and 0 <= r["score"] <= 1 for r in found.values())


def test_labels_of_held_out_rows_change_nothing(spark):
    docs, labels = make(200)
    turned = [(i, 1 - q if zlib.crc32(str(i).encode()) % 4 == 2 else q) for i, q in labels]
    a, b = (
        sorted(map(tuple, quality.score_quality(frame(spark, docs), marks(spark, m)).collect())) for m in (labels, turned)
    )
    assert a == b


def test_the_fitted_rules_are_few_and_become_one_expression(spark):
    docs, labels = make(400)
    stats = quality.statistics(frame(spark, docs), "doc_id", "text")
    labelled = stats.join(marks(spark, labels).selectExpr("doc_id", "double(quality) as label"), "doc_id")
    ensemble = quality.fit(labelled)
    assert 0 < len(ensemble.rules) < 100
    plan = stats.select(ensemble.score())._jdf.queryExecution().toString()
    assert "Python" not in plan and "ArrowEval" not in plan


def test_missing_and_odd_texts_labels_and_rows(spark):
    rows = [(1, None), (2, ""), (3, "x" * 200_000), (3, "x" * 200_000), (None, "a b"), (4, "...")]
    none = quality.score_quality(frame(spark, rows), marks(spark, [])).collect()
    assert {r["score"] for r in none} == {0.5} and len(none) == 6
    one = quality.score_quality(frame(spark, rows), marks(spark, [(1, 1), (4, 1), (2, None), (3, 7)])).collect()
    assert len({r["score"] for r in one}) == 1 and one[0]["score"] > 0.5
    assert quality.score_quality(frame(spark, []), marks(spark, [(1, 1)])).count() == 0

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lodestone.functions.embedders import hashing_embedder
from lodestone.operators import embedding, vectors
from lodestone.plans import questions

RUN_TS = "2024-06-01 00:00:00"


def rows(spark, data):
    df = spark.createDataFrame(data, "namespace string, id string, v float, source string")
    return df.select(
        "namespace", "id", F.array("v").alias("values"),
        F.struct(
            "source", F.lit("html").alias("type"), F.lit(0).alias("depth"),
            F.lit(RUN_TS).cast("timestamp_ntz").alias("last_modified"), F.lit("t").alias("text"),
        ).alias("metadata"),
    )


def shown(df):
    return sorted((r["namespace"], r["id"], r["values"][0]) for r in df.collect())


def test_upsert_is_by_namespace_and_id(spark):
    old = rows(spark, [("a", "1", 1.0, "s"), ("b", "1", 2.0, "s"), ("a", "2", 3.0, "s")])
    new = rows(spark, [("a", "1", 9.0, "s"), ("a", "3", 4.0, "r")])
    want = [("a", "1", 9.0), ("a", "2", 3.0), ("a", "3", 4.0), ("b", "1", 2.0)]
    once = vectors.upsert(old, new)
    assert shown(once) == want
    assert shown(vectors.upsert(once, new)) == want
    replaced = vectors.upsert(old, new, replace_sources=True)
    assert shown(replaced) == [("a", "1", 9.0), ("a", "3", 4.0), ("b", "1", 2.0)]


def test_copies_are_reduced_before_the_shuffle(spark):
    df = rows(spark, [("a", "1", 1.0, "s")])
    plan = vectors.upsert(df, df)._jdf.queryExecution().executedPlan().toString()
    assert "partial_max_by" in plan and "Window" not in plan


def test_index_on_disk(spark, tmp_path):
    path = str(tmp_path / "index")
    assert vectors.read_vectors(spark, path).count() == 0
    data = rows(spark, [("a", "1", 1.0, "s"), ("a", "1", 1.0, "s"), ("b", "2", 2.0, "s")])
    assert vectors.append_vectors(data, path, 1) == 3
    assert shown(vectors.read_vectors(spark, path)) == [("a", "1", 1.0), ("b", "2", 2.0)]
    for _ in range(2):
        vectors.append_vectors(rows(spark, [("a", "1", 5.0, "s")]), path, 2)
        assert shown(vectors.read_vectors(spark, path)) == [("a", "1", 5.0), ("b", "2", 2.0)]
    vectors.compact_vectors(spark, path, 3)
    assert shown(vectors.read_vectors(spark, path)) == [("a", "1", 5.0), ("b", "2", 2.0)]
    vectors.append_vectors(rows(spark, [("a", "1", 6.0, "s")]), path, 4)
    assert shown(vectors.read_vectors(spark, path)) == [("a", "1", 6.0), ("b", "2", 2.0)]
    header = vectors.index_header(spark, path).first()
    assert (header["dimension"], header["metric"]) == (1, "cosine")
    with pytest.raises(ValueError):
        vectors.create_index(spark, path, RUN_TS)
    vectors.create_index(spark, path, RUN_TS, dimension=1, confirm=True)
    assert vectors.read_vectors(spark, path).count() == 0
    assert vectors.upload_if_empty(data, path, "test", 3)
    assert not vectors.upload_if_empty(data, path, "test", 4)
    assert vectors.upload_if_empty(data.withColumn("id", F.lit("9")), path, "test", 4, force=True)
    stats = dict(vectors.namespace_stats(vectors.read_vectors(spark, path), ["prod"]).collect())
    assert stats == {"test": 3, "prod": 0}


def test_dimension_check(spark):
    df = rows(spark, [("a", "1", 1.0, "s"), ("a", "2", 1.0, "r"), ("a", "3", 1.0, None)])
    df = df.withColumn("values", F.when(F.col("id") == "1", F.col("values")).when(F.col("id") == "2", F.array().cast("array<float>")))
    valid, wrong = vectors.validate_vectors(df, 1)
    assert [r["id"] for r in valid.collect()] == ["1"]
    assert sorted((r["url"] or "", r["error"], r["stage"]) for r in wrong.collect()) == [
        ("", "vector 3 has 0 values instead of 1", "uploading"), ("r", "vector 2 has 0 values instead of 1", "uploading"),
    ]


def test_counts_leave_out_missing_sources(spark):
    df = rows(spark, [("a", "1", 1.0, "s"), ("a", "2", 1.0, "s"), ("a", "3", 1.0, None)])
    assert dict(vectors.vectors_per_document(df).collect()) == {"s": 2}


def chunk_frame(spark, n):
    return spark.range(n, numPartitions=1).select(
        F.concat(F.lit("c"), "id").alias("chunk_id"), F.lit("s").alias("source"),
        F.concat(F.lit("word"), "id").alias("text"), F.lit("html").alias("type"), F.lit(0).alias("depth"),
        F.lit(RUN_TS).cast("timestamp_ntz").alias("last_modified"),
    )


def test_a_failing_batch_costs_only_itself(spark):
    def embedder(texts):
        assert len(texts) <= 16
        if "word20" in texts:
            raise RuntimeError("no service")
        return np.array([[float(t[4:]), 1.0] for t in texts])

    embedded = embedding.with_vectors(chunk_frame(spark, 50), embedder).collect()
    assert {r["chunk_id"] for r in embedded if r["error"]} == {f"c{i}" for i in range(16, 32)}
    assert all(r["values"] == [float(r["text"][4:]), 1.0] for r in embedded if not r["error"])
    df = embedding.with_vectors(chunk_frame(spark, 50), embedder)
    assert embedding.vector_record(df, "test").count() == 34
    assert [(r["url"], r["error"]) for r in embedding.embedding_failures(df, RUN_TS).collect()] == [("s", "no service")]


def test_wrong_number_of_vectors_is_a_failure(spark):
    df = embedding.with_vectors(chunk_frame(spark, 3), lambda texts: np.ones((1, 2)))
    assert {r["error"] for r in df.collect()} == {"1 vectors for 3 texts"}


def test_hashing_embedder():
    vectors_ = hashing_embedder(16)(["a b a", "", "a b a"])
    assert np.allclose(np.linalg.norm(vectors_, axis=1), [1, 0, 1])
    assert (vectors_[0] == vectors_[2]).all()


def test_embedding_plan_calls_the_embedder_once(spark):
    df = embedding.embed(chunk_frame(spark, 3), hashing_embedder(4), "test")
    plan = df.select("id", "values")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1


def test_answers_for_every_question(spark):
    chunks = chunk_frame(spark, 9)
    stored = embedding.embed(chunks, hashing_embedder(32), "test")
    asked = spark.createDataFrame([(1, "word3"), (2, "")], "query_id int, text string")
    got = {r["query_id"]: r for r in questions.answer_inputs(asked, stored, hashing_embedder(32), "test", 2).collect()}
    assert "word3" in got[1]["prompt"] and got[1]["sources"] == ["s", "s"]
    assert got[2]["sources"] is None
    none = questions.answer_inputs(asked, stored, hashing_embedder(32), "prod", 2)
    assert {r["sources"] for r in none.collect()} == {None}


def test_a_vector_of_another_dimension_is_refused(spark, tmp_path):
    path = str(tmp_path / "index")
    vectors.create_index(spark, path, RUN_TS, dimension=2)
    with pytest.raises(ValueError, match="2 dimensions"):
        vectors.append_vectors(rows(spark, [("a", "1", 1.0, "s")]), path, 1)
    assert vectors.read_vectors(spark, path).count() == 0


def test_a_new_index_does_not_find_an_unfinished_compaction(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "index")
    vectors.append_vectors(rows(spark, [("a", "1", 1.0, "s")]), path, 1)

    def lost(*_):
        raise ConnectionError

    with monkeypatch.context() as m:
        m.setattr(vectors.tables, "write_table", lost)
        with pytest.raises(ConnectionError):
            vectors.compact_vectors(spark, path, 2)
    vectors.create_index(spark, path, RUN_TS, dimension=1, confirm=True)
    assert vectors.read_vectors(spark, path).count() == 0


def test_vectors_leave_the_worker_in_slices_of_whole_batches(spark, monkeypatch):
    monkeypatch.setattr(embedding, "SLICE_TEXTS", 10)
    embed = hashing_embedder(4)

    def picky(texts):
        if "word17" in texts:
            raise RuntimeError("refused")
        return embed(texts)

    texts = pa.array([f"word{i}" for i in range(30)])
    parts = list(embedding._embedding_column(picky, 4).func(iter([texts, pa.array([], pa.string())])))
    assert [len(p) for p in parts] == [8, 8, 8, 6, 0]
    out = [row for p in parts for row in p.to_pylist()]
    assert [i for i, row in enumerate(out) if row["error"]] == [16, 17, 18, 19]
    want = embed(texts.to_pylist()).astype(np.float32)
    assert all(row["values"] == want[i].tolist() for i, row in enumerate(out) if not row["error"])

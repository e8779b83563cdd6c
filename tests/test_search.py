import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lodestone.operators import search
from lodestone.operators.retrieval import assemble_prompts, sources


def frame(spark, rows, key):
    data = [(i, [float(x) for x in v] if v is not None else None) for i, v in rows]
    return spark.createDataFrame(data, f"{key} string, values array<float>")


def brute(questions, corpus, k):
    out = []
    for q, a in questions:
        scored = []
        for i, b in corpus:
            if b is None or a is None or not np.any(b) or not np.any(a):
                continue
            a64, b64 = np.asarray(a, np.float32).astype(float), np.asarray(b, np.float32).astype(float)
            score = round(float(a64 @ b64 / np.sqrt(a64 @ a64) / np.sqrt(b64 @ b64)), 9)
            scored.append((-score, i))
        out += [(q, rank, i, -s) for rank, (s, i) in enumerate(sorted(scored)[:k], 1)]
    return sorted(out)


def found(df):
    return sorted((r["query_id"], r["rank"], r["id"], r["similarity"]) for r in df.collect())


@pytest.fixture(scope="module")
def data():
    rng = np.random.default_rng(7)
    corpus = [(f"c{i:04d}", rng.normal(size=8)) for i in range(400)]
    # A third of all rows are one vector, so that ties cross every batch and block.
    corpus += [(f"t{i:04d}", np.ones(8)) for i in range(200)]
    corpus += [("zero", np.zeros(8)), ("none", None)]
    questions = [(f"q{i:02d}", rng.normal(size=8)) for i in range(30)] + [("ones", np.ones(8) * 3), ("null", None), ("zeros", np.zeros(8))]
    return questions, corpus


@pytest.mark.parametrize("k", [1, 5, 700])
@pytest.mark.parametrize("way", ["broadcast", "grid"])
def test_both_ways_equal_brute_force(spark, data, way, k):
    questions, corpus = data
    sizes = {} if way == "broadcast" else {"broadcast_bytes": 8 * 8 * 10, "block_bytes": 8 * 8 * 90}
    q, c = frame(spark, questions, "query_id"), frame(spark, corpus, "id").repartition(5)
    assert found(search.search(q, c, k, **sizes)) == brute(questions, corpus, k)


def test_small_batches_and_tiles(spark, data, monkeypatch):
    questions, corpus = data
    monkeypatch.setattr(search, "TILE_CELLS", 100)
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        q, c = frame(spark, questions, "query_id"), frame(spark, corpus, "id")
        assert found(search.search(q, c, 5)) == brute(questions, corpus, 5)
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)


def test_hits_gathered_in_blocks_of_questions(spark, data, monkeypatch):
    monkeypatch.setattr(search, "HIT_ROWS", 4)
    q, c = frame(spark, data[0], "query_id"), frame(spark, data[1], "id")
    assert found(search.search(q, c, 5)) == brute(*data, 5)


def test_empty_sides(spark, data):
    q, c = frame(spark, data[0], "query_id"), frame(spark, data[1], "id")
    assert search.search(q.limit(0), c).count() == 0
    assert search.search(q, c.limit(0)).count() == 0


@pytest.mark.parametrize("rounds", [1, 4])
def test_columns_are_fetched_for_the_rows_found(spark, data, rounds):
    questions, corpus = data
    sizes = {} if rounds == 1 else {"broadcast_bytes": 8 * 8 * 5, "block_bytes": 8 * 8 * 10}
    # Two texts under one id, and rows equal in everything.
    rows = [(i, None if v is None else [float(x) for x in v], text) for i, v in corpus[:40] + corpus[-4:] for text in ("one", "two", "two", None)]
    c = spark.createDataFrame(rows, "id string, values array<float>, text string").repartition(3)
    asked = frame(spark, questions, "query_id")
    hits = search.search(asked, c, 8, **sizes)
    assert hits.columns == ["query_id", "rank", "id", "text", "similarity"]
    got = found(hits)
    assert got == brute(questions, [(i, v) for i, v, _ in rows], 8)
    texts = {}
    for row in hits.collect():
        texts.setdefault((row["query_id"], row["id"]), []).append(row["text"])
    full = [t for t in texts.values() if len(t) == 4]
    assert full and all(sorted(map(str, t)) == ["None", "one", "two", "two"] for t in full)


def test_a_grid_takes_as_many_jobs_for_blocks_of_any_size(spark, data):
    q, c = frame(spark, data[0], "query_id"), frame(spark, data[1], "id")
    jobs = []
    for block in (2, 20):
        spark.sparkContext.setJobGroup(f"grid-{block}", "")
        assert found(search.search(q, c, 5, broadcast_bytes=8 * 8, block_bytes=8 * 8 * block)) == brute(*data, 5)
        jobs.append(len(spark.sparkContext.statusTracker().getJobIdsForGroup(f"grid-{block}")))
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert jobs[0] == jobs[1]


def test_groups_of_a_grid_are_of_bounded_size(spark, data, monkeypatch):
    monkeypatch.setattr(search, "GROUP_BYTES", 8 * 8 * 30)
    q, c = frame(spark, data[0], "query_id"), frame(spark, data[1], "id")
    assert found(search.search(q, c, 5, broadcast_bytes=8 * 8)) == brute(*data, 5)


def test_rows_below_the_floor_of_a_question_are_no_candidates():
    corpus = pa.table({"id": ["a", "b", "c"], "values": pa.array([[1.0, 0.0], [0.0, 1.0], [1.0, 1.0]])})
    corpus = search._prepared(corpus, 2)
    asked, names = np.array([[1.0, 0.0], [0.0, 1.0]]), pa.array(["x", "y"])
    kept = search._best(search._candidates(asked, names, corpus, 2), 2)
    assert kept.column("id").to_pylist() == ["a", "c", "b", "c"]
    floor = np.full(2, -np.inf)
    search._raise_floor(floor, kept, 3)
    assert (floor == -np.inf).all()
    search._raise_floor(floor, kept, 2)
    assert floor.round(6).tolist() == [0.707107, 0.707107]
    later = search._candidates(asked, names, corpus, 2, floor)
    assert later.num_rows == 4
    floor[0] = 0.8
    later = search._candidates(asked, names, corpus, 2, floor)
    assert list(zip(later["query_id"].to_pylist(), later["id"].to_pylist())) == [("x", "a"), ("y", "b"), ("y", "c")]


def test_questions_of_one_id_are_ranked_as_one(spark, data):
    corpus = data[1][:50]
    asked = [("same", v) for _, v in data[0][:12]]
    q, c = frame(spark, asked, "query_id"), frame(spark, corpus, "id")
    once = found(search.search(q, c, 6))
    assert [r[1] for r in once] == list(range(1, 7))
    assert found(search.search(q, c, 6, broadcast_bytes=8 * 8, block_bytes=8 * 8 * 5)) == once


@pytest.mark.parametrize("rounds", [1, 4])
def test_the_corpus_stays_put(spark, tmp_path, data, rounds):
    sizes = {} if rounds == 1 else {"broadcast_bytes": 8 * 8 * 5, "block_bytes": 8 * 8 * 10}
    c = frame(spark, data[1], "id").withColumn("text", F.repeat(F.lit("word "), 20))
    c.write.parquet(str(tmp_path / "corpus"))
    stored = spark.read.parquet(str(tmp_path / "corpus"))
    hits = search.search(frame(spark, data[0], "query_id"), stored, 5, **sizes)
    hits.collect()
    plan = hits._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan and "CartesianProduct" not in plan
    # The pass that fetches texts reads no vectors.
    scans = [line for line in plan.splitlines() if "FileScan" in line]
    assert any("struct<id:string,text:string>" in line for line in scans)


def test_namespace_filter_reaches_the_scan(spark, tmp_path, data):
    q = frame(spark, data[0], "query_id")
    c = frame(spark, data[1], "id").withColumn("namespace", F.when(F.col("id") < "c02", "a").otherwise("b"))
    c.write.partitionBy("namespace").parquet(str(tmp_path / "v"))
    part = spark.read.parquet(str(tmp_path / "v")).filter("namespace = 'a'").select("id", "values")
    hits = search.search(q, part)
    plan = hits._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(namespace" in plan
    assert "WindowGroupLimit" in plan
    assert all(r["id"] < "c02" for r in hits.collect())


def test_prompts_and_sources(spark):
    hits = spark.createDataFrame(
        [(1, 2, "s2", "two"), (1, 1, "s1", "one {question}"), (1, 3, "s1", "three")],
        "query_id int, rank int, source string, text string",
    )
    questions = spark.createDataFrame([(1, "why {context}?"), (2, "how?")], "query_id int, text string")
    got = {r["query_id"]: r["prompt"] for r in assemble_prompts(hits, questions, "C:{context}|Q:{question}.").collect()}
    assert got == {1: "C:one {question}\n\ntwo\n\nthree|Q:why {context}?.", 2: "C:|Q:how?."}
    assert sources(hits).first()["sources"] == ["s1", "s2", "s1"]

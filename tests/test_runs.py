"""Incremental, streaming and staged runs: what a second or broken run does."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone import schemas
from lodestone.functions.embedders import hashing_embedder
from lodestone.operators import incremental, vectors
from lodestone.operators import status as st
from lodestone.operators.embedding import with_vectors
from lodestone.operators.selecting import drop_keys, keep_keys
from lodestone.plans import corpus_build, discovery, maintenance, pdf_build
from lodestone.sources import tables
from lodestone.streaming import ingest

T1, T2 = "2024-01-01 00:00:00", "2024-01-02 00:00:00"


def docs(spark, *rows):
    df = spark.createDataFrame([(u, t, m) for u, t, m in rows], "url string, text string, m string")
    return df.select("url", "text", F.lit("html").alias("type"), F.col("m").cast("timestamp_ntz").alias("last_modified"))


def words(tag, n=30):
    return " ".join(f"{tag}{i}" for i in range(n))


def registry(spark, *rows):
    df = spark.createDataFrame(list(rows), "url string, m string")
    return df.select("url", F.col("m").cast("timestamp_ntz").alias("last_modified"), F.lit(1).cast("bigint").alias("vector_count"), F.lit("x").alias("last_vector_id"))


def test_changed_documents(spark):
    d = docs(spark, ("same", "x", T1), ("newer", "x", T2), ("older", "x", T1), ("new", "x", T1), ("undated", "x", None), ("new undated", "x", None), ("twice", "x", T1), ("twice", "y", T2))
    r = registry(spark, ("same", T1), ("newer", T1), ("older", T2), ("undated", T1), ("twice", T1), ("unrelated", T1))
    got = sorted((row["url"], row["text"]) for row in incremental.changed_documents(d, r).collect())
    assert got == [("new", "x"), ("new undated", "x"), ("newer", "x"), ("twice", "y")]


def test_selecting_uses_the_smaller_set(spark):
    rows = spark.range(100).withColumn("text", F.lit("t"))
    few, most = (rows.filter(f"id < {n}").select("id") for n in (3, 97))
    for keys, n, kept, dropped in (
        (few, 3, "LeftSemi", "LeftAnti"), (most, 97, "LeftAnti", "LeftSemi"), (rows.limit(0), 0, None, None), (rows, 100, None, None),
    ):
        for chosen, count, kind in ((keep_keys(rows, keys, "id"), n, kept), (drop_keys(rows, keys, "id"), 100 - n, dropped)):
            assert chosen.count() == count and chosen.columns == rows.columns
            if kind:
                assert f"{kind}, BuildRight" in chosen._jdf.queryExecution().executedPlan().toString()


def test_selecting_treats_nulls_as_a_key(spark):
    rows = spark.createDataFrame([(None, 1), ("a", 2), ("b", 3)], "k string, v int")
    for keys in ([("a",)], [(None,)], [("a",), (None,)], [("a",), ("b",)]):
        df = spark.createDataFrame(keys, "k string")
        wanted = {k for (k,) in keys}
        assert {r["k"] for r in keep_keys(rows, df, "k").collect()} == wanted
        assert {r["k"] for r in drop_keys(rows, df, "k").collect()} == {None, "a", "b"} - wanted


def test_registry_entries_replace_old_ones(spark):
    v = spark.createDataFrame([("a", "1", T1), ("a", "2", T2), ("b", "3", T1)], "s string, id string, m string").select(
        "id", F.struct(F.col("s").alias("source"), F.col("m").cast("timestamp_ntz").alias("last_modified")).alias("metadata")
    )
    got = {r["url"]: (str(r["last_modified"]), r["vector_count"], r["last_vector_id"]) for r in incremental.update_registry(registry(spark, ("a", T1), ("c", T1)), v).collect()}
    assert got == {"a": (T2, 2, "2"), "b": (T1, 1, "3"), "c": (T1, 1, "x")}
    assert incremental.registry_ids(v).count() == 3


def test_batches_and_replays(spark, tmp_path):
    root, embedder = str(tmp_path), hashing_embedder(8)

    def run(batch_id, *rows):
        return ingest.ingest_batch(docs(spark, *rows), root, batch_id, embedder, "test", T2)

    def stored():
        return sorted((r["metadata"]["source"], r["metadata"]["text"][:2]) for r in vectors.read_vectors(spark, f"{root}/index").collect())

    assert run(0, ("a", words("a"), T1), ("b", words("b"), T1)) == 2
    assert run(0, ("a", words("a"), T1), ("b", words("b"), T1)) == 0
    assert run(1, ("a", words("a"), T1), ("b", words("c"), T2)) == 1
    # Vectors of the older form of a document stay.
    assert stored() == [("a", "a0"), ("b", "b0"), ("b", "c0")]
    # A crash between vectors and registry: the replay replaces its own rows.
    fresh = incremental.embed_changed(docs(spark, ("d", words("d"), T1)), incremental.read_registry(spark, f"{root}/registry"), embedder, "test", T2)
    vectors.append_vectors(fresh, f"{root}/index", 2)
    assert run(2, ("d", words("d"), T1)) == 1
    assert stored() == [("a", "a0"), ("b", "b0"), ("b", "c0"), ("d", "d0")]
    assert {r["url"]: r["vector_count"] for r in incremental.read_registry(spark, f"{root}/registry").collect()} == {"a": 1, "b": 1, "d": 1}


def test_stream_resumes(spark, tmp_path):
    root, folder = str(tmp_path / "root"), tmp_path / "in"

    def arrive(name, *rows):
        docs(spark, *rows).coalesce(1).write.parquet(str(folder / name))

    def drain():
        schema = "url string, text string, type string, last_modified timestamp_ntz"
        stream = spark.readStream.schema(schema).option("recursiveFileLookup", "true").parquet(str(folder))
        query = ingest.ingest_stream(stream, root, hashing_embedder(8), "test", T2)
        query.awaitTermination()
        return vectors.read_vectors(spark, f"{root}/index").count()

    arrive("1", ("a", words("a"), T1))
    assert drain() == 1
    assert drain() == 1
    arrive("2", ("a", words("x"), T1), ("b", words("b"), T1))
    assert drain() == 2


def pages(spark, *rows):
    df = spark.createDataFrame(list(rows), "url string, status int, body string")
    return df.select("url", "status", F.concat(F.lit("<h1>T</h1><div id='contentarea'>"), "body", F.lit("<a href='/n'>n</a></div>")).alias("html"))


def state(run):
    return {r["url"]: (r["status"], r["stage"], r["chunks_count"], r["embeddings_count"]) for r in run.status().collect()}


def test_staged_build_resumes(spark, tmp_path):
    run = corpus_build.Run(spark, str(tmp_path), T1)
    found = spark.createDataFrame([("http://h/a",), ("http://h/b",), ("http://h/c",)], "url string")
    fetched = pages(spark, ("http://h/a", 200, words("a", 200)), ("http://h/b", 200, "no"), ("http://h/c", 500, words("c")))

    def failing(texts):
        raise RuntimeError("no service")

    corpus_build.scrape(run, found, fetched)
    assert state(run) == {"http://h/a": ("completed", "scraped", None, None), "http://h/b": ("completed", "scraped", None, None)}
    assert [(r["url"], r["stage"]) for r in corpus_build.all_failures(run).collect()] == [("http://h/c", "scraping")]
    assert sorted((r["src"], r["dst"]) for r in corpus_build.links(run).collect()) == [("http://h/a", "http://h/n"), ("http://h/b", "http://h/n")]

    # Output of a chunk stage that never got to write its status is replaced.
    junk = spark.createDataFrame([("j", "http://h/a", 0, "junk")], "chunk_id string, source string, chunk_index int, text string").withColumn("error", F.lit(None).cast("string"))
    tables.append_results(schemas.conform(junk, corpus_build._CHUNK), run.path("chunks"), run.write_seq)
    corpus_build.chunk_stage(run, found)
    n = state(run)["http://h/a"][2]
    assert n > 1 and state(run)["http://h/b"] == ("completed", "chunked", 0, None)
    assert state(run)["http://h/c"] == ("pending", "discovered", None, None)
    assert run.results("chunks", corpus_build._CHUNK, "source").filter("text = 'junk'").count() == 0

    corpus_build.embed_stage(run, found, failing)
    assert state(run)["http://h/a"] == ("failed", "embedding", n, None)
    # The documented way back is a reset to the chunked stage.
    tables.write_status(st.reset_to_chunked(run.status()), run.path("status"))
    corpus_build.embed_stage(run, found, hashing_embedder(8))
    assert state(run)["http://h/a"] == ("completed", "embedded", n, n)
    assert corpus_build.upload_stage(run, found, "test", 8) == n
    assert state(run)["http://h/a"] == ("completed", "uploaded", n, n)
    assert vectors.read_vectors(spark, run.path("index")).count() == n

    # The page that failed comes back; what is done is not done again.
    fetched = pages(spark, ("http://h/a", 200, "other"), ("http://h/c", 200, words("c")))
    assert corpus_build.build(run, found, fetched, hashing_embedder(8), "test", 8) == 1
    assert state(run)["http://h/c"] == ("completed", "uploaded", 1, 1)
    assert vectors.read_vectors(spark, run.path("index")).count() == n + 1
    corpus_build.merge_small(run)
    assert tables.read_combined(spark, run.path("combined")).count() >= 1


def test_wrong_dimension_is_logged_and_tried_again(spark, tmp_path):
    run = corpus_build.Run(spark, str(tmp_path), T1)
    found = spark.createDataFrame([("http://h/a",)], "url string")
    fetched = pages(spark, ("http://h/a", 200, words("a")))
    assert corpus_build.build(run, found, fetched, hashing_embedder(8), "test", 9) == 0
    assert state(run)["http://h/a"][1] == "embedded"
    assert [r["stage"] for r in corpus_build.all_failures(run).collect()] == ["uploading"]
    assert corpus_build.upload_stage(run, found, "test", 8) == 1
    assert state(run)["http://h/a"][1] == "uploaded"


def test_vectors_keep_single_precision(spark):
    df = with_vectors(spark.createDataFrame([("t",)], "text string"), lambda texts: np.array([[0.1, 1e-30]]))
    assert df.schema["values"].dataType.simpleString() == "array<float>"
    assert df.first()["values"] == [float(np.float32(0.1)), float(np.float32(1e-30))]


def test_pdf_run_stops_at_the_first_failing_stage(spark, tmp_path):
    run = corpus_build.Run(spark, str(tmp_path), T1)
    texts = spark.createDataFrame(
        [("a.pdf", 1, words("a")), ("a.pdf", 2, words("b")), ("b.pdf", 1, ""), ("c.pdf", 1, words("bad"))],
        "path string, page int, text string",
    )

    def embedder(rows):
        if any("bad0" in row for row in rows):
            raise RuntimeError("no service")
        return np.ones((len(rows), 2))

    pdfs = texts.select("path").distinct()
    assert pdf_build.build(run, pdfs, texts.repartition(4, "path", "page"), embedder, "test", 2) == 2
    assert state(run) == {
        "a.pdf": ("completed", "uploaded", 2, 2), "b.pdf": ("failed", "discovered", None, None),
        "c.pdf": ("failed", "chunked", 1, None),
    }
    assert pdf_build.build(run, pdfs, texts, lambda rows: np.ones((len(rows), 2)), "test", 2) == 1
    assert state(run)["c.pdf"] == ("completed", "uploaded", 1, 1)
    assert vectors.read_vectors(spark, run.path("index")).count() == 3


def test_recovery_and_resets(spark, tmp_path):
    run = corpus_build.Run(spark, str(tmp_path / "root"), T1)
    found = spark.createDataFrame([("http://h/a",), ("http://h/b",)], "url string")
    corpus_build.scrape(run, found, pages(spark, ("http://h/a", 200, words("a"))))
    assert corpus_build.all_failures(run).count() == 1
    maintenance.reset_failures(run)
    assert corpus_build.all_failures(run).count() == 0
    (tmp_path / "ck").mkdir()

    def vector(i, source):
        return {"id": i, "values": [1.0], "metadata": {"source": source, "text": "t"}}

    for n, rows in ((2, [vector("1", "http://h/a"), vector("9", "http://h/zzz")]), (10, [vector("1", "http://h/a"), vector("2", "http://h/a")])):
        (tmp_path / "ck" / f"embeddings_checkpoint_{n}.json").write_text(json.dumps(rows))
    unknown = maintenance.recover_checkpoints(run, str(tmp_path / "ck"))
    assert [r["source"] for r in unknown.collect()] == ["http://h/zzz"]
    assert state(run) == {"http://h/a": ("completed", "embedded", None, 2)}
    assert run.results("recovered", corpus_build.RECOVERED, "source", "id").count() == 2
    assert corpus_build.upload_stage(run, found, "test", 1) == 2
    assert state(run) == {"http://h/a": ("completed", "uploaded", None, 2)}
    maintenance.reset_to_chunked(run)
    assert state(run) == {"http://h/a": ("completed", "chunked", None, None)}


def test_site_discovery(spark, tmp_path):
    rows = [
        ("http://h/a", 200, "text/html", "<a href='b'>x</a><a href='c'>x</a><a href='http://g/'>x</a>"),
        ("http://h/b", 200, "text/html", "<a href='a'>x</a><a href='d.pdf'>x</a>"),
        ("http://h/c", 404, "text/html", "<a href='e'>x</a>"),
        ("http://h/d.pdf", 200, "application/pdf", None), ("http://h/e", 200, "text/html", ""),
    ]
    fetched = spark.createDataFrame(rows, "url string, status int, content_type string, html string")
    found = discovery.discover_site(spark, str(tmp_path), fetched, "http://h/a", T1)
    assert sorted((r["url"], r["depth"], r["is_pdf"]) for r in found.collect()) == [
        ("http://h/a", 0, False), ("http://h/b", 1, False), ("http://h/d.pdf", 2, True),
    ]
    assert tables.read_table(spark, f"{tmp_path}/discovery_run", schemas.DISCOVERY_RUN).first()["max_depth"] == 2


def test_a_retry_replaces_the_whole_attempt(spark, tmp_path):
    path = str(tmp_path / "log")
    first = spark.createDataFrame([("a", "bad"), ("b", "bad"), ("c", None)], "url string, error string")
    second = spark.createDataFrame([("a", None), ("b", None)], "url string, error string")
    other = spark.createDataFrame([("z", "kept")], "url string, error string")
    tables.append_results(other, path, 6)
    tables.append_results(first, path, 7)
    tables.append_results(second, path, 7)
    rows = {
        (r["url"], r["error"], r["write_seq"])
        for result in ("ok", "failed")
        for r in tables.read_log(spark, f"{path}/result={result}", "url string, error string").collect()
    }
    assert rows == {("a", None, 7), ("b", None, 7), ("z", "kept", 6)}


def test_runs_of_several_writers_have_numbers_of_their_own(spark, tmp_path):
    path = str(tmp_path / "log")
    claims = [tables.claim_run(spark, path, w, n) for w, n in [("a", 4), ("b", 4), ("a", 4), ("a", 5), ("b", 4)]]
    assert claims == [1, 2, 1, 3, 2]


def test_documents_with_failed_chunks_are_not_registered(spark, tmp_path):
    root = str(tmp_path)
    batch = docs(spark, ("a", words("a"), T1), ("b", words("b"), T1))
    good = hashing_embedder(8)

    def picky(texts):
        if any("b" in t for t in texts):
            raise RuntimeError("refused")
        return good(texts)

    ingest.ingest_batch(batch.filter("url = 'a'"), root, 0, picky, "test", T2)
    ingest.ingest_batch(batch, root, 1, picky, "test", T2)
    assert {r["url"] for r in incremental.read_registry(spark, f"{root}/registry").collect()} == {"a"}
    assert {(r["url"], r["error"]) for r in tables.read_failures(spark, f"{root}/failures_ingest").collect()} == {("b", "refused")}
    ingest.ingest_batch(batch, root, 2, good, "test", T2)
    assert {r["metadata"]["source"] for r in vectors.read_vectors(spark, f"{root}/index").collect()} == {"a", "b"}


def test_pdfs_of_a_web_build_come_from_their_page_texts(spark, tmp_path):
    run = corpus_build.Run(spark, str(tmp_path), T1)
    urls = ["http://h/a", "http://h/b.pdf", "http://h/c.pdf", "http://h/d.pdf"]
    found = spark.createDataFrame([(u,) for u in urls], "url string")
    fetched = spark.createDataFrame([(u, 200, "<p>page</p>" if u[-1] == "a" else None) for u in urls], "url string, status int, html string")
    texts = [("http://h/b.pdf", 2, "two"), ("http://h/b.pdf", 1, "one "), ("http://h/c.pdf", 1, " ")]
    corpus_build.scrape(run, found, fetched, spark.createDataFrame(texts, "url string, page int, text string"))
    stage = {r["url"]: r["stage"] for r in run.status().filter("status = 'completed'").collect()}
    assert stage == {"http://h/a": "scraped", "http://h/b.pdf": "scraped"}
    assert {r["url"]: r["error"] for r in corpus_build.all_failures(run).collect()} == {
        "http://h/c.pdf": "no text in the file", "http://h/d.pdf": "no content returned",
    }


def sources(spark, path):
    rows = vectors.read_vectors(spark, path).select("metadata.source", "metadata.text").collect()
    return sorted((r["source"], r["text"][:8]) for r in rows)


def vector_rows(spark, *rows):
    made = [("test", f"{source}-{text}", [1.0], (source, "html", 0, None, text)) for source, text in rows]
    return spark.createDataFrame(made, schemas.VECTOR)


def test_replacing_a_source_takes_back_what_earlier_runs_stored(spark, tmp_path):
    path = str(tmp_path / "index")
    vectors.append_vectors(vector_rows(spark, ("a", "1"), ("a", "2"), ("b", "1"), (None, "n")), path, 1)
    vectors.append_vectors(vector_rows(spark, ("a", "3"), (None, "m")), path, 2, replace_sources=True)
    now = [("a", "3"), ("b", "1")]
    shown = sorted((r["metadata"]["source"] or "", r["metadata"]["text"]) for r in vectors.read_vectors(spark, path).collect())
    assert shown == [("", "m"), ("", "n"), *now]
    # A run that adds to a source later on stays; one that is repeated replaces itself only.
    vectors.append_vectors(vector_rows(spark, ("a", "4")), path, 3)
    vectors.append_vectors(vector_rows(spark, ("a", "5")), path, 2, replace_sources=True)
    kept = vectors.read_vectors(spark, path).filter("metadata.source is not null")
    assert sorted(r["id"] for r in kept.collect()) == ["a-4", "a-5", "b-1"]
    # Sources may be named instead, also ones without vectors.
    gone = spark.createDataFrame([("test", "b"), ("prod", "a")], "namespace string, source string")
    vectors.append_vectors(vector_rows(spark, ("c", "1")), path, 4, replace_sources=True, replaced=gone)
    left = {r["metadata"]["source"] for r in vectors.read_vectors(spark, path).collect()}
    assert left == {"a", "c", None}
    vectors.compact_vectors(spark, path, 9)
    assert {r["metadata"]["source"] for r in vectors.read_vectors(spark, path).collect()} == left


@pytest.mark.parametrize("step", ["append_log", "publish_replaced"])
def test_a_replacing_run_that_is_lost_shows_what_was_there(spark, tmp_path, monkeypatch, step):
    path = str(tmp_path / "index")
    vectors.append_vectors(vector_rows(spark, ("a", "1"), ("b", "1")), path, 1)

    def lost(*_):
        raise ConnectionError

    for _ in range(2):
        with monkeypatch.context() as m:
            m.setattr(vectors.tables, step, lost)
            with pytest.raises(ConnectionError):
                vectors.append_vectors(vector_rows(spark, ("a", "2")), path, 2, replace_sources=True)
        assert sources(spark, path) == [("a", "1"), ("b", "1")]
        vectors.append_vectors(vector_rows(spark, ("c", "1")), path, 7)
        vectors.append_vectors(vector_rows(spark), path, 7)
    vectors.append_vectors(vector_rows(spark, ("a", "2")), path, 2, replace_sources=True)
    assert sources(spark, path) == [("a", "2"), ("b", "1")]


def test_changed_documents_lose_their_old_vectors(spark, tmp_path):
    root, good = str(tmp_path), hashing_embedder(8)
    T3 = "2024-01-03 00:00:00"

    def picky(texts):
        if any("c0" in t for t in texts):
            raise RuntimeError("refused")
        return good(texts)

    first = docs(spark, ("a", words("a", 200), T1), ("b", words("b"), T1), ("c", words("c"), T1), ("d", words("d"), T1))
    ingest.ingest_batch(first, root, 0, good, "test", T2)
    second = docs(spark, ("a", words("x"), T3), ("b", "short", T3), ("c", words("c", 50), T3), ("d", words("d"), T1))
    for _ in range(2):
        ingest.ingest_batch(second, root, 1, picky, "test", T3, replace_sources=True)
        found = vectors.read_vectors(spark, f"{root}/index").select("metadata.source", "metadata.text").collect()
        assert sorted(r["source"] for r in found) == ["a", "c", "d"]
        assert {r["source"]: r["text"] for r in found}["a"].startswith("x0")
    entries = {r["url"]: r["vector_count"] for r in incremental.read_registry(spark, f"{root}/registry").collect()}
    assert entries == {"a": 1, "b": 0, "c": 1, "d": 1}


def test_ids_of_a_source_are_those_of_its_entry(spark, tmp_path, monkeypatch):
    root, embedder = str(tmp_path), hashing_embedder(8)

    def run(batch_id, *rows):
        return ingest.ingest_batch(docs(spark, *rows), root, batch_id, embedder, "test", T2, replace_sources=True)

    def ids(sources=None):
        return sorted(map(tuple, incremental.source_ids(spark, f"{root}/registry", sources).collect()))

    def in_index():
        return sorted((r["metadata"]["source"], r["id"]) for r in vectors.read_vectors(spark, f"{root}/index").collect())

    assert ids() == []
    run(0, ("a", words("a", 3000), T1), ("b", words("b"), T1), ("c", words("c"), T1))
    first = ids()
    assert first == in_index() and len([u for u, _ in first if u == "a"]) > 1
    run(1, ("a", words("x"), T2), ("b", "gone", T2))
    assert ids() == in_index() and {u for u, _ in ids()} == {"a", "c"}
    assert ids(spark.createDataFrame([("c",), ("none",)], "url string")) == [r for r in first if r[0] == "c"]
    before = ids()

    def lost(*_):
        raise ConnectionError("lost")

    with monkeypatch.context() as patched:
        patched.setattr(incremental, "write_registry", lost)
        with pytest.raises(ConnectionError):
            run(2, ("c", words("y"), T2))
    assert ids() == before
    run(2, ("c", words("y"), T2))
    assert ids() == in_index() != before


def test_merged_documents_are_chunked_for_all_their_urls(spark, tmp_path):
    run = corpus_build.Run(spark, str(tmp_path), T1)
    urls = ["http://h/s/t/1", "http://h/s/t/2", "http://h/s/t/3", "http://h/s/t/4", "http://h/u/v/1", "http://h/s/t/5"]
    found = spark.createDataFrame([(u,) for u in urls], "url string")
    sizes = dict(zip(urls, [60, 60, 200, 30, 40, 30], strict=True))

    def fetched(some):
        return pages(spark, *[(u, 200, words(f"w{u[-5:].replace('/', '')}x", sizes[u])) for u in some])

    def rows():
        return {r["url"]: (r["status"], r["stage"], r["chunks_count"], r["embeddings_count"]) for r in run.status().collect()}

    n = corpus_build.build(run, found, fetched(urls[:5]), hashing_embedder(8), "test", 8, merged=True)
    now = rows()
    assert n == vectors.read_vectors(spark, run.path("index")).count()
    both = now[urls[0]][2]
    assert both and now[urls[0]] == now[urls[1]] == ("completed", "uploaded", both, both)
    own = now[urls[2]][2]
    assert now[urls[2]] == ("completed", "uploaded", own, own) and own > 1
    # 4 and the lone document of the other section are remainders: merged with nothing, but kept.
    assert now[urls[3]][:2] == now[urls[4]][:2] == ("completed", "uploaded")
    per_source = {r["source"]: r["embeddings_count"] for r in vectors.vectors_per_document(vectors.read_vectors(spark, run.path("index"))).collect()}
    assert per_source == {"/s/t": both + now[urls[3]][2], urls[2]: own, "/u/v": now[urls[4]][2]}
    # A new document of a section joins its remainder; the section's old vectors go.
    corpus_build.build(run, found, fetched(urls[5:]), hashing_embedder(8), "test", 8, merged=True, replace_sources=True)
    now = rows()
    assert now[urls[5]][:2] == ("completed", "uploaded")
    again = {r["source"]: r["embeddings_count"] for r in vectors.vectors_per_document(vectors.read_vectors(spark, run.path("index"))).collect()}
    assert again == {**per_source, "/s/t": both + now[urls[5]][2]}
    assert tables.read_latest(spark, run.path("lineage"), schemas.LINEAGE, "url").filter("source = '/s/t'").count() == 4


def test_documents_that_merging_leaves_out_fail(spark, tmp_path):
    run = corpus_build.Run(spark, str(tmp_path), T1)
    urls = ["http://h/s/t/1", "http://h/s/t/2"]
    found = spark.createDataFrame([(u,) for u in urls], "url string")
    fetched = pages(spark, (urls[0], 200, words("a", 20)), (urls[1], 200, words("b", 200)))
    corpus_build.build(run, found, fetched, hashing_embedder(8), "test", 8, merged=True)
    rows = {r["url"]: (r["status"], r["stage"], r["error"]) for r in run.status().collect()}
    assert rows == {urls[0]: ("failed", "chunking", corpus_build.LEFT_OUT), urls[1]: ("completed", "uploaded", None)}


def test_page_metadata_stays_with_the_documents(spark, tmp_path):
    html = "<p>" + words("a", 20) + "</p>"
    rows = [
        ("http://h/a", 200, html, "Tue, 02 Jan 2024 03:04:05 GMT", "e1", "text/html", "12"),
        ("http://h/b", 200, html, "yesterday", None, None, "many"),
        ("http://h/c", 200, html, "2024-01-05 00:00:00", "e3", "text/html", None),
    ]
    ddl = "url string, status int, html string, last_modified string, etag string, content_type string, content_length string"
    found = spark.createDataFrame([(u,) for u in ("http://h/a", "http://h/b", "http://h/c", "http://h/d.pdf")], "url string")
    run = corpus_build.Run(spark, str(tmp_path), T1)
    texts = spark.createDataFrame([("http://h/d.pdf", 1, "text of a page")], "url string, page int, text string")
    corpus_build.scrape(run, found, spark.createDataFrame(rows, ddl), texts)
    got = {r["url"]: r["metadata"] for r in corpus_build.documents(run).collect()}
    assert [str(got[u]["last_modified"]) for u in sorted(got)] == ["2024-01-02 03:04:05", T1, "2024-01-05 00:00:00", T1]
    assert [(got[u]["etag"], got[u]["content_length"]) for u in sorted(got)] == [("e1", 12), (None, None), ("e3", None), (None, None)]
    assert {str(m["scraped_at"]) for m in got.values()} == {T1} and all(m["url"] == u for u, m in got.items())
    corpus_build.chunk_stage(run, found)
    chunks = run.results("chunks", corpus_build._CHUNK, "source").collect()
    assert {r["source"]: str(r["last_modified"]) for r in chunks}["http://h/a"] == "2024-01-02 03:04:05"


def test_rows_of_replaced_sources_go_before_ids_are_looked_up(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "index")

    def write(run, *rows, **options):
        made = vector_rows(spark, *rows).withColumns({"id": F.col("metadata.text"), "values": F.array(F.lit(run).cast("float"))})
        vectors.append_vectors(made, path, run, **options)

    def read():
        kept = {}

        def storing(df, label="stored"):
            kept[label] = tables.stored(df, label)
            return kept[label]

        monkeypatch.setattr(vectors, "stored", storing)
        rows = sorted((r["metadata"]["source"] or "", r["id"], r["values"][0]) for r in vectors.read_vectors(spark, path).collect())
        monkeypatch.undo()
        return rows, kept["rewritten"].count()

    write(1, ("a", "1"), ("a", "2"), ("b", "3"), (None, "4"))
    write(2, ("a", "1"), ("a", "2"), replace_sources=True)
    assert read() == ([("", "4", 1.0), ("a", "1", 2.0), ("a", "2", 2.0), ("b", "3", 1.0)], 0)
    # An id that has moved to another source: its newest run counts, even where that is gone.
    write(3, ("c", "3"))
    write(4, ("c", "5"), (None, "4"), replace_sources=True)
    assert read() == ([("", "4", 4.0), ("a", "1", 2.0), ("a", "2", 2.0), ("c", "5", 4.0)], 2)


def test_a_replacing_batch_stores_keys_of_what_changed(spark, tmp_path, monkeypatch):
    kept = {}

    def storing(df, label="stored"):
        kept[label] = df.columns
        return tables.stored(df, label)

    monkeypatch.setattr(ingest, "stored", storing)
    rows = docs(spark, ("a", words("a"), T1), ("b", "short", T1))
    ingest.ingest_batch(rows, str(tmp_path / "r"), 0, hashing_embedder(8), "test", T2, replace_sources=True)
    assert kept["changed"] == ["url", "last_modified"]

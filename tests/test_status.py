from pyspark.sql import functions as F

from lodestone import schemas, session
from lodestone.operators import repair
from lodestone.operators import status as st

RUN_TS = "2024-06-01 00:00:00"
OLD = "2024-01-01 00:00:00"


def table(spark, rows):
    """Status rows given as (url, status, stage, error, chunks, embeddings, time)."""
    text = schemas.STATUS.replace("timestamp_ntz", "string")
    return schemas.conform(spark.createDataFrame(rows, text), schemas.STATUS)


def urls(spark, *names):
    return spark.createDataFrame([(n,) for n in names], "url string")


def shown(df):
    return {r["url"]: tuple(str(v) if k == "last_updated" and v else v for k, v in r.asDict().items() if k != "url") for r in df.collect()}


def results(spark, rows):
    return spark.createDataFrame(rows, "url string, n bigint, error string")


def test_gates_with_missing_rows_and_fields(spark):
    status = table(spark, [
        ("a", "completed", "scraped", None, None, None, None), ("b", None, None, None, None, None, None),
        ("c", "completed", "uploaded", None, None, None, None), ("d", "failed", "uploaded", None, None, None, None),
    ])
    due = {s: sorted(r["url"] for r in st.stage_gate(urls(spark, "a", "b", "c", "d", "new", "new"), status, s).collect()) for s in st.READY}
    assert due == {"scrape": ["b", "d", "new"], "chunk": ["a"], "embed": [], "upload": [], "pdf": ["a", "b", "d", "new"]}


def test_scraping_replaces_the_row(spark):
    status = table(spark, [("a", "failed", "chunking", "old", 3, 4, OLD), ("c", "completed", "chunked", "kept", 1, None, OLD)])
    out = shown(st.mark_scraped(status, urls(spark, "a", "b", "c", "d"), urls(spark, "a", "b", "c")))
    assert out == {
        "a": ("completed", "scraped", None, None, None, None), "b": ("completed", "scraped", None, None, None, None),
        "c": ("completed", "chunked", "kept", 1, None, OLD),
    }
    errors = spark.createDataFrame([("d", "bad page")], "url string, error string")
    failed = st.scrape_failures(status, urls(spark, "a", "b", "d", "e"), urls(spark, "a", "b"), errors)
    assert sorted(map(tuple, failed.collect())) == [("d", "bad page", "scraping"), ("e", "no content returned", "scraping")]


def test_chunking(spark):
    status = table(spark, [
        ("ok", "completed", "scraped", "old error", None, None, None), ("bad", "completed", "scraped", None, 7, None, None),
        ("none", "completed", "scraped", None, None, None, None), ("short", "completed", "scraped", None, None, None, None),
        ("later", "completed", "embedded", None, 1, 1, OLD), ("other", "completed", "scraped", None, None, None, None),
    ])
    found = urls(spark, "ok", "bad", "none", "short", "later", "new")
    outcome = results(spark, [("ok", 5, None), ("bad", None, "broken"), ("short", None, None), ("later", 9, None)])
    changed, failed = st.mark_chunked(status, found, outcome, RUN_TS)
    assert shown(changed) == {
        "ok": ("completed", "chunked", "old error", 5, None, RUN_TS),
        "bad": ("failed", "chunking", "broken", 7, None, RUN_TS),
        "none": ("failed", "chunking", "no text to chunk", None, None, RUN_TS),
        "short": ("completed", "chunked", None, 0, None, RUN_TS),
        "later": ("completed", "embedded", None, 1, 1, OLD),
        "new": ("pending", "discovered", None, None, None, None),
        "other": ("completed", "scraped", None, None, None, None),
    }
    assert sorted((r["url"], r["error"], r["stage"], str(r["timestamp"])) for r in failed.collect()) == [
        ("bad", "broken", "chunking", RUN_TS), ("none", "no text to chunk", "chunking", RUN_TS),
    ]
    again, none = st.mark_chunked(changed, found, outcome, "2030-01-01 00:00:00")
    assert shown(again) == shown(changed) and none.count() == 0


def test_embedding_and_upload(spark):
    status = table(spark, [("a", "completed", "chunked", None, 2, None, OLD), ("b", "completed", "chunked", None, 2, None, OLD), ("c", "completed", "chunked", None, 2, None, OLD)])
    found = urls(spark, "a", "b", "c", "untracked")
    embedded, failed = st.mark_embedded(status, found, results(spark, [("a", 2, None), ("b", 2, "no service")]), RUN_TS)
    assert shown(embedded) == {
        "a": ("completed", "embedded", None, 2, 2, RUN_TS), "b": ("failed", "embedding", "no service", 2, None, RUN_TS),
        "c": ("failed", "embedding", "nothing to embed", 2, None, RUN_TS),
    }
    assert failed.count() == 2
    uploaded, none = st.mark_uploaded(embedded, found, results(spark, [("a", 2, None)]))
    assert shown(uploaded)["a"] == ("completed", "uploaded", None, 2, 2, RUN_TS) and none.count() == 0
    kept, logged = st.mark_uploaded(embedded, found, results(spark, [("a", 0, "No embeddings found")]))
    assert shown(kept) == shown(embedded)
    assert list(map(tuple, logged.collect())) == [("a", "No embeddings found", "uploading", None)]
    waiting, none = st.mark_uploaded(embedded, found, results(spark, []))
    assert shown(waiting) == shown(embedded) and none.count() == 0


def test_pdf_run_stops_where_it_got_to(spark):
    status = table(spark, [("done", "completed", "uploaded", None, 1, 1, OLD), ("again", "failed", "chunked", "old", 4, None, OLD)])
    rows = [("done", "uploaded", 9, 9, None), ("again", "uploaded", 5, 5, None), ("blank", None, None, None, "no text in the file"), ("half", "chunked", 3, None, "no service")]
    outcome = spark.createDataFrame(rows, "url string, reached string, chunks bigint, vectors bigint, error string")
    out = shown(st.mark_pdf_run(status, urls(spark, "done", "again", "blank", "half"), outcome, RUN_TS))
    assert out == {
        "done": ("completed", "uploaded", None, 1, 1, OLD), "again": ("completed", "uploaded", "old", 5, 5, RUN_TS),
        "blank": ("failed", "discovered", "no text in the file", None, None, RUN_TS),
        "half": ("failed", "chunked", "no service", 3, None, RUN_TS),
    }


def test_reset(spark):
    status = table(spark, [("a", "completed", "chunked", "kept", 1, 8, OLD), ("b", "failed", "discovered", "gone", None, 3, OLD), ("c", None, None, None, None, None, None)])
    once = st.reset_to_chunked(status)
    assert shown(once) == {
        "a": ("completed", "chunked", "kept", 1, 8, OLD), "b": ("completed", "chunked", None, None, None, OLD),
        "c": ("completed", "chunked", None, None, None, None),
    }
    assert shown(st.reset_to_chunked(once)) == shown(once)
    assert st.reset_failures(spark).columns == ["url", "error", "stage", "timestamp"]


def test_report(spark):
    status = table(spark, [("a", "completed", "embedded", None, None, None, OLD), ("b", "completed", None, None, None, None, "2024-01-01 00:30:00"), ("c", "completed", "x", None, None, None, None), ("d", None, "x", None, None, None, "2025-01-01 00:00:00")])
    assert dict(st.stage_counts(status).collect()) == {"embedded": 1, "unknown": 1, "x": 2}
    assert dict(st.status_counts(status).collect()) == {"completed": 3, "unknown": 1}
    rate = st.processing_rate(status).first()
    assert (rate["completed"], rate["urls_per_hour"]) == (2, 4.0)
    assert list(st.first_and_last_update(status).first()) == ["a", "b"]
    assert st.processing_rate(status.filter("url = 'a'")).first()["urls_per_hour"] is None
    assert st.processing_rate(status.limit(0)).first()["urls_per_hour"] is None
    assert list(st.totals(urls(spark, "a", "b"), status, status.limit(1)).first()) == [2, 4, 1, 1]


def test_recent_failures_order(spark):
    rows = [("a", None, 1), ("b", OLD, 4), ("c", OLD, 2), ("d", RUN_TS, 9), ("e", None, 0)]
    log = spark.createDataFrame(rows, "url string, t string, write_seq bigint").withColumn("timestamp", F.col("t").cast("timestamp_ntz"))
    assert [r["url"] for r in st.recent_failures(log, 4).collect()] == ["d", "c", "b", "e"]
    plan = st.recent_failures(log)._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in plan


def test_repair(spark):
    rows = [(2, 0, "x", "s", 1.0), (1, 5, "x", "s", 2.0), (1, 3, "x", "s", 3.0), (1, 0, "y", "s", 4.0), (2, 1, "z", "lost", 5.0), (2, 2, "w", None, 6.0)]
    df = spark.createDataFrame(rows, "checkpoint_no bigint, pos bigint, id string, source string, v float").select(
        "checkpoint_no", "pos", "id", F.array("v").alias("values"), F.struct("source").alias("metadata")
    )
    first = repair.dedup_first(df)
    assert sorted((r["source"], r["id"], r["values"][0]) for r in first.collect()) == [("lost", "z", 5.0), ("s", "x", 3.0), ("s", "y", 4.0)]
    assert sorted(r["id"] for r in repair.latest_checkpoint(df).collect()) == ["w", "x", "z"]
    status = table(spark, [("s", "failed", "embedding", "old", 2, None, OLD), ("t", "completed", "chunked", "kept", 1, None, OLD)])
    assert [r["source"] for r in repair.unknown_sources(first, status).collect()] == ["lost"]
    assert shown(repair.merge_checkpoints(status, first)) == {
        "s": ("completed", "embedded", None, 2, 2, OLD), "t": ("completed", "chunked", "kept", 1, None, OLD),
    }
    errors = spark.createDataFrame([("s", "disk full")], "url string, error string")
    assert shown(repair.merge_checkpoints(status, first, errors))["s"] == ("failed", "embedding", "disk full", 2, None, OLD)


def test_gates_sort_no_more_than_a_share_in_one_task(spark, monkeypatch):
    monkeypatch.setattr(session, "BROADCAST_SIDE_BYTES", 0)
    monkeypatch.setattr(session, "estimated_bytes", lambda df: session.PAIRED_BYTES * 3)
    status = table(spark, [(f"u{i}", "completed" if i % 2 else None, "scraped", None, None, None, None) for i in range(40)])
    status = status.unionByName(table(spark, [("u0", "failed", "scraped", None, None, None, None), (None, "failed", "scraped", None, None, None, None)]))
    found = urls(spark, *[f"u{i}" for i in range(50)], "u3", None)
    for stage, want in (("chunk", [f"u{i}" for i in range(40)] + ["u0"]), ("scrape", [f"u{i}" for i in (*range(0, 40, 2), 0, *range(40, 50))] + [None])):
        due = st.stage_gate(found, status, stage)
        assert sorted(map(str, (r["url"] for r in due.collect()))) == sorted(map(str, want))
        assert "REPARTITION_BY_NUM" in due._jdf.queryExecution().executedPlan().toString()

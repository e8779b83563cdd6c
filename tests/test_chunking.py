import math

import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lodestone.functions.splitting import SEPARATORS, split_text
from lodestone.operators import chunking
from lodestone.session import spread

RUN_TS = "2024-06-01 00:00:00"


def plain_split(text, size, overlap, separators=SEPARATORS):
    """The rule word for word, on lists of strings."""
    chosen, later = separators[-1], []
    for i, separator in enumerate(separators):
        if separator in text:
            chosen, later = separator, list(separators[i + 1 :])
            break
    if chosen == "":
        pieces = list(text)
    else:
        head, *tail = text.split(chosen)
        pieces = [p for p in [head, *(chosen + t for t in tail)] if p]
    out, short = [], []
    for piece in [*pieces, None]:
        if piece is not None and len(piece) < size:
            short.append(piece)
            continue
        out += plain_merge(short, size, overlap)
        short = []
        if piece is not None:
            out += plain_split(piece, size, overlap, later) if later else [piece]
    return out


def plain_merge(pieces, size, overlap):
    out, window = [], []
    for piece in pieces:
        total = sum(map(len, window))
        if total + len(piece) > size and window:
            out.append("".join(window).strip())
            while total > overlap or (total + len(piece) > size and total > 0):
                total -= len(window.pop(0))
        window.append(piece)
    out.append("".join(window).strip())
    return [c for c in out if c]


@settings(max_examples=400, deadline=None)
@given(
    st.text(alphabet=st.sampled_from("ab\n.!?, é\xa0"), max_size=300),
    st.integers(2, 40),
    st.integers(0, 40),
)
def test_split_equals_the_plain_rule(text, size, overlap):
    overlap = min(overlap, size)
    assert split_text(text, size, overlap) == plain_split(text, size, overlap)


@settings(max_examples=200, deadline=None)
@given(st.integers(0, 6000))
def test_text_without_separators(length):
    text = "".join(chr(97 + i % 26) for i in range(length))
    n = 0 if not length else 1 if length <= 500 else 1 + math.ceil((length - 500) / 450)
    assert split_text(text) == [text[450 * i : 450 * i + 500] for i in range(n)]


def test_blank_line_is_the_strongest_separator():
    text = "a b.\n\nc d, e\n\nf"
    assert split_text(text, 8, 0) == ["a b.", "c d, e", "f"]


def test_documents_equal_the_plain_rule(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select(
        F.col("doc_id").cast("string").alias("url"), "text"
    )
    got = {}
    for row in chunking.chunk(docs, RUN_TS).orderBy("source", "chunk_index").collect():
        got.setdefault(row["source"], []).append(row["text"])
    want = {r["url"]: plain_split(r["text"], 500, 50) for r in docs.collect() if len(r["text"]) >= 50}
    assert got == want
    assert sum(map(len, got.values())) == 1483


def test_length_limit_and_defaults(spark):
    rows = [
        (None, "x" * 50, None, None, None), ("u", "x" * 49, "pdf", 1, None), ("v", None, "pdf", 1, None),
        ("", "y" * 50, "", 2, ""), ("w", "z" * 50, "pdf", 3, "2024-01-02 03:04:05"),
    ]
    docs = spark.createDataFrame(rows, "url string, text string, type string, depth int, last_modified string")
    got = {r["source"]: r for r in chunking.chunk(docs, RUN_TS).collect()}
    assert set(got) == {"unknown", "", "w"}
    assert (got["unknown"]["type"], got["unknown"]["depth"]) == ("html", 0)
    assert (got[""]["type"], got[""]["depth"]) == ("", 2)
    assert str(got["unknown"]["last_modified"]) == str(got[""]["last_modified"]) == RUN_TS
    assert str(got["w"]["last_modified"]) == "2024-01-02 03:04:05"


def test_ids_are_stable_and_tell_pages_apart(spark):
    docs = spark.createDataFrame([("p", "same text " * 6, n) for n in (1, 2)], "url string, text string, page int")
    first, again = (
        {r["chunk_id"] for r in chunking.chunk(df, RUN_TS).collect()} for df in (docs, docs.repartition(5))
    )
    assert first == again and len(first) == 2


def test_failed_documents_are_rows_of_their_own(spark):
    split = spark.createDataFrame(
        [("a", ["x", "y"], None), ("b", None, "bad"), ("c", [], None)],
        "source string, chunks array<string>, error string",
    ).withColumns({"type": F.lit("html"), "depth": F.lit(0), "last_modified": F.lit(RUN_TS).cast("timestamp_ntz")})
    results = chunking.chunk_results(split).orderBy("source", "chunk_index").collect()
    assert [(r["source"], r["text"], r["error"]) for r in results] == [
        ("a", "x", None), ("a", "y", None), ("b", None, "bad"),
    ]
    assert chunking.chunk_rows(split).count() == 2
    assert [(r["url"], r["error"], r["stage"]) for r in chunking.chunk_failures(split, RUN_TS).collect()] == [
        ("b", "bad", "chunking")
    ]


def test_large_document_flag(spark):
    chunks = spark.createDataFrame([("a",)] * 100 + [("b",)] * 101, "source string")
    got = {r["source"]: r["is_large"] for r in chunking.chunks_per_document(chunks).collect()}
    assert got == {"a": False, "b": True}


def test_splitting_comes_after_the_repartition(spark):
    docs = spread(spark.read.parquet("/root/testdata/sf0.001/documents.parquet"))
    plan = chunking.chunk(docs.withColumn("url", F.lit("u")), RUN_TS)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1
    assert plan.index("ArrowEvalPython") < plan.index("Repartition")


def test_chunks_leave_the_worker_in_slices(spark, monkeypatch):
    monkeypatch.setattr(chunking, "SLICE_BYTES", 100)
    texts = pa.array(["word " * 30, None, "a. b. " * 5, "", "é" * 300] * 3)
    split = chunking._splitter(50, 5, SEPARATORS).func
    parts = list(split(iter([texts, pa.array([], pa.string())])))
    assert max(len(p) for p in parts) <= 4 and sum(len(p) for p in parts) == len(texts)
    got = [row["chunks"] for p in parts for row in p.to_pylist()]
    assert got == [split_text(t or "", 50, 5) for t in texts.to_pylist()]

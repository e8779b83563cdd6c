import random
from collections import Counter
from itertools import groupby
from urllib.parse import urlparse

import pytest
from pyspark.sql import functions as F

from lodestone.operators import combine


def section(url):
    return "/".join(urlparse(url).path.split("/")[:3])


def check_rules(docs, rows, min_words, keep_pending):
    """What must hold of the merged rows (url, text, sources), whatever made them."""
    size = {d["url"]: len(d["text"].split()) for d in docs}
    ordered = {k: sorted(g) for k, g in groupby(sorted(size, key=lambda u: (section(u), u)), section)}
    large = {u for u, n in size.items() if n >= min_words}
    assert {r[0] for r in rows if r[2] is None} == large
    groups = [r for r in rows if r[2] is not None]
    members = Counter(u for r in groups for u in r[2])
    assert max(members.values(), default=1) == 1 and not large & set(members)
    for base, text, sources in groups:
        urls = ordered[base]
        start = urls.index(sources[0])
        # Neighbours in URL order, with no large document among them.
        assert urls[start : start + len(sources)] == list(sources)
        after = urls[start + len(sources) :][:1]
        full = len(text.split()) >= min_words
        # A group that is not full ended with its section or, if those are kept, at a large document.
        assert full or not after or (keep_pending and after[0] in large)
        # It would not have been full without its last member.
        last = f"From {sources[-1]}:"
        assert len(text[: text.rindex(last)].split()) < min_words
        assert [line for line in text.split("\n") if line.startswith("From http")] == [f"From {u}:" for u in sources]
    missing = set(size) - large - set(members)
    if keep_pending:
        assert not missing
    for url in missing:
        # Left out only where a large document follows before the group was full.
        urls = ordered[section(url)]
        rest = urls[urls.index(url) :]
        stop = next(i for i, u in enumerate(rest) if u in large)
        assert set(rest[:stop]) <= missing


def run(spark, docs, min_words, **options):
    df = spark.createDataFrame([(d["url"], d["text"], i) for i, d in enumerate(docs)], "url string, text string, n int")
    merged = combine.combine_small(df.withColumn("type", F.lit("html")), min_words, order_col="n", **options)
    rows = merged.select("url", "text", "sources").collect()
    return sorted(((r["url"], r["text"], r["sources"] and tuple(r["sources"])) for r in rows), key=repr)


def words(n):
    return " ".join(f"w{i}" for i in range(n))


def doc(url, n):
    return {"url": url, "text": words(n)}


@pytest.mark.parametrize("keep_pending", [False, True])
@pytest.mark.parametrize("seed", [1, 2, 3])
def test_random_sections(spark, seed, keep_pending):
    rng = random.Random(seed)
    min_words = rng.choice([12, 30, 100])
    docs = []
    for i in range(400):
        place = rng.choice(["", "/", "/a", "/a/b", "/hot/x", "/hot/x", "/hot/x"])
        host = rng.choice(["https://h.example", "https://g.example"])
        size = rng.choice([0, 1, 3, 5, min_words - 1, min_words, 2 * min_words]) if rng.random() < 0.3 else rng.randint(0, 6)
        docs.append(doc(f"{host}{place}/{i:04d}" if "/" in place[1:] else f"{host}{place}?n={i:04d}", size))
    check_rules(docs, run(spark, docs, min_words, keep_pending=keep_pending), min_words, keep_pending)


def test_one_section_over_many_partitions(spark):
    """A section that holds every document, small ones only, still gathers in order."""
    docs = [doc(f"https://h.example/a/b/{i:05d}", i % 7) for i in range(3000)]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        df = spark.createDataFrame([(d["url"], d["text"]) for d in docs], "url string, text string")
        ordered = combine._in_url_order(df.withColumn("last_modified", F.lit(None).cast("timestamp_ntz")), 100, None)
        assert ordered.select("block").distinct().count() == 8
        check_rules(docs, run(spark, docs, 100), 100, False)
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")


def test_boundaries(spark):
    # Heading words count: 4 for the start and 2 per document.
    exactly = [doc("https://h.example/a/b/1", 4), doc("https://h.example/a/b/2", 8)]
    assert len(run(spark, exactly, 20)) == 1
    closing_early = [doc("https://h.example/a/b/1", 14), doc("https://h.example/a/b/2", 1)]
    assert [r[2] for r in run(spark, closing_early, 20)] == [
        ("https://h.example/a/b/1",), ("https://h.example/a/b/2",),
    ]


def test_large_document_discards_what_was_pending(spark):
    docs = [doc("https://h.example/a/b/1", 3), doc("https://h.example/a/b/2", 50), doc("https://h.example/a/b/3", 3)]
    assert [r[2] for r in run(spark, docs, 20)] == [("https://h.example/a/b/3",), None]
    assert len(run(spark, docs, 20, keep_pending=True)) == 3


def test_exact_copies_and_missing_text(spark):
    df = spark.createDataFrame(
        [("https://h.example/a/b/1", "same words")] * 40 + [("https://h.example/a/b/2", None)], "url string, text string"
    ).withColumn("type", F.lit("html"))
    merged = combine.combine_small(df, 30)
    assert merged.select(F.sum(F.size("sources"))).first()[0] == 41


def test_newest_time_of_the_members(spark):
    df = spark.createDataFrame(
        [("https://h.example/a/b/1", "x", "2024-01-02 00:00:00"), ("https://h.example/a/b/2", "y", "2024-01-03 00:00:00")],
        "url string, text string, t string",
    ).select("url", "text", F.lit("html").alias("type"), F.col("t").cast("timestamp_ntz").alias("last_modified"))
    row = combine.combine_small(df).first()
    assert str(row["last_modified"]) == "2024-01-03 00:00:00"
    assert (row["url"], row["base_path"], row["type"], row["combined"]) == ("/a/b", "/a/b", "combined", True)

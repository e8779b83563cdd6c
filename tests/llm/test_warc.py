import base64
import glob
import gzip
import hashlib
import random

from pyspark.sql import functions as F

from lodestone.llm import warc
from lodestone.session import scratch_path

SCHEMA = "page_id long, url string, html string, key string, payload string, place int"


def frame(spark, rows):
    return spark.createDataFrame([(i, u, h, "k", "p", 1) for i, u, h in rows], SCHEMA)


def digest(html):
    return base64.b32encode(hashlib.sha1((html or "").encode()).digest()).decode()


def write(spark, rows, **how):
    path = scratch_path(spark, "warc-test")
    warc.write_archives(frame(spark, rows).repartition(3), path, **how)
    return path


ROWS = [
    (1, "http://a.example/1", "<p>same</p>"), (2, "http://a.example/2", "<p>same</p>"), (3, None, "<p>é ☃</p>"),
    (4, "http://b.example/", None), (5, "http://b.example/5", ""), (6, "x\r\ny", "<p>same</p>"),
    (7, "u", "two"), (7, "u", "two"), (None, "u", "<p>same</p>"), (None, "v", "nobody's"), (None, "w", "nobody's"),
]


def test_round_trip(spark):
    path = write(spark, ROWS)
    records = warc.read_archives(spark, path)
    found = sorted(map(tuple, warc.page_records(records).collect()), key=str)
    n = len("<p>é ☃</p>".encode())
    wanted = [
        (1, 11, digest("<p>same</p>"), "revisit", 6), (2, 11, digest("<p>same</p>"), "revisit", 6),
        (3, n, digest("<p>é ☃</p>"), "response", None), (4, 0, digest(""), "revisit", 5),
        (5, 0, digest(""), "response", None), (6, 11, digest("<p>same</p>"), "response", None),
        (7, 3, digest("two"), "response", None), (7, 3, digest("two"), "revisit", 7),
        (None, 11, digest("<p>same</p>"), "revisit", 6),
        (None, 8, digest("nobody's"), "response", None), (None, 8, digest("nobody's"), "response", None),
    ]
    assert found == sorted(wanted, key=str)
    bodies = {r["headers"].get("page-id"): r["payload"] for r in records.collect() if r["warc_type"] == "response"}
    assert bytes(bodies["3"]) == "<p>é ☃</p>".encode() and bytes(bodies["6"]) == b"<p>same</p>"
    ids = {r["headers"]["warc-record-id"] for r in records.collect()}
    assert {r["headers"]["warc-refers-to"] for r in records.collect() if r["warc_type"] == "revisit"} <= ids


def test_payloads_under_the_least_length_are_never_revisits(spark):
    found = warc.page_records(warc.read_archives(spark, write(spark, ROWS, least=4))).collect()
    assert {r["record_type"] for r in found if r["payload_bytes"] < 4} == {"response"}
    assert sum(r["record_type"] == "revisit" for r in found) == 3


def test_archives_are_plain_gzip_files(spark):
    path = write(spark, ROWS).removeprefix("file:")
    whole = b"".join(gzip.decompress(open(f, "rb").read()) for f in glob.glob(f"{path}/part-*"))
    assert whole.count(b"WARC/1.1\r\n") >= len(ROWS) + 1
    assert len([r for r in warc.parse_records(whole) if r[0] != "warcinfo"]) == len(ROWS)


def test_small_ranges_give_each_record_once(spark):
    draw = random.Random(1)
    rows = [(i, "u", "".join(draw.choices("abcdef<>", k=draw.randint(0, 3000)))) for i in range(60)]
    path = write(spark, rows)
    for size in (97, 1000, 50_000):
        found = warc.page_records(warc.read_archives(spark, path, range_bytes=size)).collect()
        assert sorted((r["page_id"], r["payload_digest"]) for r in found) == [(i, digest(h)) for i, _, h in rows]


def test_a_payload_of_many_megabytes(spark):
    html = "ab" * (9 * 2**20)
    found = warc.page_records(warc.read_archives(spark, write(spark, [(1, "u", html), (2, "u", "x")]))).collect()
    assert sorted((r["page_id"], r["payload_bytes"], r["payload_digest"]) for r in found) == [
        (1, len(html), digest(html)), (2, 1, digest("x")),
    ]


def scan_all(data, size):
    return [
        r for a in range(0, len(data), size)
        for r in warc.scan(lambda at, n: data[at : at + n], a, min(len(data), a + size), len(data))
    ]


def test_false_magic_broken_members_and_foreign_members(spark):
    record = b"WARC/1.0\r\nWARC-Type: metadata\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n"
    noise = gzip.compress(record, 0).replace(b"abc", b"ab\x1f")  # its checksum fails
    stored = gzip.compress(b"WARC/1.0\r\nContent-Length: 9\r\n\r\n\x1f\x8b\x08\0\0\0\0\0\0\r\n\r\n", 0)
    data = b"junk\x1f\x8b\x08" + gzip.compress(record) + b"\0\0" + noise + gzip.compress(b"no record") + stored + gzip.compress(record * 2)[:-4]
    data += gzip.compress(record * 2)
    for size in (5, 64, 10_000):
        members = scan_all(data, size)
        assert [len(list(warc.parse_records(m))) for _, m in members] == [1, 1, 2]


def test_no_rows(spark):
    assert warc.read_archives(spark, write(spark, [])).count() == 0


def test_each_range_has_a_task_of_its_own(spark):
    path = write(spark, [(i, "u", f"{random.Random(i).random()}" * 500) for i in range(300)])
    sizes = [r["length"] for r in spark.read.format("binaryFile").load(path).select("length").collect()]
    before = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "true")
    try:
        records = warc.read_archives(spark, path, range_bytes=4_000)
        tasks = records.rdd.getNumPartitions()
        used = records.select(F.spark_partition_id().alias("task"), "file", (F.col("start") / 4_000).cast("long").alias("range"))
        per_task = used.distinct().groupBy("task").count()
        assert tasks == sum(-(-n // 4_000) for n in sizes) > 8
        assert per_task.agg(F.max("count")).first()[0] == 1
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", before)
    assert records.filter("warc_type = 'response'").count() == 300


def test_a_long_member_is_read_once():
    body = random.Random(3).randbytes(12 * 2**20)
    record = b"WARC/1.0\r\nContent-Length: %d\r\n\r\n" % len(body) + body + b"\r\n\r\n"
    data, got = gzip.compress(record, 1) * 2, []

    def read(at, n):
        got.append(n)
        return data[at : at + n]

    assert [len(m) for _, m in warc.scan(read, 0, len(data), len(data))] == [len(record)] * 2
    assert sum(got) < 1.5 * len(data) and max(got) <= 4 * 2**20

"""Column expressions against Python's own functions."""

from datetime import datetime
from urllib.parse import urlparse

from pyspark.sql import functions as F

from lodestone.functions import http, text, times, urls

URLS = [
    "https://a.example/x/y/z", "https://a.example", "https://a.example/", "http://u:p@A.example:8080/P?q=1#f",
    "//host/only", "/rooted/path/here", "relative/path", "", "mailto:someone@x.example", "https://a.example?x=/1/2",
    "https://a.example#f/1", "https://a.example/a;b/c;d", "https://a.example/a/b;c", "1http://x/y", "https://a.example//b//c",
    " https://lead.example/a", "ht\ntps://broken.example/a\tb/c", "ftp://f.example/a;type=i", "x-y:z;p", "https://a.example/café/ü b",
]


def test_url_parts_equal_urllib(spark):
    rows = spark.createDataFrame([(u,) for u in URLS], "url string").select(
        "url", urls.url_domain("url").alias("domain"), urls.base_path("url").alias("base")
    ).collect()
    for row in rows:
        parsed = urlparse(row["url"])
        assert row["domain"] == parsed.netloc, row["url"]
        assert row["base"] == "/".join(parsed.path.split("/")[:3]), row["url"]


def test_missing_url(spark):
    row = spark.createDataFrame([(None,)], "url string").select(
        urls.url_domain("url"), urls.base_path("url"), urls.is_pdf_url("url"), urls.classify_document("url")
    ).first()
    assert list(row) == ["", "", False, "html"]


def test_pdf_patterns(spark):
    cases = {
        "https://a/x.PDF": True, "https://a/pdf/x": True, "https://a/x?t=application/pdf": True,
        "https://a/pdfs": False, "https://a/Archive/View/1": False,
    }
    rows = spark.createDataFrame(list(cases.items()), "url string, want boolean")
    assert rows.filter(urls.is_pdf_url("url") != F.col("want")).count() == 0
    more = rows.select(urls.is_pdf_url("url", ("/archive/view/",)).alias("x"))
    assert more.filter("x").count() == 1


def test_same_domain_is_exact(spark):
    row = spark.range(1).select(
        urls.same_domain(F.lit("https://a.example/x"), "a.example"),
        urls.same_domain(F.lit("https://www.a.example/x"), "a.example"),
        urls.same_domain(F.lit("https://a.example:80/x"), "a.example"),
    ).first()
    assert list(row) == [True, False, False]


TEXTS = [
    "", " ", "a", " a  b\t\nc ", "x\x1cy\x1dz\x1e\x1f", "n\x85o\xa0p", " q r s t u v　",
    "zero​width", "᠎mongol", "tab\x0bvt\x0cff", "café naïve",
]


def test_words_and_strip_follow_python(spark):
    rows = spark.createDataFrame([(t,) for t in TEXTS], "t string").select(
        "t", text.word_count("t").alias("n"), text.strip("t").alias("s")
    ).collect()
    for row in rows:
        assert row["n"] == len(row["t"].split()), repr(row["t"])
        assert row["s"] == row["t"].strip(), repr(row["t"])
    assert spark.range(1).select(text.word_count(F.lit(None).cast("string"))).first()[0] == 0


def test_http_dates(spark):
    run = "2024-06-01 00:00:00"
    cases = [
        ("Tue, 02 Jan 2024 03:04:05 GMT", datetime(2024, 1, 2, 3, 4, 5)),
        ("Thu, 29 Feb 2024 23:59:59 UTC", datetime(2024, 2, 29, 23, 59, 59)),
        ("Fri, 30 Feb 2024 00:00:00 GMT", datetime(2024, 6, 1)),
        ("Tue, 02 Anf 2024 03:04:05 GMT", datetime(2024, 6, 1)),
        ("2024-01-02", datetime(2024, 6, 1)),
        (None, datetime(2024, 6, 1)),
    ]
    rows = spark.createDataFrame([(h, str(i)) for i, (h, _) in enumerate(cases)], "h string, n string")
    meta = http.http_metadata("n", "h", F.lit("e"), F.lit("text/html"), "h", run)
    got = rows.select(F.col("n").cast("int").alias("n"), meta.alias("m")).orderBy("n").collect()
    assert [r["m"]["last_modified"] for r in got] == [want for _, want in cases]
    assert {r["m"]["content_length"] for r in got} == {None}
    assert {r["m"]["scraped_at"] for r in got} == {datetime(2024, 6, 1)}


def test_times_do_not_depend_on_the_session_zone(spark):
    before = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        # 02:30 does not exist on this day in that zone.
        row = spark.range(1).select(
            times.parse_http_date(F.lit("Sun, 10 Mar 2024 02:30:00 GMT")).alias("p"),
            times.as_ntz(datetime(2024, 3, 10, 2, 30)).alias("q"),
        ).first()
        assert row["p"] == row["q"] == datetime(2024, 3, 10, 2, 30)
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)


def test_response_kinds(spark):
    rows = spark.createDataFrame(
        [("text/html; charset=utf-8",), ("TEXT/HTML",), ("Application/PDF; x",), (None,)], "c string"
    ).select(http.is_html_response("c"), http.is_pdf_response("c"), http.pdf_response_error("c")).collect()
    assert [tuple(r) for r in rows] == [
        (True, False, "Not a PDF (content-type: text/html; charset=utf-8)"),
        (False, False, "Not a PDF (content-type: text/html)"),
        (False, True, None),
        (False, False, "Not a PDF (content-type: )"),
    ]

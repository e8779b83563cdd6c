import pytest
from pyspark.sql import functions as F

from lodestone.functions.markup import PageReader, resolve_links
from lodestone.operators import pages

PAGES = {
    "whole page": (
        "<html><head><title> T &amp; U </title><style>x</style></head><body><!-- c --><p>a<b> b </b>"
        "<script>var s='</p>';</script><template>no<i>no</i></template> \n c&nbsp;</p></body>",
        "T & U", "T & U a b c",
    ),
    "heading before title": ("<title>t</title><h1> H <i>1</i>\n</h1><h1>2</h1>", "H 1", "t H 1 2"),
    "empty heading": ("<title>t</title><h1></h1>x", "", "t x"),
    "module content": (
        "<div id='contentarea'>no</div><div id='modulecontent'>yes <div>in</div></div><div id='modulecontent'>2</div>",
        "", "yes in",
    ),
    "content area": ("<p id='modulecontent'>p</p><div id='contentarea'>area<br>two</div>out", "", "area two"),
    "unclosed area": ("<div id='contentarea'>a<p>b", "", "a b"),
    "stray end tags": ("</div><div id='contentarea'>a</p></span>b<p>c</div>d", "", "a b c"),
    "end tag pops through": ("<div id='contentarea'><p><b>x</div>y", "", "x"),
    "void tags do not nest": ("<div id='contentarea'><img><input><hr>x</div>y", "", "x"),
    "closed at once": ("<div id='contentarea'/>x", "", ""),
    "entity inside a string": ("<p>a&lt;b &#65;&eacute;</p>", "", "a<b Aé"),
    "references without semicolon": ("<h1>a&amp&lt</h1>&ampb &bogus; &#150;&#x41 &#xD800;", "a&<", "a&< &ampb &bogus –A �"),
    "comment splits a string": ("<p>a<!-- x -->b</p>", "", "a b"),
    "character data": ("<![CDATA[kept]]>", "", None),
    "no text": ("<html><script>x</script></html>", "", ""),
    "blank inside a heading": ("<h1>a<i> \n </i>b</h1>", "a\nb", "a b"),
}


@pytest.mark.parametrize("name", PAGES)
def test_page_reader(name):
    html, title, body = PAGES[name]
    page = PageReader().read(html)
    assert page.title() == title
    if body is not None:
        assert page.body() == body


def test_page_table(spark):
    rows = [
        (f"https://h.example/{i}", html, title, body) for i, (html, title, body) in enumerate(PAGES.values())
        if body is not None
    ] + [("https://h.example/x.pdf", None, "", "")]
    df = spark.createDataFrame(rows, "url string, html string, title string, body string")
    got = pages.extract_page_text(df.select("url", "html")).join(df.select("url", "title", "body"), "url")
    for row in got.collect():
        head = f"Title: {row['title']}\n\n" if row["title"] else ""
        assert row["text"] == head + row["body"]
        assert row["type"] == ("pdf" if row["url"].endswith(".pdf") else "html")


def test_other_content_ids(spark):
    df = spark.createDataFrame([("u", "<div id='main'>m</div>x")], "url string, html string")
    assert pages.extract_page_text(df, ["main"]).first()["text"] == "m"


def test_links(spark):
    html = (
        "<a href='/a'>1</a><a href='b?x=1&amp;y=2'>2</a><a href='https://other.example/'>3</a><a name='n'>4</a>"
        "<a href=''>5</a><a href='//h.example/c'>6</a><a href='http://[bad'>7</a><a href='/a'>8</a><a href>9</a>"
    )
    df = spark.createDataFrame([("https://h.example/d/e", html)], "url string, html string")
    got = [r["dst"] for r in pages.extract_links(df).collect()]
    assert got == [
        "https://h.example/a", "https://h.example/d/b?x=1&y=2", "https://h.example/d/e",
        "https://h.example/c", "https://h.example/a", "https://h.example/d/e",
    ]
    assert pages.extract_links(df, within_site=False).count() == 7
    assert resolve_links("https://h.example/", ["http://[bad", "x"]) == ["https://h.example/x"]


def test_pages_of_a_document(spark):
    rows = [("p", n, f"{n};") for n in range(300, 0, -1)] + [("q", 2, None), ("q", 1, " a "), ("q", 3, " b ")]
    got = dict(pages.pages_to_document(spark.createDataFrame(rows, "path string, page int, text string")).collect())
    assert got == {"p": "".join(f"{n};" for n in range(1, 301)), "q": "a  b"}


def test_page_numbers_keep_gaps(spark):
    df = spark.createDataFrame([("p", ["a", "", None, "d"])], "path string, texts array<string>")
    numbered = pages.number_pages(df)
    assert [(r["page"], r["text"]) for r in pages.drop_empty_pages(numbered).collect()] == [(1, "a"), (4, "d")]
    docs = pages.pages_as_documents(numbered).collect()
    assert [(d["url"], d["type"], d["page"]) for d in docs] == [("p", "pdf", 1), ("p", "pdf", 4)]


def test_gates(spark):
    rows = [("a", 200, "text/html"), ("b", 200, None), ("c", 404, "text/html"), ("d", None, "text/html")]
    df = spark.createDataFrame(rows, "url string, status int, content_type string")
    assert [r["url"] for r in pages.ok_pages(df).collect()] == ["a", "b"]
    assert [r["url"] for r in pages.expandable_pages(df).collect()] == ["a", "c", "d"]


def test_parse_runs_once_per_page(spark):
    """The parse is neither repeated for the error filter nor moved below a repartition."""
    df = spark.createDataFrame([("u", "x")], "url string, html string").repartition(2)
    plan = pages.extract_page_text(df)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1
    assert plan.index("ArrowEvalPython") < plan.index("Repartition")
    assert pages.page_errors(pages.parse_pages(df)).filter(F.lit(True)).count() == 0

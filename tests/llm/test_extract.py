import time

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lodestone.llm import extract

SCHEMA = "page_id long, url string, html string, text string, n_chars string"


def page(body, title="t"):
    return (
        f"<!DOCTYPE html><html><head><title>{title}</title><style>p{{}}</style><script>var t='</p>'</script></head><body>"
        f"<nav><ul><li><a href='/'>home</a></li></ul></nav><div class='ad'>buy it now</div>"
        f"<article>{body}</article><div class='comments'><p>nice post</p></div><footer>&copy; me</footer></body></html>"
    )


def frame(spark, rows):
    return spark.createDataFrame([(i, f"u{i}", h, "?", "?") for i, h in rows], SCHEMA)


def labelled(n):
    return [(i, page(f"<h1>Title {i}</h1><p>Some words of text {'and more ' * (i % 7)}.<p>The end")) for i in range(n)]


@pytest.fixture(scope="module")
def weights(spark):
    return extract.learn_weights(frame(spark, labelled(60)))


CASES = [
    ("<h1>A  title</h1><p>One\n two &amp; three<p>Four <b>bold</b><i>er</i>", "A title\n\nOne two & three\n\nFour bolder"),
    ("<p>x<br>y</p><ul><li>one<li>two</ul>", "x y\n\none\n\ntwo"),
    ("<p>a</p><div class='advert box'>no</div><form><p>no</p></form><aside>no</aside><!-- <p>no</p> --><p>b", "a\n\nb"),
    ("<script>no</script><p>caf&eacute; &#8212; &lt;p&gt; &am</p>", "café — <p> &am"),
    ("<section><header><h1>Own</h1></header><p>text</p></section>", "Own\n\ntext"),
    ("<p>1 < 2 and 3 > 2 <a title='>' href=x>link</a></p>", "1 < 2 and 3 > 2 link"),
    ("<table><tr><td>a<td>b</table><pre>c\n  d</pre>", "a\n\nb\n\nc d"),
]


@pytest.mark.parametrize("body, text", CASES)
def test_articles(weights, body, text):
    assert extract.main_text(page(body), weights) == text


WRAPPERS = [
    "page has-sidebar", "layout no-sidebar", "content with-sidebar", "side-by-side", "comments-open", "nav-open",
    "main content menu-fixed", "navy", "sidebar", "widget post",
]


@pytest.mark.parametrize("name", WRAPPERS)
@pytest.mark.parametrize("attribute", ["class", "id"])
def test_labels_of_wrappers_leave_a_named_article_whole(weights, name, attribute):
    label = f'{attribute}="{name}"'
    body = "<h1>Title</h1><p>One two three.</p><div class=ad>no</div><p>Four five."
    whole = "Title\n\nOne two three.\n\nFour five."
    bare = f"<nav>home</nav><article>{body}</article><div class=comments>nice</div><footer>end</footer>"
    assert extract.main_text(f"<body><div {label}><p>before</p>{bare}</div></body>", weights) == whole
    for kind in ("article", "main"):
        assert extract.main_text(f"<body><{kind} {label}>{body}</{kind}><footer>end</footer>", weights) == whole
    nested = f"<main><div class='widget'><article {label}>{body}</article></div></main>"
    assert extract.main_text(f"<body><section {label}>{nested}</section>", weights) == whole


@pytest.mark.parametrize("name", [n for n in WRAPPERS if n not in ("sidebar", "widget post")])
def test_labels_inside_an_article_are_whole_names(weights, name):
    text = extract.main_text(page(f"<p>One two.</p><div class='{name}'><p>Three four.</p></div>"), weights)
    assert text == "One two.\n\nThree four."


@pytest.mark.parametrize("label", [
    'class="comment-list"', 'id="comments-section"', 'class="ad-slot"', 'class="side-bar cookie-banner"', 'id=ad_unit_3',
    'class="post relatedPosts"', "class='social-share-buttons'", 'class="widget-area"', 'class="newsletter__form"',
])
def test_own_names_of_several_parts_set_apart(weights, label):
    text = extract.main_text(page(f"<p>One two.</p><div {label}><p>Three four.</p></div><p>Five six.</p>"), weights)
    assert text == "One two.\n\nFive six."


def test_a_form_around_the_article_leaves_it_whole(weights):
    html = "<body><form id=all><nav>home</nav><article><p>One two.</p><form>no</form></article></form></body>"
    assert extract.main_text(html, weights) == "One two."


def test_what_is_apart_ends_with_its_element():
    html = "<div class=menu>a<div class='x comments'>b</div>c</div><div class=side>d<main>e<b class=ad>f</b></main>g</div>h"
    apart = {t.text for t in extract.tokens(html + "<div class=ad>i") if t.kind == "word" and t.apart}
    assert apart == {"a", "b", "c", "f", "i"}


def test_pages_that_name_no_article_are_read_by_their_weights(weights):
    html = (
        "<body><header>Site</header><div id='menu'><a href=/>home</a> <a href=/a>about</a></div>"
        "<div><h1>News today</h1><p>A long first paragraph with many words.</p><p>And a second one with more.</p></div>"
        "<div class='sidebar'><p>other things</p></div><footer>contact</footer></body>"
    )
    text = extract.main_text(html, weights)
    assert text == "News today\n\nA long first paragraph with many words.\n\nAnd a second one with more."


def test_rows_nulls_and_repeats(spark, weights):
    rows = [(1, None), (2, ""), (3, "just words"), (3, "just words"), (4, "<p></p><div>"), (None, page("<p>é"))]
    found = [tuple(r) for r in extract.extract(frame(spark, rows), weights).collect()]
    assert sorted(found, key=str) == sorted(
        [
            (1, "u1", "", 0), (2, "u2", "", 0), (3, "u3", "just words", 10), (3, "u3", "just words", 10),
            (4, "u4", "", 0), (None, "uNone", "é", 1),
        ],
        key=str,
    )


def test_tables_without_labels_or_rows(spark):
    found = extract.extract(frame(spark, [(1, "<p>several plain words here</p>")])).collect()
    assert [r["text"] for r in found] == ["several plain words here"]
    assert extract.extract(frame(spark, [])).count() == 0


@settings(max_examples=60, deadline=None)
@given(scores=st.lists(st.integers(-9, 9), max_size=40))
def test_best_run_has_the_greatest_sum(scores):
    start, stop = extract.best_run(scores)
    sums = [sum(scores[a:b]) for a in range(len(scores)) for b in range(a, len(scores) + 1)]
    assert sum(scores[start:stop]) == max([0, *sums])


@pytest.mark.parametrize("piece", ["<p>", "<div>", "<b>x", "<", "<b ", "<a href='", "&", "<li>x", "</p>", "<!--", "<script>", "<a x= "])
def test_time_is_linear_in_the_page(weights, piece):
    start = time.process_time()
    extract.main_text(piece * 40_000, weights)
    assert time.process_time() - start < 10


def test_the_run_decides_what_of_a_main_is_the_article(weights):
    body = "<h1>Title</h1><p>One two three four.</p><p>Five six.</p>"
    text = "Title\n\nOne two three four.\n\nFive six."
    teaser = "<div><h3>More stories</h3><a href=/b>Another</a></div>"
    assert extract.main_text(f"<body><main><article>{body}</article>{teaser}</main></body>", weights) == text
    assert extract.main_text(f"<body><nav>x</nav><main>{teaser}<article>{body}</article></main></body>", weights) == text
    listed = f"<main>{body}<section><article><a href=/b>Another</a></article></section></main>"
    assert extract.main_text(f"<body>{listed}<footer>end</footer></body>", weights).startswith(text)


@pytest.mark.parametrize("n", [1, 30, 3000])
def test_long_and_mixed_articles_stay_whole(weights, n):
    parts = [f"Part {i} of the text" for i in range(n)]
    body = "<h1>Title</h1>" + "".join(
        f"<p>{p}</p><div class='ad'>no</div>" if i % 3 else f"<ul><li>{p}<li><b>two</b></ul>" for i, p in enumerate(parts)
    )
    blocks = extract.main_text(page(body), weights).split("\n\n")
    assert blocks == ["Title", *(b for i, p in enumerate(parts) for b in ([p] if i % 3 else [p, "two"]))]


def test_kinds_are_bounded_by_the_names_html_knows():
    _, counts = extract.count_kinds("".join(f"<x-{i}>word</x-{i}>" for i in range(500)) + "<p>a</p>")
    assert set(counts) == {"tag other", "word other", "tag p", "word p"}

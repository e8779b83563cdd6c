"""Main text of pages by the best-scoring run of tokens.

A page is a sequence of tokens, words and tags. Words score positive and tags
negative, each by where it stands, with weights learned from labelled pages: the
log of how much oftener a kind of token lies inside the article than outside. One
linear scan finds the contiguous run with the greatest sum. Its text is returned
by blocks, without what markup itself sets apart inside it.
"""

from __future__ import annotations

import html as entities
import math
import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LABELLED_PAGES = 2_000  # pages the weights are learned from, about
_PRIOR = 2.0
_WORD, _TAG = 1.0, -1.0  # weights of kinds of tokens no labelled page has

# Names and meanings given by the HTML standard.
_VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
_RAW = frozenset("script style textarea title noscript template iframe noframes xmp".split())
_INLINE = frozenset(
    "a abbr b bdi bdo big cite code data del dfn em font i ins kbd label mark meter nobr output q rp rt ruby s samp "
    "small span strike strong sub sup time tt u var wbr br img".split()
)
_APART = frozenset(
    "nav header footer aside form button select option dialog menu svg math canvas audio video object".split()
)
_CLOSES_P = frozenset(
    "address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 "
    "h4 h5 h6 header hgroup hr main menu nav ol p pre search section table ul".split()
)
_ARTICLE = frozenset(["article", "main"])
_KNOWN = _VOID | _RAW | _INLINE | _APART | _CLOSES_P | frozenset(
    "html head body caption colgroup dd dt datalist legend li optgroup picture slot summary tbody td tfoot th thead tr".split()
)
# What an element calls itself. A name of its class, id, or role sets it apart if one of its parts says what it is and
# the others only where or in what form: "comment-list", "cookie-banner", not "has-sidebar" or "comments-open".
_APART_PART = re.compile(
    r"ads?|advert[a-z]*|adsense|sponsor[a-z]*|promo[a-z]*|banner|sidebar|side|menu|nav(?:s|bar|igation)?|"
    r"breadcrumbs?|footer|masthead|comments?|replies|disqus|cookies?|consent|gdpr|notice|alert|newsletter|subscribe|"
    r"signup|popup|modal|overlay|share|sharing|social|related|recommend[a-z]*|widget|pagination|pager|toolbar|skip|"
    r"login|search|copyright|disclaimer|tags"
)
_FORM_PART = re.compile(
    r"area|bar|block|body|bottom|box|button|buttons|card|cards|column|container|content|cta|feed|form|global|group|"
    r"header|holder|inner|item|items|left|link|links|list|lists|main|message|mobile|module|outer|page|panel|post|posts|"
    r"primary|reader|readers|region|right|root|row|secondary|section|site|slot|space|stories|strip|thread|title|top|"
    r"unit|user|users|wrap|wrapper|zone|\d+"
)
_PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])|\d+|[^\W_]")
_MARKUP = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)|<[!?/][^>]*(?:>|\Z)", re.DOTALL)
_TAG_STOP = re.compile(r">|=\s*([\"'])")
_NAMES = re.compile(r"(?:^|\s)(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.IGNORECASE)
_SPACE = re.compile(r"\s+")


def _tag_end(page: str, at: int) -> int:
    """Where a tag ends that is open at ``at``: after the next ``>`` outside a quoted value, or with the page."""
    while True:
        stop = _TAG_STOP.search(page, at)
        if stop is None:
            return len(page)
        if stop[1] is None:
            return stop.end()
        at = page.find(stop[1], stop.end()) + 1
        if not at:
            return len(page)


def sets_apart(labels: str) -> bool:
    """Whether one of the names, parted by white space, says that its element is no part of an article."""
    for label in labels.split():
        parts = [part.lower() for part in _PARTS.findall(label)]
        own = [_APART_PART.fullmatch(part) is not None for part in parts]
        if any(own) and all(is_own or _FORM_PART.fullmatch(part) for is_own, part in zip(own, parts, strict=True)):
            return True
    return False


class Token:
    """A tag, or the text between two tags. ``article``: in an ``article`` or ``main``; ``own``: in an ``article``."""

    __slots__ = ("apart", "article", "end", "kind", "name", "own", "text", "words")

    def __init__(self, kind, name="", text="", words=0, article=False, apart=False, end=False, own=False):
        self.kind, self.name, self.text, self.words = kind, name, text, words
        self.article, self.apart, self.end, self.own = article, apart, end, own


def tokens(page: str) -> list[Token]:
    """The tokens of a page, in one pass; comments and raw elements such as scripts are left out.

    ``apart`` marks what stands in an element that is no part of an article by
    its name or by its class, id, or role. A class, id, or role never sets apart
    what is or holds an ``article`` or ``main``, and no form does that holds one.
    Elements left open are closed by what must close them: a paragraph by the
    next block, others by their parent's end.
    """
    found: list[Token] = []
    open_: list[tuple[str, bool, bool, bool, int]] = []  # name, apart, article, doubtful, first token
    blocks: list[str] = []  # those of them that are no inline elements
    counts: Counter = Counter()
    doubtful: list[int] = []  # first tokens of open elements that are apart unless an article follows in them
    edges: Counter = Counter()  # tokens where those that held none begin, less those where they end
    deep_apart = deep_article = 0
    at, n = 0, len(page)

    def push(name, apart, article, doubt):
        nonlocal deep_apart, deep_article
        open_.append((name, apart, article, doubt, len(found)))
        if name not in _INLINE:
            blocks.append(name)
        counts[name] += 1
        deep_apart += apart
        deep_article += article
        if article:
            doubtful.clear()
        elif doubt:
            doubtful.append(len(found))

    def pop():
        nonlocal deep_apart, deep_article
        name, apart, article, doubt, first = open_.pop()
        if name not in _INLINE:
            blocks.pop()
        counts[name] -= 1
        deep_apart -= apart
        deep_article -= article
        if doubt and doubtful and doubtful[-1] == first:
            doubtful.pop()
            edges[first] += 1
            edges[len(found)] -= 1
        return name

    def text(raw):
        plain = entities.unescape(raw)
        words = len(plain.split())
        inner = "a" if counts["a"] else blocks[-1] if blocks else ""
        found.append(Token("word", inner, plain, words, deep_article > 0, deep_apart > 0, own=counts["article"] > 0))

    while at < n:
        tag = _MARKUP.search(page, at)
        if tag is None:
            text(page[at:])
            break
        if tag.start() > at:
            text(page[at : tag.start()])
        at = tag.end()
        name = (tag[2] or "").lower()
        if not name:
            continue
        at = _tag_end(page, tag.end())
        if tag[1]:
            if counts[name]:
                while pop() != name:
                    pass
                found.append(Token("tag", name, article=deep_article > 0, apart=deep_apart > 0, end=True))
            continue
        if name in _CLOSES_P and counts["p"]:
            while pop() != "p":
                pass
        if name in ("li", "dt", "dd", "tr", "td", "th", "option") and open_ and open_[-1][0] == name:
            pop()
        if name in _RAW:
            stop = re.compile(rf"</{name}(?=[\s/>])[^>]*>", re.IGNORECASE).search(page, at)
            at = stop.end() if stop else n
            found.append(Token("tag", name, article=deep_article > 0, apart=True))
            continue
        labels = " ".join(next(filter(None, x), "") for x in _NAMES.findall(page, tag.end(), at))
        apart = name in _APART and name != "form"
        doubt = name == "form" or sets_apart(labels) and name not in ("body", "html")
        article = name in _ARTICLE
        # A header may open an article; its heading is then part of it.
        if name == "header" and deep_article:
            apart = doubt = False
        if name not in _VOID:
            push(name, apart, article, doubt and not apart and not article)
        found.append(Token("tag", name, article=deep_article > 0, apart=deep_apart > 0))
    while open_:
        pop()
    inside = 0
    for i, token in enumerate(found if edges else ()):
        inside += edges.get(i, 0)
        token.apart = token.apart or inside > 0
    return found


def kind_of(token: Token) -> str:
    """What a token is to the weights: its place, names HTML doesn't know being one, and whether it stands apart."""
    name = token.name if token.name in _KNOWN else "" if not token.name else "other"
    return f"{token.kind} {name}{' apart' if token.apart else ''}"


def count_kinds(page: str) -> tuple[bool, dict[str, list[int]]]:
    """Whether the page says where its article is, and tokens per kind inside and outside it."""
    counts: dict[str, list[int]] = {}
    every = tokens(page)
    for t in every:
        pair = counts.setdefault(kind_of(t), [0, 0])
        pair[0 if t.article and not t.apart else 1] += t.words if t.kind == "word" else 1
    return any(t.article for t in every), counts


def learn_weights(pages: DataFrame, id_col: str = "page_id", html: str = "html") -> dict[str, float]:
    """Weights per kind of token, from pages that label their article with ``article`` or ``main``.

    The labelled pages are a sample, bounded by ``LABELLED_PAGES``; counts are
    summed by Spark, and only one row per kind of token comes back, a few hundred
    at most as kinds are of names that HTML knows. Words keep
    to weights of at least 0.05 where the article has more than its share of
    them, tags to weights below 0.
    """
    total = pages.count()
    near = F.pmod(F.xxhash64(F.col(id_col)), F.lit(2**40)) < int(2**40 * min(1.0, LABELLED_PAGES / max(1, total)))

    def run(batches):
        for batch in batches:
            sums: dict[str, list[int]] = {}
            for page in batch.column(0):
                labelled, counts = count_kinds(page.as_py() or "")
                for kind, (inside, outside) in counts.items() if labelled else ():
                    pair = sums.setdefault(kind, [0, 0])
                    pair[0] += inside
                    pair[1] += outside
            kinds = list(sums)
            yield pa.RecordBatch.from_arrays(
                [pa.array(kinds, pa.string())]
                + [pa.array([sums[k][i] for k in kinds], pa.int64()) for i in (0, 1)],
                ["kind", "inside", "outside"],
            )

    counted = pages.filter(near).select(F.col(html).cast("string").alias("html"))
    sums = counted.mapInArrow(run, "kind string, inside long, outside long").groupBy("kind")
    sums = sums.agg(F.sum("inside").alias("inside"), F.sum("outside").alias("outside"))
    weights = {}
    for row in sums.collect():
        score = math.log((row["inside"] + _PRIOR) / (row["outside"] + _PRIOR))
        word = row["kind"].startswith("word")
        weights[row["kind"]] = max(score, 0.05) if word and score > 0 else score if word else min(score, -0.05)
    return weights


def best_run(scores: list[float]) -> tuple[int, int]:
    """The contiguous run with the greatest sum above 0, the first and longest of them; (0, 0) if none."""
    best, best_run_, total, start = 0.0, (0, 0), 0.0, 0
    for i, score in enumerate(scores):
        if total < 0:
            total, start = 0.0, i
        total += score
        if total > 0 and (total > best or total == best and best_run_[0] == start):
            best, best_run_ = total, (start, i + 1)
    return best_run_


def _score(token: Token, weights: dict[str, float]) -> float:
    kind = kind_of(token)
    if token.kind == "word":
        return token.words * weights.get(kind, -_WORD if token.apart else _WORD)
    return weights.get(kind, _TAG)


def main_text(page: str | None, weights: dict[str, float]) -> str:
    """The main text of a page: its blocks in order, joined by an empty line.

    The run is widened to the whole blocks it touches, and to the whole ``article``
    or ``main`` where the page names one. What stands apart inside is left out, and
    so is what a ``main`` holds besides articles that have half of its words or more.
    """
    every = tokens(page or "")
    start, stop = best_run([_score(t, weights) for t in every])
    if start == stop:
        return ""
    named = any(t.article for t in every[start:stop])
    while start > 0 and (every[start - 1].article if named else not _breaks(every[start - 1])):
        start -= 1
    while stop < len(every) and (every[stop].article if named else not _breaks(every[stop])):
        stop += 1
    inside = [t for t in every[start:stop] if t.kind == "tag" or not t.apart and (t.article or not named)]
    words, own = sum(t.words for t in inside), sum(t.words for t in inside if t.own)
    if words and 2 * own >= words:
        inside = [t for t in inside if t.kind == "tag" or t.own]
    blocks, parts = [], []
    for t in inside:
        if t.kind == "word":
            parts.append(t.text)
        elif t.name == "br":
            parts.append(" ")
        elif _breaks(t):
            blocks.append("".join(parts))
            parts = []
    blocks.append("".join(parts))
    clean = (_SPACE.sub(" ", b).strip() for b in blocks)
    return "\n\n".join(b for b in clean if b)


def _breaks(token: Token) -> bool:
    return token.kind == "tag" and token.name not in _INLINE


def extract(
    pages: DataFrame,
    weights: dict[str, float] | None = None,
    id_col: str = "page_id",
    url: str = "url",
    html: str = "html",
) -> DataFrame:
    """One row per row of ``pages``: page_id, url, text, n_chars.

    Null or empty html, and a page without a run that scores above 0, give an
    empty text. Without labelled pages words weigh 1 and tags -1. Rows repeated
    are extracted each.
    """
    weights = learn_weights(pages, id_col, html) if weights is None else weights

    def run(batches):
        for batch in batches:
            texts = [main_text(page.as_py(), weights) for page in batch.column(2)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())],
                ["page_id", "url", "text", "n_chars"],
            )

    slim = pages.select(
        F.col(id_col).alias("page_id"), F.col(url).cast("string").alias("url"), F.col(html).cast("string").alias("html")
    )
    kind = slim.schema["page_id"].dataType.simpleString()
    return slim.mapInArrow(run, f"page_id {kind}, url string, text string, n_chars long")

"""Reading one HTML page in a single forward pass.

The visible strings of a page are kept in document order. The content of any
element is then a slice of that list, so title and content areas need only the
positions where their element opened and closed.
"""

from __future__ import annotations

from collections import Counter
from html.entities import html5
from html.parser import HTMLParser
from urllib.parse import urljoin

# Fixed values from the HTML rules.
VOID_TAGS = frozenset(
    "area base br col embed hr img input keygen link menuitem meta param source track wbr "
    "basefont bgsound command frame image isindex nextid spacer".split()
)
SILENT_TAGS = frozenset("script style template rt rp".split())
SPACED_TAGS = frozenset("pre textarea".split())
ASCII_SPACE = " \n\t\f\r"
CONTENT_IDS = ("modulecontent", "contentarea")


def _character(number: int) -> str:
    """The character a numeric reference names; low numbers are Windows-1252."""
    if number < 256:
        return bytes([number]).decode("windows-1252", errors="ignore") or chr(number)
    if number > 0x10FFFF or 0xD800 <= number <= 0xDFFF:
        return "\N{REPLACEMENT CHARACTER}"
    return chr(number)


class PageReader(HTMLParser):
    def __init__(self, content_ids: tuple[str, ...] = CONTENT_IDS):
        super().__init__(convert_charrefs=False)
        self.content_ids = content_ids
        self.strings: list[str] = []
        self.slices: dict[str, list] = {}
        self.hrefs: list[str] = []
        self._open: list[tuple[str, str | None]] = []
        self._names: Counter[str] = Counter()  # open elements by name
        self._silent = self._spaced = 0  # open elements of these kinds
        self._pending: list[str] = []
        self._self_closed: Counter[str] = Counter()

    def _end_string(self) -> None:
        if not self._pending:
            return
        data = "".join(self._pending)
        self._pending.clear()
        if self._silent:
            return
        if not data.strip(ASCII_SPACE) and not self._spaced:
            data = "\n" if "\n" in data else " "
        self.strings.append(data)

    def _close_last(self) -> None:
        name, wanted = self._open.pop()
        self._count(name, -1)
        if wanted:
            self.slices[wanted][1] = len(self.strings)

    def _count(self, name: str, change: int) -> None:
        self._names[name] += change
        self._silent += change * (name in SILENT_TAGS)
        self._spaced += change * (name in SPACED_TAGS)

    def handle_starttag(self, tag, attrs):
        self._end_string()
        values = {name: value or "" for name, value in attrs}
        if tag == "a" and "href" in values:
            self.hrefs.append(values["href"])
        wanted = tag if tag in ("h1", "title") else None
        if tag == "div" and values.get("id") in self.content_ids:
            wanted = "#" + values["id"]
        if wanted in self.slices:
            wanted = None
        if wanted:
            self.slices[wanted] = [len(self.strings), None]
        self._open.append((tag, wanted))
        self._count(tag, 1)
        if tag in VOID_TAGS:
            self._close_last()
            self._self_closed[tag] += 1

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        self.handle_endtag(tag)

    def handle_endtag(self, tag):
        self._end_string()
        if self._self_closed[tag]:
            self._self_closed[tag] -= 1
            return
        if self._names[tag]:
            while self._open[-1][0] != tag:
                self._close_last()
            self._close_last()

    def handle_data(self, data):
        self._pending.append(data)

    def handle_entityref(self, name):
        self._pending.append(html5.get(name + ";", "&" + name))

    def handle_charref(self, name):
        number = int(name[1:], 16) if name[0] in "xX" else int(name)
        self._pending.append(_character(number))

    def handle_comment(self, data):
        self._end_string()

    def handle_decl(self, decl):
        self._end_string()

    def handle_pi(self, data):
        self._end_string()

    def unknown_decl(self, data):
        self._end_string()
        if data.upper().startswith("CDATA["):
            self._pending.append(data[6:])
            self._end_string()

    def read(self, html: str) -> PageReader:
        self.feed(html)
        self.close()
        self._end_string()
        while self._open:
            self._close_last()
        return self

    def _strings_of(self, name: str) -> list[str]:
        start, end = self.slices[name]
        return self.strings[start:end]

    def title(self) -> str:
        for name in ("h1", "title"):
            if name in self.slices:
                return "".join(self._strings_of(name)).strip()
        return ""

    def body(self) -> str:
        chosen = next(("#" + i for i in self.content_ids if "#" + i in self.slices), None)
        strings = self._strings_of(chosen) if chosen else self.strings
        return " ".join(s for s in map(str.strip, strings) if s)


def resolve_links(base: str, hrefs: list[str]) -> list[str]:
    """Absolute targets, in page order. A malformed link is skipped on its own."""
    targets = []
    for href in hrefs:
        try:
            targets.append(urljoin(base, href))
        except ValueError:
            continue
    return targets

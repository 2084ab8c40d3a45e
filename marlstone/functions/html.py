"""The main content of pages by a walk over their tags, for pages at which patterns fail: nested, unclosed and misnested hidden elements, and what looks like tags in scripts and comments."""

from __future__ import annotations

import re
from html.entities import html5
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import HIDDEN

#: Fixed values of the HTML standard: elements without content, what a head may hold, elements of formatting, elements at which the search for an end tag's start stops, and those that bound it.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
HEAD = frozenset("base basefont bgsound link meta title noscript noframes style script template head html".split())
FORMATTING = frozenset("a b big code em font i nobr s small strike strong tt u".split())
SPECIAL = frozenset(
    "address applet area article aside base basefont bgsound blockquote body br button caption center col colgroup dd details dir div dl dt embed fieldset figcaption figure footer form frame frameset h1 h2 h3 h4 h5 h6 head header "
    "hgroup hr html iframe img input keygen li link listing main marquee menu meta nav noembed noframes noscript object ol p param plaintext pre script search section select source style summary table tbody td template "
    "textarea tfoot th thead title tr track ul wbr xmp".split()
)
SCOPE = frozenset("applet caption html table td th marquee object template".split())
#: White space of the language whose rules the content follows.
_SPACE = re.compile("[\t\n\x0b\x0c\r \xa0  -     　﻿]+")
_OTHER = re.compile(r"[^\x20-\x7E]+")
#: Fixed value: an ampersand and, if there is one, the reference with a semicolon that it begins.
_AMPERSAND = re.compile(r"&(#[0-9]+;|#[xX][0-9a-fA-F]+;|[A-Za-z][A-Za-z0-9]*;)?")
_RAW = frozenset(("script", "style", "iframe", "noframes", "noembed", "xmp"))


class _Visible(HTMLParser):
    """Collects the text that no hidden element holds. ``open``: the elements that are open, outermost first."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.open: list[str] = []
        self.hidden = 0
        self.raw = ""
        self.parts: list[str] = []

    def _pop(self, at: int, many: int | None = None) -> None:
        gone = self.open[at : at + 1] if many == 1 else self.open[at:]
        self.hidden -= sum(t in HIDDEN for t in gone)
        self.open[at : at + 1 if many == 1 else None] = []

    def handle_starttag(self, tag: str, attrs) -> None:
        if self.raw or tag in ("html", "body"):
            if not self.raw and "head" in self.open and tag == "body":
                self._pop(self.open.index("head"))
            return
        if "head" in self.open and tag not in HEAD:
            self._pop(self.open.index("head"))
        if tag == "head" and (self.open or self.parts):  # one that comes late is no element
            return
        if tag not in VOID:
            self.open.append(tag)
            self.hidden += tag in HIDDEN
            self.raw = tag if tag in _RAW else ""

    def handle_startendtag(self, tag: str, attrs) -> None:
        self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag: str) -> None:
        if self.raw:
            if tag != self.raw:
                return
            self.raw = ""
        if tag in ("html", "body"):
            return
        for at in range(len(self.open) - 1, -1, -1):
            name = self.open[at]
            if name == tag:
                # An element of formatting ends by itself where a block has begun within it.
                alone = tag in FORMATTING and any(t in SPECIAL for t in self.open[at + 1 :])
                self._pop(at, 1 if alone else None)
                return
            if name in SCOPE or (name in SPECIAL and tag not in SPECIAL and tag not in FORMATTING):
                return

    def handle_data(self, data: str) -> None:
        if "head" in self.open and self.open[-1] == "head" and data.strip():
            self._pop(self.open.index("head"))
        if not self.hidden:
            self.parts.append(data)


def _closed_only(page: str) -> str:
    """``page`` with every ampersand escaped that does not begin a reference with a semicolon."""
    return _AMPERSAND.sub(lambda m: m.group() if m.group(1) and (m.group(1)[0] == "#" or m.group(1) in html5) else f"&amp;{m.group()[1:]}", page)


def main_content(page: str, closed_only: bool = False) -> str:
    """The text of a page's body without hidden elements: nothing between neighbouring elements, white space as one space, then what is not printable ASCII left out, trimmed.

    Character references are those of the HTML standard, among which some need no semicolon (``&amp`` is an ampersand); with ``closed_only`` the others stay as they stand."""
    parser = _Visible()
    parser.feed(_closed_only(page) if closed_only else page)
    parser.close()
    return _OTHER.sub("", _SPACE.sub(" ", "".join(parser.parts))).strip(" ")


def page_content(html: Column, closed_only: bool = False) -> Column:
    """``main_content`` of a column; null for null."""

    @F.pandas_udf("string")
    def run(pages: pd.Series) -> pd.Series:
        return pd.Series([None if p is None else main_content(p, closed_only) for p in pages], dtype=object)

    return run(html)

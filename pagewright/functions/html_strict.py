"""Parser-based extraction for pages the expressions are not exact for.

Arrow-batched pandas UDFs around the standard library's HTML parser. They get
null for every page that does not need them, so plain pages cost no parsing. A
page that cannot be parsed yields the defaults instead of failing the job.
"""

from __future__ import annotations

from html.parser import HTMLParser
from urllib.parse import urljoin

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pagewright.functions.html import BOILERPLATE_TAGS, HIDDEN_TAGS, RAW_TAGS, VOID_TAGS

_VOID = frozenset(VOID_TAGS)
_DROPPED = frozenset(RAW_TAGS + BOILERPLATE_TAGS + HIDDEN_TAGS)


class _PageReader(HTMLParser):
    """Collects title, visible text and anchors while tracking open elements."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.open: list[str] = []
        self.dropped = 0
        self.in_title = 0
        self.title: list[str] | None = None
        self.text: list[str] = []
        self.hrefs: list[str] = []

    def handle_starttag(self, tag, attrs):
        if tag == "a":
            values = [v or "" for k, v in attrs if k == "href"]
            if values:
                self.hrefs.append(values[-1])
        if tag in _VOID:
            return
        self.open.append(tag)
        self.dropped += tag in _DROPPED
        if tag == "title" and (self.title is None or self.in_title):
            self.title = self.title or []
            self.in_title += 1

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        self.handle_endtag(tag)

    def handle_endtag(self, tag):
        if tag not in self.open:
            return
        while True:
            closed = self.open.pop()
            self.dropped -= closed in _DROPPED
            if closed == "title" and self.in_title:
                self.in_title -= 1
            if closed == tag:
                return

    def handle_data(self, data):
        if self.in_title and self.title is not None:
            self.title.append(data)
        if not self.dropped:
            self.text.append(data)

    def unknown_decl(self, data):
        if data.startswith("CDATA[") and not self.dropped:
            self.text.append(data[6:])


def read_page(html: str) -> tuple[str, str, list[str]]:
    """(title, content, hrefs) of one page."""
    try:
        reader = _PageReader()
        reader.feed(html)
        reader.close()
    except Exception:
        return "No Title", "", []
    title = "No Title" if reader.title is None else "".join(reader.title).strip()
    lines = (line.strip() for line in "".join(reader.text).splitlines())
    return title, " ".join(line for line in lines if line), reader.hrefs


_PAGE_SCHEMA = (
    T.StructType()
    .add("title", T.StringType())
    .add("content", T.StringType())
    .add("hrefs", T.ArrayType(T.StringType()))
)


@F.pandas_udf(_PAGE_SCHEMA)
def read_pages(html: pd.Series) -> pd.DataFrame:
    blank = (None, None, None)
    rows = [blank if h is None else read_page(h) for h in html]
    return pd.DataFrame(rows, columns=["title", "content", "hrefs"])


def _join(base: str | None, href: str | None) -> str | None:
    try:
        return urljoin(base, href)
    except (ValueError, TypeError, AttributeError):
        return None


@F.pandas_udf(T.StringType())
def join_urls(base: pd.Series, href: pd.Series) -> pd.Series:
    return pd.Series([_join(b, h) for b, h in zip(base, href)], dtype=object)

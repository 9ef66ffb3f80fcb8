"""HTML as Markdown-like text, by a standard-library parser in an Arrow function; titles and links by expressions."""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lectern.functions.shipping import map_arrow

# Tags that are left out with all they hold, that stand alone, and that are blocks.
DROPPED = frozenset("script style noscript template nav aside footer iframe svg canvas form button input select textarea option head meta link title".split())
ALONE = frozenset("area base br col embed hr img input link meta source track wbr".split())
BLOCKS = frozenset("p div section article main header ul ol dl dt dd table thead tbody tfoot caption blockquote pre figure figcaption address details summary hr fieldset legend body html".split())
HEADINGS = {f"h{n}": n for n in range(1, 7)}
ROOTS = ("main", "article", "body")


class _Renderer(HTMLParser):
    """Collects text for each possible root at once: whole page, first main, first article, first body."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.out: list[str] = []
        self.dropping: list[str] = []
        self.heading: tuple[str, list[str]] | None = None
        self.roots: dict[str, list[int]] = {}
        self.depth: dict[str, int] = {}
        self.title: list[str] | None = None
        self.in_title = False
        self.h1: str | None = None

    def _mark(self, tag: str, opens: bool) -> None:
        if tag not in ROOTS:
            return
        self.depth[tag] = self.depth.get(tag, 0) + (1 if opens else -1)
        if opens and tag not in self.roots:
            self.roots[tag] = [len(self.out), -1]
        elif not opens and self.depth[tag] == 0 and self.roots.get(tag, [0, 0])[1] < 0:
            self.roots[tag][1] = len(self.out)

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag == "title" and self.title is None:
            self.title, self.in_title = [], True
        if self.dropping:
            if tag not in ALONE and tag in DROPPED:
                self.dropping.append(tag)
            return
        if tag in DROPPED:
            if tag not in ALONE:
                self.dropping.append(tag)
            return
        self._mark(tag, True)
        if tag in HEADINGS:
            self.heading = (tag, [])
        elif tag in ("br", "tr"):
            self.out.append("\n")
        elif tag == "li":
            self.out.append("\n- ")
        elif tag in BLOCKS:
            self.out.append("\n\n")

    def handle_endtag(self, tag: str) -> None:
        if tag == "title":
            self.in_title = False
        if self.dropping:
            if tag in self.dropping:
                del self.dropping[len(self.dropping) - 1 - self.dropping[::-1].index(tag) :]
            return
        if tag in HEADINGS and self.heading:
            told = " ".join(" ".join(self.heading[1]).split())
            if told:
                self.out.append(f"\n\n{'#' * HEADINGS[self.heading[0]]} {told}\n\n")
                if self.heading[0] == "h1" and self.h1 is None:
                    self.h1 = told
            self.heading = None
        elif tag in ("td", "th"):
            self.out.append(" | ")
        elif tag in ("li", "tr"):
            self.out.append("\n")
        elif tag in BLOCKS:
            self.out.append("\n\n")
        self._mark(tag, False)

    def handle_data(self, data: str) -> None:
        if self.in_title and self.title is not None:
            self.title.append(data)
        if self.dropping:
            return
        (self.heading[1] if self.heading else self.out).append(data)


#: White space within lines, at their ends, a bar that ends a table's row, and empty lines.
_TIDY = [(re.compile(p, re.M), told) for p, told in ((r"[^\S\n]+", " "), (r"^ | $", ""), (r" \|$", ""), (r"\n{3,}", "\n\n"))]


def to_text(html: str | None) -> tuple[str | None, str]:
    """Title (title tag, else first h1) and text of the first of main, article, body or the page."""
    page = _Renderer()
    page.feed(html or "")
    page.close()
    start, end = next((page.roots[r] for r in ROOTS if r in page.roots), [0, -1])
    text = "".join(page.out[start : end if end >= 0 else None])
    for pattern, told in _TIDY:
        text = pattern.sub(told, text)
    title = " ".join("".join(page.title or []).split()) or page.h1
    return title, text.strip()


def body_text(html: str | None) -> str:
    return to_text(html)[1]


def rendered(rows: DataFrame, column: str = "html") -> DataFrame:
    """rows with title and text of an HTML column."""
    names = rows.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 256):
                part = b.slice(at, 256)
                found = [to_text(h) for h in part.column(column).to_pylist()]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.string())], [*names, "title", "text"])

    return map_arrow(rows, run, T.StructType([*rows.schema.fields, T.StructField("title", T.StringType()), T.StructField("text", T.StringType())]))


def title(html: Column) -> Column:
    """The title tag's text on one line, null if there is none."""
    return F.nullif(F.trim(F.regexp_replace(F.regexp_extract(html, "(?is)<title[^>]*>(.*?)</title>", 1), "\\s+", " ")), F.lit(""))


def links(html: Column) -> Column:
    return F.regexp_extract_all(html, F.lit('(?i)<a [^>]*href="([^"]*)"'), F.lit(1))


def stripped(html: Column) -> Column:
    """Text without scripts, styles, comments and tags, on one line."""
    text = F.regexp_replace(html, "(?is)<(script|style)[^>]*>.*?</(script|style)>|<!--.*?-->", " ")
    return F.trim(F.regexp_replace(F.regexp_replace(text, "<[^>]*>", " "), "\\s+", " "))

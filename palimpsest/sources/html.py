"""Readable text and title of web pages."""

from __future__ import annotations

import html
from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import lists

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())


class _Reader(HTMLParser):
    """Collects text outside skipped elements; a line break follows each block element."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.out: list[str] = []
        self.open: list[tuple[str, bool]] = []  # element, whether it hides its content

    @staticmethod
    def _hidden(tag: str, attrs: list[tuple[str, str | None]]) -> bool:
        if tag in lists.HTML_SKIPPED:
            return True
        for k, v in attrs:
            if k == "hidden" or k == "aria-hidden" and v == "true":
                return True
            if k in ("class", "id") and any(m in (v or "").lower() for m in lists.HTML_MARKS):
                return True
        return False

    @property
    def hidden(self) -> bool:
        return any(h for _, h in self.open)

    def _leave(self, tag: str) -> None:
        if tag in lists.HTML_BLOCKS and not self.hidden:
            self.out.append("\n")

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag in ("p", "li", "tr", "td", "dd", "dt") and self.open and self.open[-1][0] == tag:
            self.handle_endtag(tag)  # closed by a sibling
        if tag in VOID:
            if not self._hidden(tag, attrs):
                self._leave(tag)
            return
        self.open.append((tag, self._hidden(tag, attrs)))

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag in VOID:
            self.handle_starttag(tag, attrs)
        else:
            self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag: str) -> None:
        if all(t != tag for t, _ in self.open):
            return
        while self.open:
            t, hid = self.open.pop()
            if not hid:
                self._leave(t)
            if t == tag:
                return

    def handle_data(self, data: str) -> None:
        if not self.hidden:
            self.out.append(data)

    def text(self) -> str:
        while self.open:
            t, hid = self.open.pop()
            if not hid:
                self._leave(t)
        lines = (" ".join(line.split()) for line in "".join(self.out).split("\n"))
        return "".join(f"{line}\n" for line in lines if line)


def html_to_text(page: str | None) -> str:
    reader = _Reader()
    reader.feed(page or "")
    reader.close()
    return reader.text()


def text_of_pages(pages: DataFrame) -> DataFrame:
    """``page_id, text`` of HTML pages."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"page_id": b["page_id"], "text": [html_to_text(h) for h in b["html"]]})

    return pages.select("page_id", "html").mapInPandas(run, "page_id long, text string")


def unescape(column: Column) -> Column:
    @F.pandas_udf("string")
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda x: None if x is None else html.unescape(x).strip())

    return run(column)


def raw_title(page: Column) -> Column:
    """Content of the first title element, white space collapsed; entities as they stand."""
    found = F.regexp_extract(page, r"(?is)<title[^>]*>(.*?)</title>", 1)
    return F.trim(F.regexp_replace(found, r"\s+", " "))


def title(page: Column) -> Column:
    """Page title; Python sees only titles that hold an entity."""
    raw = raw_title(page)
    return F.when(raw.contains("&"), unescape(raw)).otherwise(raw)

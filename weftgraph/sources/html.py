"""HTML pages to Markdown, and anchors of text to Markdown links."""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser
from urllib.parse import quote, urljoin, urlsplit, urlunsplit

import pyarrow as pa
from pyspark.sql import DataFrame

from ..functions.text import text_slices

_SKIP = {"script", "style", "noscript", "template"}


class _Markdown(HTMLParser):
    """Collects text pieces in document order."""

    def __init__(self, base: str):
        super().__init__(convert_charrefs=True)
        self.base, self.pieces, self.title = base, [], None
        self.lists: list[list] = []
        self.open: list[str] = []
        self.link: tuple[str, list[str]] | None = None
        self.heading, self.item = 0, ""

    def handle_starttag(self, tag, attrs):
        if tag in ("ul", "ol"):
            self.lists.append([tag, 0])
        elif tag == "li" and self.lists:
            self.lists[-1][1] += 1
            self.item = "- " if self.lists[-1][0] == "ul" else f"{self.lists[-1][1]}. "
        elif len(tag) == 2 and tag[0] == "h" and tag[1] in "123456":
            self.heading = int(tag[1])
        elif tag == "a" and dict(attrs).get("href"):
            self.link = (urljoin(self.base, dict(attrs)["href"]), [])
        if tag in _SKIP or tag == "title":
            self.open.append(tag)

    def handle_endtag(self, tag):
        if tag in ("ul", "ol") and self.lists:
            self.lists.pop()
        elif tag == "a" and self.link:
            address, text = self.link
            self.link = None
            if text:
                self._add(f"[{' '.join(text)}]({address})")
        elif len(tag) == 2 and tag[0] == "h" and tag[1] in "123456":
            self.heading = 0
        elif tag == "li":
            self.item = ""
        if tag in self.open:
            del self.open[len(self.open) - 1 - self.open[::-1].index(tag)]

    def handle_data(self, data):
        text = " ".join(data.split())
        if not text or any(t in _SKIP for t in self.open):
            return
        if "title" in self.open:
            self.title = self.title or text
        elif self.link:
            self.link[1].append(text)
        else:
            self._add(text)

    def _add(self, text: str) -> None:
        head = "#" * self.heading + " " if self.heading else self.item
        self.pieces.append(head + text)
        self.item = ""


def markdown(html: str | None, base: str | None) -> tuple[str, str]:
    """(Markdown, title) of a page; a page without a title is an "Untitled Page"."""
    p = _Markdown(base or "")
    p.feed(html or "")
    p.close()
    return "\n".join(p.pieces), p.title or "Untitled Page"


def html_to_markdown(pages: DataFrame, id_col: str = "page_id", html: str = "html", base: str = "url") -> DataFrame:
    """(page_id, md, title): headings as #, links with absolute addresses, list items as - or n., pieces on lines of their own. No shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in text_slices(batches, 1):
            found = [markdown(h, b) for h, b in zip(rows.column(1).to_pylist(), rows.column(2).to_pylist())]
            yield pa.RecordBatch.from_arrays([rows.column(0), pa.array([m for m, _ in found], pa.string()), pa.array([t for _, t in found], pa.string())], [id_col, "md", "title"])

    return pages.select(id_col, html, base).mapInArrow(run, f"{id_col} {pages.schema[id_col].dataType.simpleString()}, md string, title string")


def link_anchors(text: str, anchors: list[str], addresses: list[str], base: str) -> str:
    """Each anchor's text as a Markdown link to the absolute address with a quoted path, longest anchors first."""
    marks = {}
    for anchor, address in sorted(zip(anchors, addresses), key=lambda p: (-len(p[0] or ""), p[0] or "")):
        if not anchor or not address:
            continue
        parts = urlsplit(urljoin(base, address))
        key = f"\x00{len(marks)}\x00"
        marks[key] = f"[{anchor}]({urlunsplit(parts._replace(path=quote(parts.path, safe='/%')))})"
        text = text.replace(anchor, key)
    for key, value in marks.items():
        text = text.replace(key, value)
    return text


def link_chunk_anchors(chunks: DataFrame) -> DataFrame:
    """``chunks(id, text, link_texts, link_urls, base)`` as (id, text) with links. No shuffle; null lists are empty. A task holds one
    Arrow batch, and of its texts as Python strings one slice."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in text_slices(batches, 1):
            given = zip(*[rows.column(i).to_pylist() for i in range(1, 5)])
            texts = [link_anchors(t or "", a or [], u or [], b or "") for t, a, u, b in given]
            yield pa.RecordBatch.from_arrays([rows.column(0), pa.array(texts, pa.string())], ["id", "text"])

    return chunks.select("id", "text", "link_texts", "link_urls", "base").mapInArrow(run, f"id {chunks.schema['id'].dataType.simpleString()}, text string")

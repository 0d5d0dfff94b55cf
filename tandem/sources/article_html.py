"""Scraped article pages to nested records. Spark has no HTML function, so this is the one place where rows go through Python: as Arrow batches, one
pass of the standard parser per page, after whatever filters stand before."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tandem.sources.schemas import ARTICLES_B

#: Fixed values of the pages' layout.
CONTAINER, PARAGRAPH, REFERENCES, EDITS = "mx-auto max-w-[850px]", "mb-4", "references", "See Edits"
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
HEADINGS = ("h1", "h2", "h3")


class Element:
    __slots__ = ("tag", "attrs", "parts", "up", "place")

    def __init__(self, tag: str, attrs: dict, up: "Element | None"):
        self.tag, self.attrs, self.parts, self.up, self.place = tag, attrs, [], up, 0
        if up is not None:
            self.place = len(up.parts)
            up.parts.append(self)

    def walk(self, *tags: str) -> Iterator["Element"]:
        """Descendants by document order, without recursion: pages may nest deeply."""
        ahead = [iter(self.parts)]
        while ahead:
            part = next(ahead[-1], None)
            if part is None:
                ahead.pop()
            elif isinstance(part, Element):
                if not tags or part.tag in tags:
                    yield part
                ahead.append(iter(part.parts))

    def text(self) -> str:
        """The stripped text nodes, joined without a separator."""
        out, ahead = [], [iter(self.parts)]
        while ahead:
            part = next(ahead[-1], None)
            if part is None:
                ahead.pop()
            elif isinstance(part, Element):
                ahead.append(iter(part.parts))
            else:
                out.append(part.strip())
        return "".join(out)

    def classes(self) -> list[str]:
        return (self.attrs.get("class") or "").split()


class Tree(HTMLParser):
    def __init__(self, page: str):
        super().__init__(convert_charrefs=True)
        self.root = self.now = Element("", {}, None)
        self.feed(page)
        self.close()

    def handle_starttag(self, tag, attrs):
        made = Element(tag, dict(attrs), self.now)
        if tag not in VOID:
            self.now = made

    def handle_startendtag(self, tag, attrs):
        Element(tag, dict(attrs), self.now)

    def handle_endtag(self, tag):
        up = self.now
        while up is not None and up.tag != tag:
            up = up.up
        if up is not None and up.up is not None:
            self.now = up.up

    def handle_data(self, data):
        if data:
            self.now.parts.append(data)


def _content(heading: Element) -> list[dict]:
    """What follows a heading among its siblings, up to one of its own or a higher level."""
    out = []
    for part in heading.up.parts[heading.place + 1 :]:
        if not isinstance(part, Element):
            continue
        if part.tag in HEADINGS and part.tag <= heading.tag:
            break
        if part.tag == "span" and PARAGRAPH in part.classes():
            text = " ".join(part.text().split())
            if text:
                out.append({"type": "paragraph", "text": text})
        elif part.tag in ("ul", "ol"):
            items = [li.text() for li in part.walk("li")]
            if items:
                out.append({"type": "list" if part.tag == "ul" else "ordered_list", "items": items})
    return out


def parse(page: str | None, url: str | None, title: str | None = None) -> dict:
    """The record of a page: title, main_title, sections, paragraphs, tables, references, metadata. A page without the container has empty lists."""
    url = url or ""
    data = {"title": title if title is not None else url.split("/page/")[-1], "url": url, "main_title": None, "sections": [], "paragraphs": [], "tables": [], "references": [], "metadata": {"has_edits": False, "fact_check_timestamp": None}}
    root = Tree(page or "").root
    article = next((e for e in root.walk("div") if (e.attrs.get("class") or "") == CONTAINER), None)
    if article is None:
        return data
    first = next(article.walk("h1"), None)
    data["main_title"] = first.text() if first is not None else None
    button = next((b for b in root.walk("button") if len(b.parts) == 1 and EDITS in b.text()), None)
    if button is not None:
        data["metadata"]["has_edits"] = True
        count = re.search(r"\((\d+)\)", button.text())
        if count:
            data["metadata"]["edits_count"] = int(count[1])
    data["sections"] = [{"level": h.tag, "id": h.attrs["id"], "title": h.text(), "content": _content(h)} for h in article.walk(*HEADINGS) if "id" in h.attrs]
    paragraphs = dict.fromkeys(t for s in article.walk("span") if PARAGRAPH in s.classes() and (t := " ".join(s.text().split())))
    for table in article.walk("table"):
        head, body = next(table.walk("thead"), None), next(table.walk("tbody"), None)
        headers = [c.text() for c in head.walk("th")] if head is not None else []
        rows = [row for r in (body.walk("tr") if body is not None else ()) if (row := [c.text() for c in r.walk("td")])]
        if headers or rows:
            data["tables"].append({"headers": headers, "rows": rows})
    box = next((e for e in root.walk("div") if e.attrs.get("id") == REFERENCES), None)
    for li in box.walk("li") if box is not None else ():
        text, link = li.text(), next(li.walk("a"), None)
        if text:
            data["references"].append({"text": text, "link": {"href": link.attrs["href"], "text": link.text()} if link is not None and link.attrs.get("href") else None})
    starts = {tuple(r["text"].split()[:3]) for r in data["references"]}
    data["paragraphs"] = [p for p in paragraphs if tuple(p.split()[:3]) not in starts]
    return data


def parse_pages(pages: DataFrame, html: str = "html", url: str = "url") -> DataFrame:
    """pages with html and url -> url and data, the struct of the article schema."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            urls = batch.column(0)
            yield pa.RecordBatch.from_arrays([urls, pa.array([json.dumps(parse(h.as_py(), u.as_py())) for u, h in zip(urls, batch.column(1))], pa.string())], names=["url", "record"])

    raw = pages.select(F.col(url).alias("url"), F.col(html).alias("html")).mapInArrow(run, "url string, record string")
    kind = ARTICLES_B.split("data ", 1)[1]
    return raw.select("url", F.from_json("record", kind).alias("data"))

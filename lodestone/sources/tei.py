"""Documents' markup as section trees: TEI of papers, headings of pages."""

from __future__ import annotations

import xml.etree.ElementTree as ET
from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SECTION = "id int, parent_id int, section_path string, title string, ordinal int, page_start int, page_end int, body_text string"
_NS = "{http://www.tei-c.org/ns/1.0}"


def _pages(element: ET.Element) -> list[int]:
    found = []
    for group in (element.get("coords") or "").split(";"):
        try:
            found.append(int(float(group.split(",")[0])))
        except ValueError:
            continue
    return found


def tei_sections(markup: str) -> list[tuple]:
    """(id, parent, path, title, ordinal, first page, last page, own text) of each div, parents first."""
    out: list[tuple] = []
    untitled = 0

    def walk(div: ET.Element, parent: int | None, above: str) -> None:
        nonlocal untitled
        head = div.find(f"{_NS}head")
        title = " ".join("".join(head.itertext()).split()) if head is not None else ""
        if not title:
            untitled += 1
            title = f"Untitled section {untitled}"
        path = f"{above}/{title}" if above else title
        own = div.findall(f"{_NS}p")
        pages = [n for e in [*([head] if head is not None else []), *own] for n in _pages(e)]
        me = len(out) + 1
        out.append((me, parent, path, title, me - 1, min(pages, default=None), max(pages, default=None), "\n".join(" ".join("".join(p.itertext()).split()) for p in own)))
        for child in div.findall(f"{_NS}div"):
            walk(child, me, path)

    body = ET.fromstring(markup).find(f".//{_NS}text/{_NS}body")
    for div in body.findall(f"{_NS}div") if body is not None else []:
        walk(div, None, "")
    return out


class _Headings(HTMLParser):
    def __init__(self) -> None:
        super().__init__()
        self.found: list[tuple[int, str]] = []
        self.level = 0

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if len(tag) == 2 and tag[0] == "h" and tag[1].isdigit():
            self.level = int(tag[1])
            self.found.append((self.level, ""))

    def handle_endtag(self, tag: str) -> None:
        if len(tag) == 2 and tag[0] == "h" and tag[1].isdigit():
            self.level = 0

    def handle_data(self, data: str) -> None:
        if self.level:
            level, title = self.found[-1]
            self.found[-1] = (level, title + data)


def heading_tree(markup: str) -> list[tuple]:
    """(id, parent, path, title, ordinal, no pages, no text) for each heading, by level."""
    parser = _Headings()
    parser.feed(markup)
    out: list[tuple] = []
    open_: list[tuple[int, int, str]] = []
    for level, title in parser.found:
        title = " ".join(title.split())
        while open_ and open_[-1][0] >= level:
            open_.pop()
        me = len(out) + 1
        path = f"{open_[-1][2]}/{title}" if open_ else title
        out.append((me, open_[-1][1] if open_ else None, path, title, me - 1, None, None, ""))
        open_.append((level, me, path))
    return out


def _sections(df: DataFrame, id_col: str, markup_col: str, read) -> DataFrame:
    kind = df.schema[id_col].dataType.simpleString()
    names = [c.split()[0] for c in SECTION.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for key, markup in zip(batch[id_col], batch[markup_col], strict=True):
                try:
                    rows += [(key, *x) for x in read(markup or "")]
                except ET.ParseError:  # one broken document never stops a batch
                    continue
            out = pd.DataFrame(rows, columns=[id_col, *names])
            yield out.astype({c: "Int64" for c in ("parent_id", "page_start", "page_end")})

    return df.select(F.col(id_col), F.col(markup_col)).mapInPandas(run, f"{id_col} {kind}, {SECTION}")


def parse_tei(df: DataFrame, id_col: str = "paper_id", markup_col: str = "tei_xml") -> DataFrame:
    return _sections(df, id_col, markup_col, tei_sections)


def html_sections(df: DataFrame, id_col: str, markup_col: str) -> DataFrame:
    return _sections(df, id_col, markup_col, heading_tree)

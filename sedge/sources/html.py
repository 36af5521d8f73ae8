"""Tables in HTML pages, read by the tokens of the page and not by patterns: entities, cells that span rows and columns,
tables within cells, and end tags that are left out."""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sedge.sources.code import ship

#: Columns of a release table, and how many of them every row must have.
RELEASE = ["freeze_date", "version", "reference", "public_date", "assembly", "ensembl_release", "ucsc_version", "notes"]
NEEDED = 4
#: What a cell may span at most, so that a page cannot ask for more cells than it has room for.
WIDEST = 1000
#: Tags as they are mostly written, which need no search for attributes.
STARTS = {f"<{t}>": t for t in ("td", "th", "tr", "br", "p", "div", "li", "b", "i", "span", "table", "thead", "tbody", "tfoot")}
ENDS = {f"</{t[1:]}": n for t, n in STARTS.items()}
ROWS = "table int, class string, row int, heading boolean, cells array<string>"


class _Table:
    def __init__(self, kind: str):
        self.kind, self.rows, self.spans, self.cell = kind, [], {}, None

    def start_row(self) -> None:
        self.end_cell()
        self.rows.append([[], True])
        self.fill()

    def fill(self) -> None:
        """Cells that come down from rows above."""
        cells = self.rows[-1][0]
        while len(cells) in self.spans:
            at = len(cells)
            text, left = self.spans[at]
            cells.append(text)
            if left > 1:
                self.spans[at] = text, left - 1
            else:
                del self.spans[at]

    def start_cell(self, heading: bool, rows: int, columns: int) -> None:
        self.end_cell()
        if not self.rows:
            self.start_row()
        self.rows[-1][1] &= heading
        self.cell = [[], rows, columns]

    def end_cell(self) -> None:
        if self.cell is None:
            return
        text, rows, columns = " ".join("".join(self.cell[0]).split()), self.cell[1], self.cell[2]
        self.cell, cells = None, self.rows[-1][0]
        for _ in range(columns):
            if rows > 1:
                self.spans[len(cells)] = text, rows - 1
            cells.append(text)
        came_down = {i: s for i, s in self.spans.items() if i < len(cells)}
        below = {i: s for i, s in self.spans.items() if i >= len(cells)}
        self.spans = below
        self.fill()
        self.spans |= came_down


def _number(value: str | None) -> int:
    return min(max(int(value), 1), WIDEST) if (value or "").strip().isdecimal() else 1


class _Reader(HTMLParser):
    """All tables of a page in the order of their start tags."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.tables: list[_Table] = []
        self.open: list[_Table] = []
        self.silent = 0

    def updatepos(self, i: int, j: int) -> int:
        """Nobody asks for lines and columns."""
        return j

    def parse_starttag(self, i: int) -> int:
        end = self.rawdata.find(">", i) + 1
        tag = STARTS.get(self.rawdata[i:end])
        if tag is None:
            return super().parse_starttag(i)
        self.handle_starttag(tag, [])
        return end

    def parse_endtag(self, i: int) -> int:
        end = self.rawdata.find(">", i) + 1
        tag = ENDS.get(self.rawdata[i:end])
        if tag is None:
            return super().parse_endtag(i)
        self.handle_endtag(tag)
        return end

    def handle_starttag(self, tag: str, attrs: list) -> None:
        known = dict(attrs)
        if tag == "table":
            own = _Table(known.get("class") or "")
            self.tables.append(own)
            self.open.append(own)
        elif tag in ("script", "style"):
            self.silent += 1
        elif self.open and tag == "tr":
            self.open[-1].start_row()
        elif self.open and tag in ("td", "th"):
            self.open[-1].start_cell(tag == "th", _number(known.get("rowspan")), _number(known.get("colspan")))
        elif self.open and tag in ("br", "p", "div", "li"):
            self.handle_data(" ")

    def handle_endtag(self, tag: str) -> None:
        if tag in ("script", "style"):
            self.silent = max(0, self.silent - 1)
        elif self.open and tag in ("td", "th", "tr", "tbody", "thead", "tfoot"):
            self.open[-1].end_cell()
        elif self.open and tag == "table":
            self.open[-1].end_cell()
            self.open.pop()

    def handle_data(self, data: str) -> None:
        if self.open and self.open[-1].cell and not self.silent:
            self.open[-1].cell[0].append(data)


def tables_of(page: str) -> list[tuple[str, list[tuple[list[str], bool]]]]:
    """class and rows (cells, whether all are headings) of each table. A table within a cell is one of its own, and its text
    is none of the cell's."""
    reader = _Reader()
    reader.feed(page)
    reader.close()
    for t in reader.open:
        t.end_cell()
    return [(t.kind, [(cells, heading and bool(cells)) for cells, heading in t.rows]) for t in reader.tables]


def _first_marked(found: list[tuple], marked: str) -> list[tuple]:
    """Of numbered tables with rows the first whose class has that word, if there is one."""
    return [x for x in found if x[1][1] and marked in re.split(r"\s+", x[1][0], flags=re.ASCII)][:1]


def table_rows(pages: DataFrame, html: str = "html", keep: tuple[str, ...] = (), marked: str | None = None) -> DataFrame:
    """table (0 and up in a page), class, row, heading and cells of every row of every table in a column of pages, or of
    the first one of each page whose class has the word `marked`. Null pages have none."""
    kinds = {c: pages.schema[c].dataType.simpleString() for c in keep}

    def chosen(found: list[tuple]) -> list[tuple]:
        return found if marked is None else _first_marked(found, marked)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                found = [
                    (i, t, kind, r, heading, cells)
                    for i, page in enumerate(part.column(len(keep)).to_pylist())
                    for t, (kind, rows) in chosen(list(enumerate(tables_of(page or ""))))
                    for r, (cells, heading) in enumerate(rows)
                ]
                if found:
                    of, t, kind, r, heading, cells = zip(*found, strict=True)
                    kept = [part.column(i).take(pa.array(of)) for i in range(len(keep))]
                    own = [pa.array(t, pa.int32()), pa.array(kind), pa.array(r, pa.int32()), pa.array(heading), pa.array(cells, pa.list_(pa.string()))]
                    yield pa.RecordBatch.from_arrays([*kept, *own], names=[*keep, "table", "class", "row", "heading", "cells"])

    ship(pages.sparkSession)
    schema = ", ".join([*(f"{c} {k}" for c, k in kinds.items()), ROWS])
    return pages.select(*keep, F.col(html).cast("string").alias("html")).mapInArrow(run, schema)


def release_table(pages: DataFrame, html: str = "html", keep: tuple[str, ...] = (), marked: str = "striped") -> DataFrame:
    """The releases in the first table of a page whose class has that word: the columns of RELEASE, of which the last may be
    absent (empty), reference as whether it says yes, and is_current. Rows of headings, and those with fewer than four
    cells, are none. A page is read once, in the task that has it."""
    rows = table_rows(pages, html, keep, marked)
    cell = lambda i: F.coalesce(F.get("cells", F.lit(i)), F.lit(""))
    said = cell(RELEASE.index("reference"))
    own = rows.where(~F.col("heading") & (F.size("cells") >= NEEDED))
    return own.select(
        *keep, "row", *((said.startswith("Y") if c == "reference" else cell(i)).alias(c) for i, c in enumerate(RELEASE)),
        F.lower(said).contains("current").alias("is_current"),
    )

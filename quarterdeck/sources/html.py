"""Tables of an HTML corpus."""

from __future__ import annotations

from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Largest spans of HTML's definition.
MOST_COLUMNS, MOST_ROWS = 1000, 65534


class _Table:
    """A table that is being read: its grid of texts, and the cells that reach into rows to come."""

    def __init__(self, number: int):
        self.number, self.row, self.column = number, -1, 0
        self.down: dict[int, tuple[int, list]] = {}  # column → rows still to fill, text
        self.text: list | None = None
        self.cells: list[tuple[int, int, list]] = []

    def next_row(self) -> None:
        self.row, self.column = self.row + 1, 0
        for at, (left, text) in list(self.down.items()):
            self.cells.append((self.row, at, text))
            self.down[at] = (left - 1, text)
        self.taken = set(self.down)
        self.down = {at: x for at, x in self.down.items() if x[0] > 0}

    def next_cell(self, rows: int, columns: int) -> None:
        if self.row < 0:
            self.next_row()
        self.text = []
        for _ in range(columns):
            while self.column in self.taken:
                self.column += 1
            self.taken.add(self.column)
            self.cells.append((self.row, self.column, self.text))
            if rows > 1:
                self.down[self.column] = (rows - 1, self.text)


class _Tables(HTMLParser):
    """Collects the grids of all tables; a nested table is a table of its own."""

    def __init__(self):
        super().__init__()
        self.done, self.open, self.count = [], [], 0

    def handle_starttag(self, tag, attrs):
        if tag == "table":
            self.open.append(_Table(self.count))
            self.count += 1
        elif self.open and tag == "tr":
            self.open[-1].text = None
            self.open[-1].next_row()
        elif self.open and tag in ("td", "th"):
            said = dict(attrs)
            self.open[-1].next_cell(_span(said.get("rowspan"), MOST_ROWS), _span(said.get("colspan"), MOST_COLUMNS))

    def handle_data(self, data):
        if self.open and self.open[-1].text is not None:
            self.open[-1].text.append(data)

    def handle_endtag(self, tag):
        if self.open and tag in ("td", "th", "tr"):
            self.open[-1].text = None
        elif self.open and tag == "table":
            self.done.append(self.open.pop())


def _span(value: str | None, most: int) -> int:
    digits = (value or "").strip()
    return min(max(int(digits), 1), most) if digits.isascii() and digits.isdigit() else 1


def parse_tables(html: str | None) -> list[tuple[int, int, int, str]]:
    """(table, row, cell, text): a cell that spans rows or columns stands at every place of the grid that it covers, in the
    rows that there are."""
    parser = _Tables()
    parser.feed(html or "")
    parser.close()
    tables = sorted([*parser.done, *parser.open], key=lambda t: t.number)
    return [(t.number, row, column, " ".join("".join(text).split())) for t in tables for row, column, text in sorted(t.cells, key=lambda c: c[:2])]


def html_tables(pages: DataFrame) -> DataFrame:
    """(page_id, table, row, cell, text) of every place of every table's grid; pages: page_id, html.

    Null, empty and broken pages give what tables they have; a table that isn't closed ends with the page.
    """

    def run(batches):
        for pdf in batches:
            rows = [(page, *c) for page, html in zip(pdf["page_id"], pdf["html"], strict=True) for c in parse_tables(html)]
            yield pd.DataFrame(rows, columns=["page_id", "table", "row", "cell", "text"])

    return pages.select("page_id", "html").mapInPandas(run, "page_id long, table int, row int, cell int, text string")


def html_grids(pages: DataFrame) -> DataFrame:
    """(document_id, table_index, rows): the tables of pages as the grids that normalize_table_grid takes; gaps are empty."""
    cells = html_tables(pages)
    row = cells.groupBy("page_id", "table", "row").agg(F.map_from_entries(F.collect_list(F.struct("cell", "text"))).alias("m"), F.max("cell").alias("last"))
    filled = row.select("page_id", "table", "row", F.transform(F.sequence(F.lit(0), "last"), lambda i: F.coalesce(F.try_element_at("m", i), F.lit(""))).alias("x"))
    rows = filled.groupBy("page_id", "table").agg(F.array_sort(F.collect_list(F.struct("row", "x"))).alias("r"))
    return rows.select(F.col("page_id").alias("document_id"), F.col("table").alias("table_index"), F.transform("r", lambda r: r["x"]).alias("rows"))

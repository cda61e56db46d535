"""Tables in HTML as cells with places: one Arrow pass over the pages, no exchange.

The markup is read as events, and rows are folded with a carried state: for each column the row until which cells
above cover it. A cell goes to the first column that is free in its row, so row and column spans of earlier cells push it on.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: What browsers hold spans to; larger numbers in a page would make grids without end.
MOST_ROWS, MOST_COLUMNS = 65_534, 1_000
#: Cells handed on at once.
BATCH_CELLS = 1 << 14


@dataclass(frozen=True)
class Markup:
    """Elements that make a table, a row and a cell; a table's element may be its row too, as that of a list is."""

    table: str = "table"
    row: str = "tr"
    cells: tuple[str, ...] = ("td", "th")
    header: str = "th"


TABLES, LISTS = Markup(), Markup("ul", "ul", ("li",), "")


class _Reader(HTMLParser):
    """(table, [(text, row span, column span, header)]) for each row, in the order in which rows end.

    A cell that starts before the last one has ended takes its place; so does a row. Tables within tables count as part of the
    outer one, rows outside of any as part of the last before them.
    """

    def __init__(self, markup: Markup):
        super().__init__()
        self.markup, self.rows = markup, []
        self.depth, self.table = 0, -1
        self.row: list | None = None
        self.cell: list | None = None

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag == self.markup.table:
            self.table += self.depth == 0
            self.depth += 1
        if tag == self.markup.row:
            self.row = []
        elif tag in self.markup.cells:
            spans = dict(attrs)
            self.cell = [[], _span(spans.get("rowspan"), MOST_ROWS), _span(spans.get("colspan"), MOST_COLUMNS), tag == self.markup.header]

    def handle_data(self, data: str) -> None:
        if self.cell:
            self.cell[0].append(data)

    def handle_endtag(self, tag: str) -> None:
        if tag in self.markup.cells and self.cell:
            text, *spans = self.cell
            self.row = [] if self.row is None else self.row
            self.row.append(("".join(text).strip(), *spans))
            self.cell = None
        elif tag == self.markup.row and self.row is not None:
            self.rows.append((max(self.table, 0), self.row))
            self.row = None
        if tag == self.markup.table:
            self.depth = max(0, self.depth - 1)


def _span(value: str | None, most: int) -> int:
    try:
        return min(most, max(1, int(value or 1)))
    except ValueError:
        return 1


def _placed(rows: list[tuple[int, list]]) -> Iterator[tuple]:
    """(table, r, c, content, row span, column span, header, ord) of every cell; r is null where a table has rows but no cell."""
    table, covered, r, ord = None, {}, 0, 0
    for number, row in [*rows, (None, [])]:
        if number != table:
            if table is not None and not ord:
                yield table, None, None, None, None, None, None, None
            table, covered, r, ord = number, {}, 0, 0
        c = 0
        for content, down, across, header in row:
            while covered.get(c, 0) > r:
                c += 1
            yield table, r, c, content, down, across, header and r == 0, ord
            for x in range(c, c + across):
                covered[x] = max(covered.get(x, 0), r + down)
            ord += 1
        r += 1


def html_tables(docs: DataFrame, id_col: str, html_col: str = "html", markup: Markup = TABLES) -> DataFrame:
    """(id, table, r, c, content, row_span, col_span, header, confidence, ord): the cells of all tables of each page, as `tables.table_gate`
    reads them; table counts from 0 within a page, header says that a cell of the first row is marked as one.

    A table whose rows hold no cell has one row without r, so that a gate can refuse it; one without rows has none. Entities are
    resolved, other markup within cells is dropped; scripts and comments hold no cells. Cells, rows and tables that don't end are
    left out. Spans are held to what browsers allow. Null and empty pages have no rows; repeated pages repeat theirs, so ids should differ.
    """
    told = "table int, r int, c int, content string, row_span int, col_span int, header boolean, confidence double, ord int"
    kinds = [pa.int32(), pa.int32(), pa.int32(), pa.string(), pa.int32(), pa.int32(), pa.bool_(), pa.float64(), pa.int32()]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, cells = [], []

            def out() -> pa.RecordBatch:
                columns = list(zip(*[(*x[:-1], None, x[-1]) for x in cells])) or [()] * len(kinds)
                return pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), *[pa.array(c, k) for c, k in zip(columns, kinds)]], names=[id_col, *(x.split()[0] for x in told.split(", "))])

            for i, page in enumerate(batch.column(1)):
                reader = _Reader(markup)
                reader.feed(page.as_py() or "")
                for cell in _placed(reader.rows):
                    at.append(i)
                    cells.append(cell)
                    if len(cells) >= BATCH_CELLS:
                        yield out()
                        at, cells = [], []
            yield out()

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, F.col(html_col).cast("string").alias("html")).mapInArrow(read, f"`{id_col}` {kind}, {told}")

"""Tables of HTML pages: cells laid out on a grid by their spans, as Markdown behind the page's text."""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from metasieve.functions.text import table_to_markdown

#: Columns that a cell spans at most, as in HTML.
MOST_COLUMNS = 1000


class TableReader(HTMLParser):
    """All tables of a page, each a list of rows of (text, columns, rows) cells; inner tables come before outer ones.

    Rows and cells may lack their end tags. A rows span of 0 goes to the table's end.
    """

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.tables: list[list[list[tuple[str, int, int]]]] = []
        self._open: list[dict] = []
        self._silent = 0

    def _end_cell(self) -> None:
        t = self._open[-1]
        if t["cell"] is not None:
            text, columns, rows = t["cell"]
            if not t["rows"]:
                t["rows"].append([])
            t["rows"][-1].append(("".join(text), columns, rows))
            t["cell"] = None

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag in ("script", "style"):
            self._silent += 1
        elif tag == "table":
            self._open.append({"rows": [], "cell": None})
        elif self._open and tag == "tr":
            self._end_cell()
            self._open[-1]["rows"].append([])
        elif self._open and tag in ("td", "th"):
            self._end_cell()
            spans = {k: int(v) for k, v in attrs if v and v.strip().isdecimal()}
            self._open[-1]["cell"] = ([], max(1, min(spans.get("colspan", 1), MOST_COLUMNS)), spans.get("rowspan", 1))
        elif tag == "br":
            self.handle_data("\n")

    def handle_endtag(self, tag: str) -> None:
        if tag in ("script", "style"):
            self._silent = max(0, self._silent - 1)
        elif self._open and tag in ("td", "th", "tr"):
            self._end_cell()
        elif self._open and tag == "table":
            self._end_cell()
            self.tables.append([r for r in self._open.pop()["rows"] if r])

    def handle_data(self, data: str) -> None:
        if self._open and self._open[-1]["cell"] is not None and not self._silent:
            self._open[-1]["cell"][0].append(data)

    def close(self) -> None:
        super().close()
        while self._open:
            self.handle_endtag("table")


def grid(rows: list[list[tuple[str, int, int]]]) -> list[list[str]]:
    """Cells on a grid: a cell takes the first free place of its row and fills what it spans with empty text.

    A span ends at the last row. Rows are padded to one width.
    """
    taken: dict[tuple[int, int], str] = {}
    for y, row in enumerate(rows):
        x = 0
        for text, columns, down in row:
            while (y, x) in taken:
                x += 1
            for dy in range(min(down or len(rows), len(rows) - y)):
                for dx in range(columns):
                    taken.setdefault((y + dy, x + dx), text if dy == dx == 0 else "")
            x += columns
    width = 1 + max((x for _, x in taken), default=-1)
    return [[taken.get((y, x), "") for x in range(width)] for y in range(len(rows))]


def html_tables(html: str | None) -> list[list[list[str]]]:
    reader = TableReader()
    reader.feed(html or "")
    reader.close()
    return [grid(t) for t in reader.tables]


def find_tables(pages: DataFrame, key: str = "page_id", html: str = "html") -> DataFrame:
    """key, tables: the grids of each page's tables. Repeated keys give repeated rows; a null page has no tables."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([html_tables(h) for h in b.column(1).to_pylist()], pa.list_(pa.list_(pa.list_(pa.string()))))], [key, "tables"])

    kind = pages.schema[key].dataType.simpleString()
    return pages.select(key, F.col(html).cast("string").alias("html")).mapInArrow(run, f"{key} {kind}, tables array<array<array<string>>>")


def tables_markdown(tables: Column) -> Column:
    """All tables that hold text, as Markdown, separated by blank lines; null for none."""
    return F.nullif(F.array_join(F.array_compact(F.transform(tables, table_to_markdown)), "\n\n"), F.lit(""))


def marked_pages(pages: DataFrame, key: str = "study_id") -> DataFrame:
    """key, text: a document's pages (key, page from 1, text, tables), each after its mark, its tables after its text."""
    body = F.concat_ws("\n\n", F.format_string("<!-- PAGE %d -->", "page"), F.when(F.rlike(F.coalesce("text", F.lit("")), F.lit(r"\S")), F.col("text")), tables_markdown(F.col("tables")))
    return pages.groupBy(key).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("page", body.alias("b")))), lambda x: x["b"]), "\n\n").alias("text"))

"""Tables inside HTML pages.

A small tolerant reader runs on the executors, one page at a time; headers, names,
padding and typing are DataFrame work.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from rowsmith.functions.names import distinct_names, header_names
from rowsmith.functions.tokens import blank_to_null
from rowsmith.session import checkpointed

TABLES_SCHEMA = (
    "array<struct<table_no:int,caption:string,table_id:string,has_nested:boolean,"
    "rows:array<struct<row_no:int,is_header:boolean,cells:array<string>>>>>"
)


class _TableReader(HTMLParser):
    """Collects the rows of top-level tables; end tags may be missing."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.tables: list[dict] = []
        self.depth = 0
        self.row: list | None = None
        self.cell: list[str] | None = None
        self.caption: list[str] | None = None

    def handle_starttag(self, tag, attrs):
        if tag == "table":
            self.depth += 1
            if self.depth == 1:
                self.tables.append(
                    {"caption": None, "id": dict(attrs).get("id"), "nested": False, "rows": []}
                )
            else:
                self.tables[-1]["nested"] = True
        elif self.depth == 1:
            if tag == "tr":
                self._end_row()
                self.row = []
            elif tag in ("td", "th"):
                self._end_cell()
                if self.row is None:
                    self.row = []
                self.cell = [tag]
            elif tag == "caption" and self.tables[-1]["caption"] is None:
                self.caption = []
            elif tag in ("thead", "tbody", "tfoot"):
                self._end_row()

    def handle_endtag(self, tag):
        if tag == "table" and self.depth:
            if self.depth == 1:
                self._end_row()
                self._end_caption()
            self.depth -= 1
        elif self.depth == 1:
            if tag in ("tr", "thead", "tbody", "tfoot"):
                self._end_row()
            elif tag in ("td", "th"):
                self._end_cell()
            elif tag == "caption":
                self._end_caption()

    def handle_data(self, data):
        if self.cell is not None:
            self.cell.append(data)
        elif self.caption is not None and self.depth == 1:
            self.caption.append(data)

    def _end_caption(self):
        if self.caption is not None:
            self.tables[-1]["caption"] = "".join(self.caption).strip()
            self.caption = None

    def _end_cell(self):
        if self.cell is not None:
            self.row.append((self.cell[0], "".join(self.cell[1:]).strip()))
            self.cell = None

    def _end_row(self):
        self._end_cell()
        if self.row is not None:
            self.tables[-1]["rows"].append(self.row)
            self.row = None


def _page_tables(page: str | None) -> list[dict]:
    reader = _TableReader()
    reader.feed(page or "")
    reader.close()
    if reader.depth:
        reader._end_row()
    tables = []
    for table_no, table in enumerate(reader.tables, start=1):
        rows = [
            {
                "row_no": row_no,
                "is_header": any(tag == "th" for tag, _ in row),
                "cells": [text for _, text in row],
            }
            for row_no, row in enumerate(table["rows"])
            if row
        ]
        tables.append(
            {
                "table_no": table_no,
                "caption": table["caption"],
                "table_id": table["id"] or None,
                "has_nested": table["nested"],
                "rows": rows,
            }
        )
    return tables


def _pages_tables(pages: pd.Series) -> pd.Series:
    return pages.map(_page_tables)


def extract_tables(
    pages: DataFrame, key: str, html: str = "html", header_row: bool = True
) -> DataFrame:
    """One row per data row of every top-level table of every page.

    ``key, table_no, caption, table_id, has_nested, row_no, header, cells``. The header
    is the first row with ``<th>``, or the very first row where ``header_row`` is set.
    Tables without data rows do not appear. Nothing is shuffled.
    """
    read = pandas_udf(_pages_tables, TABLES_SCHEMA)
    tables = pages.select(key, F.inline(read(F.col(html))))
    first_head = F.get(
        F.filter("rows", lambda r: r["is_header"] | (F.lit(header_row) & (r["row_no"] == 0))),
        F.lit(0),
    )
    facts = [key, "table_no", "caption", "table_id", "has_nested"]
    headed = tables.select(*facts, "rows", first_head.alias("head"))
    rows = headed.select(
        *facts, F.col("head.row_no").alias("head_no"), F.col("head.cells").alias("header"), F.inline("rows")
    )
    data = rows.filter(~F.col("row_no").eqNullSafe(F.col("head_no")))
    return data.select(*facts, "row_no", "header", "cells")


def table_name(caption: Column, table_id: Column, source: Column, table_no: Column) -> Column:
    """Caption, else id, else ``<source>_table_N``."""
    numbered = F.concat(source, F.lit("_table_"), table_no.cast("string"))
    return F.coalesce(blank_to_null(caption), blank_to_null(table_id), numbered)


def table_frame(rows: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """Tables of one layout as columns: named by the header, short rows NULL, long rows cut.

    Tables with different headers are an error here; ``layouts`` gives each its own frame.
    """
    headers = rows.select("header").filter("header is not null").distinct().take(2)
    if len(headers) > 1:
        raise ValueError("tables with different headers; read them by layout")
    if headers:
        cells = list(headers[0]["header"])
        names = distinct_names(header_names(cells, len(cells)))
    else:
        width = rows.agg(F.max(F.size("cells"))).first()[0] or 0
        names = [f"column_{i}" for i in range(1, width + 1)]
    return _named(rows, names, keep)


def _named(rows: DataFrame, names: Sequence[str], keep: tuple[str, ...]) -> DataFrame:
    cells = [blank_to_null(F.get("cells", F.lit(i))).alias(n) for i, n in enumerate(names)]
    return rows.select(*keep, *cells)


@dataclass(frozen=True)
class Layout:
    """All tables of one header and width: their column names and rows."""

    names: tuple[str, ...]
    tables: int
    rows: DataFrame


def with_layout(rows: DataFrame, key: str) -> DataFrame:
    """Add ``width`` (of the widest row of a table, or its header) and ``layout``, a hash of header and width."""
    own = rows.groupBy(F.col(key).alias("w_key"), F.col("table_no").alias("w_no")).agg(
        F.max(F.greatest(F.size("cells"), F.coalesce(F.size("header"), F.lit(0)))).alias("width")
    )
    match = rows[key].eqNullSafe(F.col("w_key")) & (rows["table_no"] == F.col("w_no"))
    header = F.transform("header", lambda cell: F.coalesce(cell, F.lit("")))
    return rows.join(own, match).drop("w_key", "w_no").withColumn("layout", F.xxhash64("width", header))


def layouts(rows: DataFrame, key: str, keep: tuple[str, ...] = ()) -> list[Layout]:
    """The catalogue of layouts of all pages, the most frequent first, each with the rows of its tables.

    Rows longer than their header widen it by ``column_N``, so nothing is cut or renamed. The rows are extracted
    once and written; one row per layout comes to the driver.
    """
    found = checkpointed(with_layout(rows, key))
    catalogue = found.groupBy("layout").agg(
        F.first("header").alias("header"), F.first("width").alias("width"), F.count_distinct(key, "table_no").alias("tables")
    )
    made = []
    for row in catalogue.orderBy(F.desc("tables"), "layout").collect():
        names = distinct_names(header_names(row["header"] or (), row["width"]))
        own = found.filter(F.col("layout") == row["layout"])
        made.append(Layout(tuple(names), row["tables"], _named(own, names, keep)))
    return made


def named_cells(rows: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """``keep..., position, name, value``: each cell under its own table's header, however many layouts there are."""
    cells = rows.select(*keep, "header", F.posexplode("cells").alias("at", "cell"))
    name = F.coalesce(blank_to_null(F.get("header", F.col("at"))), F.concat(F.lit("column_"), (F.col("at") + 1).cast("string")))
    return cells.select(*keep, (F.col("at") + 1).alias("position"), name.alias("name"), blank_to_null(F.col("cell")).alias("value"))

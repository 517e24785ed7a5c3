"""Tables and sheets of several layouts keep their own names."""

from __future__ import annotations

import pytest

from rowsmith.plans import render
from rowsmith.sources import html_tables, workbook
from tests.conftest import rows


def page(*lines):
    return "<table>" + "".join("<tr>" + "".join(f"<{tag}>{c}" for c in cells) for tag, *cells in lines) + "</table>"


def test_tables_with_swapped_headers_keep_their_names(spark):
    pages = [
        (1, page(("th", "k", "v"), ("td", 1, 2))), (2, page(("th", "v", "k", "z"), ("td", 3, 4, 5), ("td", 6))),
        (3, page(("th", "k", "v"), ("td", 7, 8)) + page(("th", "k", "v"), ("td", 9, 10, 11))),
        (4, page(("th", "", "k"), ("td", 1, 2))), (5, page(("td", 1, 2), ("td", 3, 4))), (None, page(("th", "k", "v"), ("td", 0, 0))),
    ]
    df = spark.createDataFrame(pages, "page int, html string")
    found = html_tables.extract_tables(df, "page", header_row=False)
    made = {m.names: (m.tables, sorted(rows(m.rows), key=str)) for m in html_tables.layouts(found, "page")}
    assert {n: r for n, (_, r) in made.items()} == {
        ("k", "v"): [("0", "0"), ("1", "2"), ("7", "8")], ("v", "k", "z"): [("3", "4", "5"), ("6", None, None)],
        ("k", "v", "column_3"): [("9", "10", "11")],
        ("column_1", "k"): [("1", "2")], ("column_1", "column_2"): [("1", "2"), ("3", "4")],
    }
    with pytest.raises(ValueError, match="by layout"):
        html_tables.table_frame(found)
    cells = html_tables.named_cells(found.filter("page = 2"), ("page",))
    assert sorted(rows(cells)) == [(2, 1, "v", "3"), (2, 1, "v", "6"), (2, 2, "k", "4"), (2, 3, "z", "5")]
    assert html_tables.layouts(found.filter("page = 99"), "page") == []


def cell(v):
    return f"<c><v>{v}</v></c>" if isinstance(v, (int, float)) else f'<c t="inlineStr"><is><t>{v}</t></is></c>'


def book(*lines):
    return bytearray(render._pack_workbooks(["".join("<row>" + "".join(map(cell, line)) + "</row>" for line in lines)], [""]).iloc[0])


def test_books_with_swapped_columns_keep_their_names(spark):
    books = [
        ("a", book(("k", "v"), (1, "x"), (2, "y"))), ("b", book(("v", "k"), ("z", 3))), ("c", book(("k", "v"), (4.5, "w"))),
        ("d", book(("k", "v"), (5, "u", "more"))),
    ]
    found = workbook.workbook_rows(spark.createDataFrame(books, "path string, content binary"))
    made = {m.names: m for m in workbook.sheet_layouts(found)}
    assert {n: sorted(rows(m.rows.drop("row_no")), key=str) for n, m in made.items()} == {
        ("k", "v"): [("a", "1", "x"), ("a", "2", "y"), ("c", "4.5", "w")], ("v", "k"): [("b", "z", "3")],
        ("k", "v", "column_3"): [("d", "5", "u", "more")],
    }
    assert made["k", "v"].types == {"k": "FLOAT64", "v": "TEXT"} and made["v", "k"].types == {"v": "TEXT", "k": "INTEGER"}
    assert made["k", "v"].books == 2
    with pytest.raises(ValueError, match="by layout"):
        workbook.sheet_header(found, "Data")

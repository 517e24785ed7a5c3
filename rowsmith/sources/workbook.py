"""Workbooks (.xlsx) as sheet rows and cells, and sheets as typed tables.

A workbook is a ZIP of XML parts, bounded by the format at about a million rows per
sheet; each one is opened on an executor and streamed row by row. A row arrives with all
its cells, so sheets become columns by projection, without a shuffle.
"""

from __future__ import annotations

import datetime as dt
import io
import re
import zipfile
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rowsmith.session import kept, small_batches

ROW_SCHEMA = (
    "book string, sheet string, first_row int, row_no int, col_nos array<int>,"
    " kinds array<string>, values array<string>, formulas array<string>"
)
_ROWS = pa.schema([
    ("book", pa.string()), ("sheet", pa.string()), ("first_row", pa.int32()), ("row_no", pa.int32()), ("col_nos", pa.list_(pa.int32())),
    ("kinds", pa.list_(pa.string())), ("values", pa.list_(pa.string())), ("formulas", pa.list_(pa.string())),
])
ROWS_PER_BATCH = 2_000

MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
REL = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"
# The built-in number formats that are dates, and those that are clocks.
DATE_FORMATS = {14, 15, 16, 17, 22}
CLOCK_FORMATS = {18, 19, 20, 21, 45, 46, 47}
EPOCH = dt.datetime(1899, 12, 30)
INTEGER = re.compile(r"[+-]?\d+")
CELL, FORMULA, VALUE, TEXT, ROW = (MAIN + name for name in ("c", "f", "v", "t", "row"))


def _column_number(reference: str) -> int:
    number = 0
    for letter in reference:
        if not letter.isalpha():
            break
        number = number * 26 + ord(letter.upper()) - 64
    return number


def _format_kinds(archive: zipfile.ZipFile) -> list[str]:
    """Per cell style: ``date``, ``time`` or ``number``."""
    if "xl/styles.xml" not in archive.namelist():
        return []
    root = ElementTree.fromstring(archive.read("xl/styles.xml"))
    custom = {
        int(f.get("numFmtId")): re.sub(r'"[^"]*"|\[[^\]]*\]', "", f.get("formatCode", "")).lower()
        for f in root.iter(f"{MAIN}numFmt")
    }
    kinds = []
    for style in root.findall(f"{MAIN}cellXfs/{MAIN}xf"):
        number = int(style.get("numFmtId", "0"))
        code = custom.get(number, "")
        if number in DATE_FORMATS or re.search("[yd]", code):
            kinds.append("date")
        elif number in CLOCK_FORMATS or re.search("[hs]", code):
            kinds.append("time")
        else:
            kinds.append("number")
    return kinds


def _shared_strings(archive: zipfile.ZipFile) -> list[str]:
    if "xl/sharedStrings.xml" not in archive.namelist():
        return []
    root = ElementTree.fromstring(archive.read("xl/sharedStrings.xml"))
    return ["".join(t.text or "" for t in item.iter(f"{MAIN}t")) for item in root]


def _sheet_parts(archive: zipfile.ZipFile) -> list[tuple[str, str]]:
    links = {
        link.get("Id"): link.get("Target")
        for link in ElementTree.fromstring(archive.read("xl/_rels/workbook.xml.rels"))
    }
    book = ElementTree.fromstring(archive.read("xl/workbook.xml"))
    parts = []
    for sheet in book.iter(f"{MAIN}sheet"):
        target = links[sheet.get(f"{REL}id")]
        path = target.lstrip("/") if target.startswith("/") else f"xl/{target}"
        parts.append((sheet.get("name"), path))
    return parts


def _fraction(ms: int) -> str:
    return f".{ms:03d}" if ms else ""


#: What a task has read of dates and clocks; a plain dictionary, as cached functions don't travel with the plan.
_CLOCKS: dict[tuple[str, str], tuple[str, str]] = {}


def _clock_cell(text: str, kind: str) -> tuple[str, str]:
    if kind == "date":
        at = EPOCH + dt.timedelta(days=float(text))
        # Day fractions hold a moment to about a millisecond.
        ms = (at.microsecond + 500) // 1000
        at = at.replace(microsecond=0) + dt.timedelta(milliseconds=ms)
        return "datetime", at.strftime("%Y-%m-%d %H:%M:%S") + _fraction(at.microsecond // 1000)
    ms = round(float(text) * 86_400_000)
    if float(text) < 1:
        ms = min(ms, 86_399_999)
    seconds = ms // 1000
    return "time", f"{seconds // 3600:02d}:{seconds // 60 % 60:02d}:{seconds % 60:02d}" + _fraction(ms % 1000)


def _number_cell(text: str, kind: str) -> tuple[str, str]:
    if kind != "number":
        if (text, kind) not in _CLOCKS:
            if len(_CLOCKS) >= 50_000:
                _CLOCKS.clear()
            _CLOCKS[text, kind] = _clock_cell(text, kind)
        return _CLOCKS[text, kind]
    return ("int" if INTEGER.fullmatch(text) else "double"), text


def _cell(element, strings: list[str], formats: list[str]):
    """``kind, value, formula`` of one ``<c>`` element, or None where it is empty."""
    kind = element.get("t")
    # What a cell holds, by name; the first of equal names counts.
    formula = element.find(FORMULA)
    if formula is not None and formula.text:
        return "formula", None, "=" + formula.text.removeprefix("=")
    if kind == "inlineStr":
        return "text", "".join(t.text or "" for t in element.iter(TEXT)), None
    value = element.findtext(VALUE)
    if value is None:
        return None
    if kind == "s":
        return "text", strings[int(value)], None
    if kind == "b":
        return "bool", "true" if value == "1" else "false", None
    if kind in ("str", "e"):
        return "text", value, None
    style = int(element.get("s", "0"))
    kind, text = _number_cell(value, formats[style] if style < len(formats) else "number")
    return kind, text, None


def _book_rows(book: str, content: bytes) -> Iterator[tuple]:
    with zipfile.ZipFile(io.BytesIO(content)) as archive:
        strings, formats = _shared_strings(archive), _format_kinds(archive)
        for sheet, path in _sheet_parts(archive):
            with archive.open(path) as part:
                row_no, first_row = 0, None
                for _, element in ElementTree.iterparse(part):
                    if element.tag != ROW:
                        continue
                    row_no = int(element.get("r", row_no + 1))
                    cells = _row_cells(element, strings, formats)
                    element.clear()
                    if not cells:
                        continue
                    if first_row is None and any((c[3] or c[2]).strip() for c in cells):
                        first_row = row_no
                    yield (book, sheet, first_row, row_no, *map(list, zip(*cells)))


def _row_cells(row, strings: list[str], formats: list[str]) -> list[tuple]:
    """``col_no, kind, value, formula`` of the cells that are not empty."""
    cells, col_no = [], 0
    for element in row.iter(CELL):
        reference = element.get("r")
        col_no = (_column_number(reference) if reference else 0) or col_no + 1
        cell = _cell(element, strings, formats)
        if cell is not None:
            cells.append((col_no, *cell))
    return cells


def _scan_books(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    rows = []
    for batch in batches:
        for book, content in zip(batch.column("path"), batch.column("content")):
            for row in _book_rows(book.as_py(), content.as_py()):
                rows.append(row)
                if len(rows) == ROWS_PER_BATCH:
                    yield _row_batch(rows)
                    rows = []
    if rows:
        yield _row_batch(rows)


def _row_batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = [pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _ROWS, strict=True)]
    return pa.RecordBatch.from_arrays(columns, schema=_ROWS)


def workbook_rows(books: DataFrame) -> DataFrame:
    """The filled rows of (path, content) workbooks, see ``ROW_SCHEMA``.

    ``first_row`` is the row that opens the sheet: the first with a cell that is not blank.
    Rows above it have none.
    """
    files = books.select(F.col("path").cast("string").alias("path"), F.col("content").cast("binary").alias("content"))
    return small_batches(files).mapInArrow(_scan_books, ROW_SCHEMA)


def workbook_cells(rows: DataFrame, *keep: str) -> DataFrame:
    """``book, sheet, first_row, row_no, keep..., col_no, kind, value, formula``: one row per cell."""
    cells = F.arrays_zip("col_nos", "kinds", "values", "formulas")
    facts = ("book", "sheet", "first_row", "row_no", *keep)
    return rows.select(*facts, F.inline(cells)).toDF(*facts, "col_no", "kind", "value", "formula")


def row_text(col_no: int) -> Column:
    """What an import stores for one cell of a row; a formula is kept as its text."""
    return _text_at(F.lit(col_no))


def _text_at(col_no: Column) -> Column:
    at = (F.array_position("col_nos", col_no) - 1).cast("int")
    at = F.when(at >= 0, at)
    return F.coalesce(F.get("formulas", at), F.get("values", at))


def cell_text(kind: Column, value: Column, formula: Column) -> Column:
    """What an import stores for a cell; a formula is kept as its text."""
    return F.when(kind == "formula", formula).otherwise(value)


def unique_headers(cells: Sequence[str | None], width: int) -> list[str]:
    """Header names of a sheet: blanks become ``column_N``, the n-th repeat gets ``_n``."""
    names, seen = [], {}
    for i in range(width):
        name = (cells[i] or "").strip() if i < len(cells) else ""
        name = name or f"column_{i + 1}"
        seen[name] = seen.get(name, 0) + 1
        names.append(name if seen[name] == 1 else f"{name}_{seen[name]}")
    return names


def sheet_types(rows: DataFrame, header: bool = True) -> DataFrame:
    """``book, sheet, col_no, target_type`` by the kinds of the data cells of each column."""
    data = workbook_cells(data_rows(rows, header))
    return (
        data.groupBy("book", "sheet", "col_no")
        .agg(F.array_sort(F.collect_set(_family())).alias("families"))
        .select("book", "sheet", "col_no", type_of_families(F.col("families")).alias("target_type"))
    )


def _family() -> Column:
    """What cells of a kind have in common with others that share a column type."""
    return (
        F.when(F.col("kind").isin("date", "datetime"), "timestamp")
        .when(F.col("kind").isin("time", "text", "formula"), "text")
        .otherwise(F.col("kind"))
    )


def type_of_families(families: Column) -> Column:
    """The type lattice: one family keeps its type, int with double is FLOAT64, else TEXT."""
    only = F.when(F.size(families) == 1, families[0])
    return (
        F.when(only == "bool", "BOOLEAN")
        .when(only == "int", "INTEGER")
        .when(only == "double", "FLOAT64")
        .when(only == "timestamp", "TIMESTAMP")
        .when(families == F.array(F.lit("double"), F.lit("int")), "FLOAT64")
        .otherwise("TEXT")
    )


def data_rows(rows: DataFrame, header: bool = True) -> DataFrame:
    """Rows below the header row, or from the first row on without a header."""
    return rows.filter(F.col("row_no") >= F.col("first_row") + (1 if header else 0))


def _header_cells(width: Column) -> Column:
    return F.transform(F.sequence(F.lit(1), width), lambda i: F.coalesce(_text_at(i), F.lit("")))


def sheet_heads(rows: DataFrame, header: bool = True) -> DataFrame:
    """``book, sheet, width, header``: one row per sheet; without a header row ``header`` is NULL."""
    widths = rows.groupBy("book", "sheet").agg(F.max(F.array_max("col_nos")).alias("width"))
    if not header:
        return widths.withColumn("header", F.lit(None).cast("array<string>"))
    opening = rows.filter("row_no = first_row").withColumnsRenamed({"book": "h_book", "sheet": "h_sheet"})
    joined = widths.join(opening, (F.col("book") == F.col("h_book")) & (F.col("sheet") == F.col("h_sheet")))
    return joined.select("book", "sheet", "width", _header_cells(F.col("width")).alias("header"))


def sheet_header(rows: DataFrame, sheet: str, header: bool = True) -> list[str]:
    """Column names of a sheet that all books have in one layout; several layouts are an error here."""
    heads = sheet_heads(rows.filter(F.col("sheet") == sheet), header)
    found = heads.groupBy("header").agg(F.max("width").alias("width")).take(2)
    if len(found) > 1:
        raise ValueError(f"books with different headers of {sheet!r}; read them by layout")
    return unique_headers(found[0]["header"] or (), found[0]["width"]) if found else []


@dataclass(frozen=True)
class SheetLayout:
    """All sheets of one name, header and width: column names, types by the kinds of their cells, and rows as text."""

    sheet: str
    names: tuple[str, ...]
    types: dict[str, str]
    books: int
    rows: DataFrame


def sheet_layouts(rows: DataFrame, header: bool = True) -> list[SheetLayout]:
    """The catalogue of sheet layouts of all books; books whose header differs keep their own names.

    ``rows`` are scanned once and written; one row per layout and column comes to the driver.
    """
    rows = kept(rows, "sheets")
    heads = sheet_heads(rows, header).withColumn("layout", F.xxhash64("sheet", "width", "header"))
    named = heads.withColumnsRenamed({"book": "h_book", "sheet": "h_sheet"})
    found = rows.join(named, (F.col("book") == F.col("h_book")) & (F.col("sheet") == F.col("h_sheet"))).drop("h_book", "h_sheet")
    found = kept(found, "layouts")
    catalogue = found.groupBy("layout", "sheet").agg(
        F.first("header").alias("header"), F.first("width").alias("width"), F.count_distinct("book").alias("books")
    )
    families = workbook_cells(data_rows(found, header), "layout").groupBy("layout", "col_no").agg(
        F.array_sort(F.collect_set(_family())).alias("families")
    )
    types: dict[int, dict[int, str]] = {}
    for row in families.select("layout", "col_no", type_of_families(F.col("families")).alias("type")).collect():
        types.setdefault(row["layout"], {})[row["col_no"]] = row["type"]
    made = []
    for row in catalogue.orderBy("sheet", F.desc("books"), "layout").collect():
        names = unique_headers(row["header"] or (), row["width"])
        own = types.get(row["layout"], {})
        made.append(SheetLayout(
            row["sheet"], tuple(names), {n: own.get(i, "TEXT") for i, n in enumerate(names, 1)}, row["books"],
            sheet_rows(found.filter(F.col("layout") == row["layout"]), row["sheet"], names, header),
        ))
    return made


def sheet_rows(
    rows: DataFrame, sheet: str, names: Sequence[str], header: bool = True
) -> DataFrame:
    """The rows of a sheet as text columns; blank rows are gone. One projection."""
    own = data_rows(rows.filter(F.col("sheet") == sheet), header)
    filled = F.exists("values", lambda v: F.trim(v) != "") | F.exists(
        "formulas", lambda f: f.isNotNull()
    )
    return own.filter(F.coalesce(filled, F.lit(False))).select(
        "book", "row_no", *[row_text(i).alias(name) for i, name in enumerate(names, 1)]
    )

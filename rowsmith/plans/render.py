"""Turn table rows into the raw text and bytes that the sources read back.

Every document is made from one row, so rendering needs no grouping.
"""

from __future__ import annotations

import gzip
import io
import sqlite3
import zipfile

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from rowsmith.operators.sinks import csv_line


def text_columns(df: DataFrame) -> DataFrame:
    """Every column as text, as a reader of untyped files would see it."""
    return df.select(*[F.col(c).cast("string").alias(c) for c in df.columns])


def lines_of(df: DataFrame, delimiter: str = ",") -> DataFrame:
    return df.select(csv_line(df, delimiter).alias("line"))


def xml_text(value: Column) -> Column:
    text = value.cast("string")
    for plain, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        text = F.replace(text, F.lit(plain), F.lit(entity))
    return text


def xml_element(name: str, *content: Column, **attributes: Column) -> Column:
    marks = [F.concat(F.lit(f' {k}="'), xml_text(v), F.lit('"')) for k, v in attributes.items()]
    return F.concat(F.lit(f"<{name}"), *marks, F.lit(">"), *content, F.lit(f"</{name}>"))


def xml_list(name: str, items: Column) -> Column:
    elements = F.transform(items, lambda item: xml_element(name, xml_text(item)))
    return F.array_join(elements, "")


def sql_text(value: Column) -> Column:
    """A quoted SQL literal with backslash escapes; NULL stays NULL."""
    text = value.cast("string")
    for plain, escaped in (("\\", "\\\\"), ("'", "\\'"), ("\n", "\\n"), ("\r", "\\r")):
        text = F.replace(text, F.lit(plain), F.lit(escaped))
    return F.coalesce(F.concat(F.lit("'"), text, F.lit("'")), F.lit("NULL"))


def sql_tuple(*literals: Column) -> Column:
    return F.concat(F.lit("("), F.concat_ws(", ", *literals), F.lit(")"))


def text_lines(text: str = "text") -> Column:
    return F.split(F.col(text), "\n")


def _zip_pair(names: pd.Series, contents: pd.Series) -> pd.Series:
    packed = []
    for name, content in zip(names, contents):
        buffer = io.BytesIO()
        with zipfile.ZipFile(buffer, "w", zipfile.ZIP_DEFLATED) as archive:
            archive.writestr(name, content)
            archive.writestr("notes.unrecognised", "left out")
        packed.append(buffer.getvalue())
    return pd.Series(packed)


def zip_bytes(name: Column, content: Column) -> Column:
    return pandas_udf(_zip_pair, "binary")(name, content)


def _gzip_all(contents: pd.Series) -> pd.Series:
    return contents.map(lambda text: gzip.compress(text.encode()))


def gzip_bytes(content: Column) -> Column:
    return pandas_udf(_gzip_all, "binary")(content)


# A minimal workbook: fixed parts of the file format around the rendered cells.
WORKBOOK_PARTS = {
    "xl/workbook.xml": (
        '<workbook xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
        ' xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"><sheets>'
        '<sheet name="Data" sheetId="1" r:id="rId1"/><sheet name="Summary" sheetId="2" r:id="rId2"/>'
        "</sheets></workbook>"
    ),
    "xl/_rels/workbook.xml.rels": (
        '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">'
        '<Relationship Id="rId1" Target="worksheets/sheet1.xml"/>'
        '<Relationship Id="rId2" Target="worksheets/sheet2.xml"/></Relationships>'
    ),
    "xl/styles.xml": (
        '<styleSheet xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main">'
        '<cellXfs><xf numFmtId="0"/><xf numFmtId="14"/></cellXfs></styleSheet>'
    ),
}
SHEET = (
    '<worksheet xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main">'
    "<sheetData>{}</sheetData></worksheet>"
)


def _pack_workbooks(data: pd.Series, summary: pd.Series) -> pd.Series:
    packed = []
    for sheet_1, sheet_2 in zip(data, summary):
        buffer = io.BytesIO()
        with zipfile.ZipFile(buffer, "w", zipfile.ZIP_DEFLATED) as archive:
            for name, part in WORKBOOK_PARTS.items():
                archive.writestr(name, part)
            archive.writestr("xl/worksheets/sheet1.xml", SHEET.format(sheet_1))
            archive.writestr("xl/worksheets/sheet2.xml", SHEET.format(sheet_2))
        packed.append(buffer.getvalue())
    return pd.Series(packed)


def workbook_bytes(data_rows: Column, summary_rows: Column) -> Column:
    return pandas_udf(_pack_workbooks, "binary")(data_rows, summary_rows)


def sheet_row(*cells: Column) -> Column:
    return F.concat(F.lit("<row>"), *cells, F.lit("</row>"))


def text_cell(value: Column) -> Column:
    return F.concat(F.lit('<c t="inlineStr"><is><t>'), xml_text(value), F.lit("</t></is></c>"))


def number_cell(value: Column, style: int = 0) -> Column:
    return F.concat(F.lit(f'<c s="{style}"><v>'), value.cast("string"), F.lit("</v></c>"))


def bool_cell(value: Column) -> Column:
    return F.concat(F.lit('<c t="b"><v>'), value.cast("int").cast("string"), F.lit("</v></c>"))


def formula_cell(value: Column) -> Column:
    return F.concat(F.lit("<c><f>"), xml_text(value), F.lit("</f><v>0</v></c>"))


def sqlite_files(df: DataFrame, key: str, rows_per_file: int = 1000) -> DataFrame:
    """``path, content``: SQLite files with a table ``docs``; a unique integer key bounds them."""
    names = df.columns

    def pack(frame: pd.DataFrame) -> pd.DataFrame:
        connection = sqlite3.connect(":memory:")
        connection.execute("CREATE TABLE docs ({})".format(", ".join(names)))
        marks = ", ".join("?" for _ in names)
        rows = frame[names].astype(object).itertuples(index=False, name=None)
        connection.executemany(f"INSERT INTO docs VALUES ({marks})", rows)
        connection.commit()
        content = connection.serialize()
        connection.close()
        return pd.DataFrame({"path": [str(frame["file_"].iloc[0])], "content": [content]})

    chunked = df.withColumn("file_", F.floor(F.col(key) / rows_per_file))
    return chunked.groupBy("file_").applyInPandas(pack, "path string, content binary")

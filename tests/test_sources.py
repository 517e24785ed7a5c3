from __future__ import annotations

import gzip
import io
import sqlite3
import zipfile

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rowsmith.operators.coercion import coerce_columns
from rowsmith.operators.inference import infer_types
from rowsmith.plans import render
from rowsmith.sources import (
    archives,
    delimited,
    documents,
    formats,
    html_tables,
    sql_dump,
    sqlite_snapshot,
    text,
    workbook,
)
from rowsmith.sources.delimited import DelimitedOptions
from tests.conftest import rows


def read(spark, folder, content, **options):
    data = content if isinstance(content, bytes) else content.encode()
    (folder / "table.csv").write_bytes(data)
    return delimited.read_delimited(spark, str(folder), DelimitedOptions(**options))


def test_plain_csv(spark, tmp_path):
    table = read(spark, tmp_path, "id,name,\n1, Ada ,x\n\n2,,y\n")
    assert table.columns == ["id", "name", "column_3"]
    assert sorted(rows(table.rows)) == [("1", "Ada", "x"), ("2", None, "y")]
    assert infer_types(table.rows) == {"id": "INTEGER", "name": "TEXT", "column_3": "TEXT"}


def test_every_file_has_its_header(spark, tmp_path):
    for i in range(3):
        (tmp_path / f"part{i}.csv").write_text(f"a,b\n{i},x\na,b\n")
    table = delimited.read_delimited(spark, str(tmp_path))
    # Only the first record of a file is its header; later rows that look like it stay.
    assert sorted(rows(table.rows)) == [("0", "x"), ("1", "x"), ("2", "x"), ("a", "b"), ("a", "b"), ("a", "b")]


def test_quotes_and_line_ends_in_fields(spark, tmp_path):
    table = read(spark, tmp_path, 'k,v\n1,"a ""b"", c"\n2,"line 1\n\nline 3"\n3,"x"\n"4,5",q"q"q\n')
    assert sorted(rows(table.rows)) == [
        ("1", 'a "b", c'), ("2", "line 1\n\nline 3"), ("3", "x"), ("4,5", "qqq"),
    ]


def test_quoted_records_across_file_blocks(spark, tmp_path):
    body = "".join(f'{i},"first {i}\nsecond, ""{i}""\n",{"z" * 50}\n' for i in range(400))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "3000")
    try:
        table = read(spark, tmp_path, "k,v,z\n" + body)
        assert text.raw_lines(spark, str(tmp_path)).select("block").distinct().count() > 3
        out = {r["k"]: r["v"] for r in table.rows.collect()}
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert out == {str(i): f'first {i}\nsecond, "{i}"' for i in range(400)}


def test_separate_escape_character(texts):
    options = DelimitedOptions(escape="\\")
    # The escape character only matters before a quote.
    cut = texts('1,"a \\"b\\" ""c"" \\x",d', name="line").select(
        delimited.split_fields(F.col("line"), options).alias("f")
    )
    assert cut.first()["f"] == ["1", 'a "b" "c" \\x', "d"]


@pytest.mark.parametrize("delimiter", ["|", ";", "\t", "||", "."])
def test_other_delimiters(texts, delimiter):
    line = delimiter.join(["a", f'"x{delimiter}y"', ""])
    cut = texts(line, name="line").select(
        delimited.split_fields(F.col("line"), DelimitedOptions(delimiter)).alias("f")
    )
    assert cut.first()["f"] == ["a", f"x{delimiter}y", ""]


def test_ragged_rows(spark, tmp_path):
    content = "a,b\n1\n2,3,4\n5,6\n"
    padded = read(spark, tmp_path, content)
    assert sorted(rows(padded.rows), key=str) == [("1", None, None), ("2", "3", "4"), ("5", "6", None)]
    skipping = read(spark, tmp_path, content, malformed="skip")
    assert rows(skipping.rows) == [("2", "3", "4")]
    assert skipping.skipped_rows == 2


def test_headerless_and_sniffed(spark, tmp_path):
    table = read(spark, tmp_path, "1;x\n2;y\n", delimiter="", header=False)
    assert table.delimiter == ";"
    assert table.columns == ["column_1", "column_2"]
    assert sorted(rows(table.rows)) == [("1", "x"), ("2", "y")]


def test_latin1_file_next_to_utf8(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes("k,v\n1,Zoë\n2,plain\n".encode("latin-1"))
    (tmp_path / "b.csv").write_bytes("k,v\n3,Zoë\n4,日本\n".encode())
    table = delimited.read_delimited(spark, str(tmp_path))
    assert sorted(rows(table.rows)) == [("1", "Zoë"), ("2", "plain"), ("3", "Zoë"), ("4", "日本")]


def test_gzip_file(spark, tmp_path):
    (tmp_path / "a.csv.gz").write_bytes(gzip.compress(b"k,v\n1,x\n"))
    assert rows(delimited.read_delimited(spark, str(tmp_path)).rows) == [("1", "x")]


def test_sniffing_prefers_consistency_then_order(spark):
    lines = spark.createDataFrame(
        [("s1", i, "a,b;c" if i % 2 else "a;b") for i in range(12)]
        + [("s2", 0, "a,b;c")] + [("s3", 0, "word")],
        "source string, line_no int, line string",
    )
    out = {r["source"]: (r["delimiter"], r["score"]) for r in delimited.sniff_delimiter(lines).collect()}
    assert out == {"s1": (";", 110), "s2": (",", 101), "s3": (",", -1)}


def test_zip_and_gzip_wrappers(spark):
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w") as archive:
        archive.writestr("in/a.CSV", "k\n1\n")
        archive.writestr("b.bin", "?")
    df = spark.createDataFrame([("x.zip", bytearray(buffer.getvalue()))], "path string, content binary")
    member = archives.zip_members(df).first()
    assert (member["member"], member["format"]["format_key"]) == ("in/a.CSV", "csv")
    packed = spark.createDataFrame([("/d/t.json.gz", bytearray(gzip.compress(b"[1]")))], "path string, content binary")
    inner = archives.gzip_candidates(packed).select("member", archives.gunzip(F.col("content")).cast("string"))
    assert rows(inner) == [("t.json", "[1]")]


def test_format_detection(texts):
    df = texts("/a/b.tar.gz", "x.JSONL", ".csv", "http://h.example/p.html?x=1", "q.sqlite3", "none")
    found = [r[0] for r in df.select(formats.detect_format(F.col("v"))["format_key"]).collect()]
    assert found == ["gzipArchive", "ndjson", "unknown", "unknown", "sqlite", "unknown"]
    assert formats.format_of_name("d/x.sql") == "sqlDump"
    assert len(formats.FORMATS) == 31


def test_html_tables(spark):
    page = """
      <h1>t</h1><table id=one><caption> First </caption><tr><th>A<th>B
      <tr><td>1<td>2<tr><td>3</td></tr></table>
      <table><tr><td>p</td><td>q</td></tr><tr><td>outer<table><tr><td>inner</td></tr></table></td>
      <td>5 &amp; 6</td><td>extra</td></tr></table><table><tr><th>only header</th></tr></table>
    """
    df = spark.createDataFrame([("k", page)], "k string, html string")
    found = html_tables.extract_tables(df, "k")
    assert sorted(rows(found.select("table_no", "caption", "table_id", "has_nested", "cells", "header"))) == [
        (1, "First", "one", False, ["1", "2"], ["A", "B"]),
        (1, "First", "one", False, ["3"], ["A", "B"]),
        (2, None, None, True, ["outerinner", "5 & 6", "extra"], ["p", "q"]),
    ]
    first = html_tables.table_frame(found.filter("table_no = 1"))
    assert sorted(rows(first), key=str) == [("1", "2"), ("3", None)]
    bare = html_tables.extract_tables(df, "k", header_row=False).filter("table_no = 2")
    assert sorted(rows(html_tables.table_frame(bare)))[1] == ("p", "q", None)


def test_dump(spark, tmp_path):
    dump = r"""
-- a dump; with 'quotes' in a comment
CREATE TABLE IF NOT EXISTS `shop`.`items` (
  `id` int NOT NULL, `label` varchar(20) DEFAULT 'a,b', price decimal(8,2) UNIQUE,
  day date, PRIMARY KEY (`id`), UNIQUE KEY u (`label`), KEY k (`day`)
);
INSERT INTO items VALUES (1, 'it''s; \'ok\'\n', 1.50, '2030-01-02'), (2, NULL, -2e1, NULL);
INSERT INTO items (label, id) VALUES ('only (two)', 3);
INSERT INTO items (id, label) VALUES (4);
INSERT INTO items SELECT * FROM other;
# note
SET names utf8;
CREATE VIEW v AS SELECT 1;
"""
    (tmp_path / "d.sql").write_text(dump)
    statements = sql_dump.read_statements(spark, str(tmp_path))
    columns = sql_dump.dump_columns(statements).orderBy("source_index")
    assert rows(columns.select("column_name", "target_type", "not_null", "primary_key", "unique")) == [
        ("id", "INTEGER", True, True, False),
        ("label", "TEXT", False, False, True),
        ("price", "DECIMAL(8,2)", False, False, True),
        ("day", "TIMESTAMP", False, False, False),
    ]
    loaded = sql_dump.dump_rows(sql_dump.insert_rows(statements), "items", ["id", "label", "price", "day"])
    assert sorted(rows(loaded)) == [
        ("1", "it's; 'ok'\n", "1.50", "2030-01-02"),
        ("2", None, "-2e1", None),
        ("3", "only (two)", None, None),
    ]
    skipped = sql_dump.skipped_statements(statements)
    assert sorted(r["kind"] for r in skipped.collect()) == ["CREATE VIEW", "INSERT", "INSERT", "SET"]


def test_dump_with_statement_ends_inside_text(spark, tmp_path):
    (tmp_path / "d.sql").write_text("INSERT INTO t VALUES ('a;\nb');\nINSERT INTO t VALUES ('c');\n")
    statements = sql_dump.read_statements(spark, str(tmp_path))
    loaded = sql_dump.dump_rows(sql_dump.insert_rows(statements), "t", ["v"])
    assert sorted(rows(loaded)) == [("a;\nb",), ("c",)]


def test_dump_literals(texts):
    cases = {
        "NULL": ("null", None), "true": ("bool", "true"), "0xABC": ("bytes", "0ABC"), "X'01'": ("bytes", "01"),
        "b'101'": ("int", "5"), "'a\\tb'": ("string", "a\tb"), '"q""q"': ("string", 'q"q'),
        "-12": ("int", "-12"), "1.5e3": ("double", "1.5e3"), "now()": ("raw", "now()"), "'\\\\n'": ("string", "\\n"),
    }
    out = texts(*cases).select(
        "v", sql_dump.literal_kind(F.col("v")).alias("k"), sql_dump.literal_text(F.col("v")).alias("t")
    )
    assert {r["v"]: (r["k"], r["t"]) for r in out.collect()} == cases


def make_book(data, summary="") -> bytes:
    return render._pack_workbooks([data], [summary]).iloc[0]


def test_workbook(spark):
    data = (
        '<row r="2"><c r="A2" t="inlineStr"><is><t>n</t></is></c><c r="C2" t="inlineStr"><is><t>n</t></is></c></row>'
        '<row r="4"><c r="A4"><v>1</v></c><c r="B4"><v>2.5</v></c><c r="C4" s="1"><v>45000.5</v></c></row>'
        '<row r="5"><c r="A5"><v>1.5</v></c><c r="B5"><f>A4*2</f><v>3</v></c><c r="C5" t="b"><v>1</v></c></row>'
        '<row r="6"><c r="A6" t="str"><v> </v></c></row>'
    )
    books = spark.createDataFrame([("b", bytearray(make_book(data)))], "path string, content binary")
    cells = workbook.workbook_rows(books)
    assert workbook.sheet_header(cells, "Data") == ["n", "column_2", "n_2"]
    out = workbook.sheet_rows(cells, "Data", ["n", "column_2", "n_2"]).drop("book").orderBy("row_no")
    assert rows(out) == [(4, "1", "2.5", "2023-03-15 12:00:00"), (5, "1.5", "=A4*2", "true")]
    types = {r["col_no"]: r["target_type"] for r in workbook.sheet_types(cells).collect()}
    assert types == {1: "TEXT", 2: "TEXT", 3: "TEXT"}


def test_type_lattice(spark):
    cases = [["int"], ["double", "int"], ["bool", "int"], ["timestamp"], ["text"], ["bool"], []]
    df = spark.createDataFrame([(sorted(c),) for c in cases], "f array<string>")
    out = [r[0] for r in df.select(workbook.type_of_families(F.col("f"))).collect()]
    assert out == ["INTEGER", "FLOAT64", "TEXT", "TIMESTAMP", "TEXT", "BOOLEAN", "TEXT"]


def test_sqlite_file(spark, tmp_path):
    path = str(tmp_path / "s.db")
    with sqlite3.connect(path) as connection:
        connection.execute("CREATE TABLE t (id INTEGER PRIMARY KEY, v TEXT, twice INT GENERATED ALWAYS AS (id*2) STORED)")
        connection.executemany("INSERT INTO t (id, v) VALUES (?, ?)", [(i, f"v{i}") for i in range(1, 26)])
    assert sqlite_snapshot.list_tables(path) == ["t"]
    assert [name for name, _ in sqlite_snapshot.table_columns(path, "t")] == ["id", "v"]
    df = sqlite_snapshot.read_sqlite(spark, path, "t", "id bigint, v string", rows_per_partition=10)
    assert df.rdd.getNumPartitions() == 3
    assert sorted(rows(df)) == [(i, f"v{i}") for i in range(1, 26)]


def test_json_documents(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"items": [{"id": 1, "v": 1.5}, {"id": 2, "w": "x"}]}')
    df = documents.read_json(spark, str(tmp_path))
    records = documents.record_rows(df, "document")
    assert sorted(f.name for f in records.schema["record"].dataType) == ["id", "v", "w"]
    out = records.select("record.id", "record.v", "record.w")
    assert sorted(rows(out), key=str) == [(1, 1.5, None), (2, None, "x")]


def test_ndjson(spark, tmp_path):
    (tmp_path / "a.ndjson").write_text('{"id": 1, "deep": {"x": [1]}}\n\n  {"id": 2, "late": true}\n')
    df = documents.read_ndjson(spark, str(tmp_path)).select("document.id", "document.late")
    assert sorted(rows(df), key=str) == [(1, None), (2, True)]


def test_xml_names_and_records(spark, tmp_path):
    assert documents.xml_table_name("people", "person") == "persons"
    assert documents.xml_table_name("cities", "city") == "cities"
    assert documents.xml_table_name("catalog", "box") == "boxes"
    (tmp_path / "a.xml").write_text(
        '<ns:cat xmlns:ns="u"><ns:book id="1"><t>A</t></ns:book><ns:book id="2"><t>B</t><t>C</t></ns:book></ns:cat>'
    )
    schema = T.StructType.fromDDL("book array<struct<attr_id: string, t: array<string>>>")
    raw = spark.read.text(str(tmp_path), wholetext=True).withColumnRenamed("value", "doc")
    parsed = documents.parse_xml_column(raw, "doc", schema)
    name, records, _ = documents.xml_records("cat", F.col("doc"), schema)
    out = parsed.select(F.inline(records))
    assert name == "books"
    assert sorted(rows(out)) == [("1", ["A"]), ("2", ["B", "C"])]
    tagged = documents.read_xml_rows(spark, str(tmp_path), "book")
    assert sorted(r["attr_id"] for r in tagged.collect()) == [1, 2]


def test_decode_bytes(spark):
    df = spark.createDataFrame([(bytearray("é".encode()),), (bytearray(b"\xe9"),)], "b binary")
    assert [r[0] for r in df.select(text.decode_bytes(F.col("b"))).collect()] == ["é", "é"]


def test_typed_round_trip(spark, tmp_path):
    table = read(spark, tmp_path, "id,at,ok,amount\n1,2030-01-02,yes,1.5\n2,2030-01-03,no,2\n")
    typed = coerce_columns(table.rows, infer_types(table.rows))
    assert [f.dataType.simpleString() for f in typed.schema] == ["bigint", "timestamp", "boolean", "double"]
    assert typed.filter("amount IS NULL OR at IS NULL OR ok IS NULL").count() == 0


def test_blank_rows(texts):
    lines = texts("", " , ", '"",""', ',"  "', '",",', "\u00a0,", "é,", "0,", "x", name="line")
    kept = delimited.record_rows(lines).select("line")
    assert sorted(rows(kept)) == [('",",',), ("0,",), ("x",), ("é,",)]

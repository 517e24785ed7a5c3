"""What a step holds or moves must not grow faster than its input."""

from __future__ import annotations

import io
import re
import zipfile

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from rowsmith.operators import windows as W
from rowsmith.plans import render
from rowsmith.sources import archives, documents, sql_dump, workbook


def test_rows_of_a_dump_are_not_dealt_by_table_name(spark):
    texts = ["CREATE TABLE a (x int)", "INSERT INTO a VALUES (1), (2)", "INSERT INTO b VALUES (3)"]
    found = sql_dump.dump_tables(spark.createDataFrame(list(enumerate(texts)), "ordinal long, statement string"))
    assert sorted(r.x for r in found.tables["a"].collect()) == [1, 2]
    assert [r.reason for r in found.skipped.collect()] == ["Skipping INSERT for b because no supported CREATE TABLE was parsed first."]
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for df in (found.tables["a"], found.skipped, found.warnings):
            plan = df._jdf.queryExecution().sparkPlan().toString()
            assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan and "ShuffledHashJoin" not in plan
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_statements_left_out_are_found_without_making_rows():
    statement = "INSERT INTO t VALUES " + ", ".join(f"({i})" for i in range(1000))
    batch = pa.RecordBatch.from_pydict({"ordinal": [1, 2, 3], "statement": [statement, "SET  x = 1", "INSERT INTO t SELECT 1"]})
    late = list(sql_dump._skipper("statement", True)([batch]))
    assert [b.column("entry").to_pylist() for b in late] == [["insert", "skip", "skip"]]
    only = list(sql_dump._skipper("statement", False)([batch]))
    assert [b.column("ordinal").to_pylist() for b in only] == [[2, 3]]


@pytest.mark.parametrize("values", [
    "(1), (2, 'a)')", "(1, f(2))", "(1", "(1)) ", "(1) x", "", ", ,", "'a' (1)", "(1, 'a''b', \"(\", `)`),\n(2)", "('open", "(1) 'b'", "((1))", "()",
])
@pytest.mark.parametrize("columns", ["", " (a)", " (a, b)"])
def test_inserts_are_judged_alike_with_and_without_rows(values, columns):
    statement = f"INSERT INTO t{columns} VALUES {values}"
    with_rows = [e for e in sql_dump._parse(statement) if e["entry"] != "row"]
    assert list(sql_dump._parse(statement, False)) == with_rows


def test_chunks_are_cut_into_statements_once(spark):
    chunks = spark.createDataFrame([(1, "SET a; -- x;\nSET b"), (2, " ; "), (3, None)], "id long, chunk string")
    found = sql_dump.statement_rows(chunks, F.col("chunk"), "id")
    assert sorted(map(tuple, found.collect())) == [(1, 0, "SET a"), (1, 1, "SET b")]
    assert found._jdf.queryExecution().optimizedPlan().toString().count("regexp_extract_all") == 1


def test_xml_paths_read_files_piece_by_piece(spark, tmp_path):
    folder = tmp_path / "xml"
    folder.mkdir()
    rows = "".join(f'<row k="{i}">v{i}<b>\n</b>t</row>\n' for i in range(20_000))
    (folder / "a.xml").write_text(f"<rows>\n{rows}</rows>\n")
    (folder / "b.xml").write_text("<rows><row>1</row><row>2</rows>")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "100000")
    try:
        found = documents.xml_paths(spark, str(folder)).collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    trees = {(tuple(r.path), r.attribute): (r.place, r.repeats, r.has_text) for r in found if not r.error}
    assert trees == {
        (("rows",), False): (0, 1, False), (("rows", "row"), False): (1, 20_000, True),
        (("rows", "row", "k"), True): (2, 1, False), (("rows", "row", "b"), False): (3, 1, False),
    }
    assert [(r.file[-5:], r.error) for r in found if r.error] == [("b.xml", "mismatched tag: line 1, column 26")]
    # A batch is a piece of a file: the parser sees it before the next one comes.
    piece = lambda name, lines: pa.RecordBatch.from_pydict({"file": [name] * len(lines), "line": pa.array(lines, pa.binary())})
    trees = list(documents._path_trees(iter([piece("x", [b"<a><b>", b"1"]), piece("x", [b"</b></a>"]), piece("y", [b"<c/>"])])))
    assert [t.column("path").to_pylist() for t in trees] == [[["a"], ["a", "b"]], [["c"]]]


def test_members_of_archives_leave_a_task_together():
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w") as archive:
        for i in range(3):
            archive.writestr(f"{i}.csv", str(i))
    batch = pa.RecordBatch.from_pydict({"path": ["p", "q"], "content": [buffer.getvalue()] * 2})
    (found,) = archives._list_members([batch])
    assert found.column("path").to_pylist() == ["p"] * 3 + ["q"] * 3
    assert found.column("content").to_pylist() == [b"0", b"1", b"2"] * 2


def _books(spark, opened):
    def read(batches):
        for batch in batches:
            opened.add(batch.num_rows)
            yield batch

    head = render.sheet_row(render.text_cell(F.lit("a")))
    rows = spark.range(4).select(
        F.concat(F.lit("book_"), F.col("id").cast("string")).alias("path"),
        render.workbook_bytes(F.concat(head, render.sheet_row(render.number_cell(F.col("id"), style=1))), head).alias("content"),
    )
    return rows.mapInArrow(read, "path string, content binary")


def test_layouts_scan_the_books_once(spark):
    opened = spark.sparkContext.accumulator(0)
    (data,) = (layout for layout in workbook.sheet_layouts(workbook.workbook_rows(_books(spark, opened))) if layout.sheet == "Data")
    assert sorted(r.a for r in data.rows.collect())[-1] == "1900-01-02 00:00:00" and data.books == 4
    assert opened.value == 4


def test_workbooks_go_to_python_in_small_batches(spark):
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", "64m")
    rows = workbook.workbook_rows(_books(spark, spark.sparkContext.accumulator(0)))
    assert rows.count() == 12 and spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch") == "8m"


def test_range_frame_moves_no_lists_of_chunks_with_the_rows(spark):
    df = spark.range(3_000).selectExpr("id", "id % 2 AS k", "id * 7 % 101 AS v")
    framed = W.range_frame(df, ["k"], F.col("id"), 900, {"low": ("min", "v"), "top": ("max", "v"), "n": ("count", "*")}, 16)
    plan = framed._jdf.queryExecution().optimizedPlan().toString()
    assert any(re.search(r"low_lo#", line) for line in plan.splitlines())
    assert not any(re.search(r"low_lo#", line) and re.search(r"low_hi#", line) for line in plan.splitlines())
    df.createOrReplaceTempView("frames_")
    plain = spark.sql(
        "SELECT id, min(v) OVER w AS low, max(v) OVER w AS top, count(*) OVER w AS n FROM frames_"
        " WINDOW w AS (PARTITION BY k ORDER BY id RANGE BETWEEN 900 PRECEDING AND CURRENT ROW)"
    )
    assert sorted(map(tuple, framed.select("id", "low", "top", "n").collect())) == sorted(map(tuple, plain.collect()))

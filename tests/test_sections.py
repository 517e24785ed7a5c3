"""Records over line ends: cut blocks must give what one reader of the whole file gives."""

from __future__ import annotations

import csv
import io
import random
import re

import pytest
from pyspark.sql import functions as F

from rowsmith.sources import delimited, sections, sql_dump
from rowsmith.sources.delimited import DelimitedOptions
from tests.conftest import rows


@pytest.fixture()
def small_blocks(spark):
    spark.conf.set("spark.sql.files.maxPartitionBytes", "700")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    yield
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    spark.conf.unset("spark.sql.files.openCostInBytes")


def test_quoted_records_equal_one_reader(spark, tmp_path, small_blocks):
    rng = random.Random(3)
    expected = []
    for part in range(3):
        body = [[str(i), "".join(rng.choices(["a", '"', "\n", ",", "é", " x", "\n\n"], k=rng.choice((1, 4, 400)))), "z"] for i in range(60)]
        out = io.StringIO()
        writer = csv.writer(out, lineterminator="\n", quoting=csv.QUOTE_ALL)
        writer.writerow(["k", "two\nlines", "c"])
        writer.writerows(body)
        # Blank lines before the header push it into a later block of one file.
        (tmp_path / f"{part}.csv").write_bytes((("\n" * 1500 if part == 1 else "") + out.getvalue()).encode())
        expected += [(k, v.strip() or None, c) for k, v, c in body]
    table = delimited.read_delimited(spark, str(tmp_path))
    assert sections.raw_blocks(spark, str(tmp_path)).select("file", "block").distinct().count() > 12
    assert table.columns == ["k", "two_lines", "c"]
    assert sorted(rows(table.rows), key=str) == sorted(expected, key=str)
    assert table.warnings == ()


def test_records_longer_than_blocks(spark, tmp_path, small_blocks):
    long = "\n".join(f"line {i}" for i in range(900))
    (tmp_path / "a.csv").write_text(f'k,v\n1,"{long}"\n2,x\n3,"y\ny",extra,"more\n"\n')
    table = delimited.read_delimited(spark, str(tmp_path))
    assert sorted(rows(table.rows), key=str) == [("1", long, None, None), ("2", "x", None, None), ("3", "y\ny", "extra", "more")]


@pytest.mark.parametrize("content", ['k,v\n1,"a\nb"\n2,"open\n3,c\n', 'k,v\n1,x\n2,"open'])
def test_a_quote_left_open_is_reported(spark, tmp_path, content):
    (tmp_path / "a.csv").write_text(content)
    table = delimited.read_delimited(spark, str(tmp_path))
    assert table.warnings == ("1 file(s) end inside a quoted field",)
    assert table.rows.filter("k = 1").count() == 1


def test_latin1_is_reported(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes('k,v\n1,"é\né"\n'.encode("latin-1"))
    (tmp_path / "b.csv").write_bytes('k,v\n2,"é\né"\n'.encode())
    table = delimited.read_delimited(spark, str(tmp_path))
    assert sorted(rows(table.rows)) == [("1", "é\né"), ("2", "é\né")]
    assert table.warnings == ("1 file(s) are not UTF-8 and were read as Latin-1",)


def test_no_header_keeps_every_record(spark, tmp_path, small_blocks):
    (tmp_path / "a.csv").write_text('"1\n1",a\n' + '2,"b\nb"\n' * 200)
    table = delimited.read_delimited(spark, str(tmp_path), DelimitedOptions(header=False))
    assert sorted(rows(table.rows)) == [("1\n1", "a")] + [("2", "b\nb")] * 200


def test_text_is_not_shuffled(spark, tmp_path, small_blocks):
    (tmp_path / "a.csv").write_text("k,v\n" + '1,"a\nb"\n' * 400)
    table = delimited.read_delimited(spark, str(tmp_path))
    plan = table.rows._jdf.queryExecution().executedPlan().toString()
    # Only the fragments, a written table, meet in exchanges.
    assert "FileScan text" in plan
    for scan in re.findall(r"Exchange(?:(?!Exchange|Union).)*FileScan (\w+)", plan, re.S):
        assert scan == "parquet"
    assert table.rows.count() == 400


def test_widths_equal_the_cut_fields(spark):
    rng = random.Random(9)
    for options in (DelimitedOptions(), DelimitedOptions(escape="\\"), DelimitedOptions("||"), DelimitedOptions("\t")):
        automaton = sections.QuotedFields(options.delimiter, options.quote, options.escape)
        lines = ["".join(rng.choices([options.delimiter, '"', "a", "\\", " ", '""', '\\"', "é"], k=rng.randrange(1, 14))) for _ in range(600)]
        df = spark.createDataFrame([(x,) for x in lines], "line string")
        cut = {r["line"]: len(r["fields"]) for r in delimited.record_rows(df, options).collect()}
        for line in lines:
            if automaton.width(line.encode()):
                assert automaton.width(line.encode()) == cut[line], (options, line)


PIECES = [
    "INSERT INTO t VALUES ({i}, 'a;\nb');\n", "INSERT INTO t\nVALUES ({i}, 'it''s \\' ; ')\n;\n", "/* no;\n'end */\n", "-- it's; not\n",
    "# \"quoted;\n", "INSERT INTO t VALUES ({i}, \"x`\n;\"); INSERT INTO t VALUES ({i}, `;\n`);\r\n", "SET a = 1;\n", "\n  \n",
    "INSERT INTO t VALUES ({i}, 'long " + "line;\n" * 300 + "'); -- done;\n",
]


def test_dump_lines_equal_one_reader(spark, tmp_path, small_blocks):
    rng = random.Random(5)
    expected = []
    for name in ("a.sql", "b.sql"):
        content = "".join(rng.choice(PIECES).replace("{i}", str(i)) for i in range(120)) + "INSERT INTO t VALUES (0, 'last')"
        (tmp_path / name).write_bytes(content.encode())
        whole = spark.createDataFrame([(content,)], "c string").select(F.explode(sql_dump.split_statements(F.col("c"))))
        expected += [(name, r[0]) for r in whole.collect()]
    found = sql_dump.read_statements(spark, str(tmp_path))
    assert found.select("file", "ordinal.block").distinct().count() > 10
    ordered = found.orderBy("file", "ordinal").select(F.element_at(F.split("file", "/"), -1), "statement")
    assert rows(ordered) == expected


def test_tuples_nest_to_any_depth(spark):
    for depth in (1, 14, 100, 3000):
        deep = "(" * depth + "')', 1" + ")" * depth
        statement = f"INSERT INTO t (`a`, b, c) VALUES (1, {deep}, 'x(') , (2, NULL, f(g(',')))"
        df = spark.createDataFrame([(0, statement)], "ordinal int, statement string")
        found = [tuple(v.strip() for v in r["tokens"]) for r in sql_dump.insert_rows(df).orderBy("row_no").collect()]
        assert found == [("1", deep, "'x('"), ("2", "NULL", "f(g(','))")]
        assert sql_dump.skipped_statements(df).count() == 0


def test_brackets_that_do_not_close_are_reported(spark):
    texts = ["INSERT INTO t VALUES (1, (2)", "INSERT INTO t VALUES (1))", "INSERT INTO t VALUES (1) ON DUPLICATE KEY UPDATE a = 1", "INSERT INTO t VALUES (1) 'x'"]
    df = spark.createDataFrame(list(enumerate(texts)), "ordinal int, statement string")
    assert sql_dump.insert_rows(df).count() == 0
    assert {r["reason"] for r in sql_dump.skipped_statements(df).collect()} == {"Unsupported INSERT row syntax."}


def test_tables_of_a_dump_are_parsed_once(spark, tmp_path):
    text = "".join(f"CREATE TABLE t{i} (a INT, b VARCHAR(9), CHECK (a > ((1))));\nINSERT INTO t{i} VALUES ({i}, 'x', 3), (9, 'y', 4);\n" for i in range(4))
    (tmp_path / "d.sql").write_text(text)
    found = sql_dump.dump_tables(sql_dump.read_statements(spark, str(tmp_path)))
    assert sorted(found.tables) == ["t0", "t1", "t2", "t3"]
    for i in range(4):
        assert sorted(rows(found.tables[f"t{i}"])) == [(i, "x"), (9, "y")]
        plan = found.tables[f"t{i}"]._jdf.queryExecution().executedPlan().toString()
        assert "FileScan text" not in plan and "MapInArrow" not in plan
        assert f"(table_name#" in plan and f"= t{i})" in plan
    # A third value has no column to go to.
    assert sorted(rows(found.warnings.select("table_name", "rows"))) == [(f"t{i}", 2) for i in range(4)]

"""Rows that readers and operators once lost, invented or changed."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from rowsmith.operators import loads, reshape, windows
from rowsmith.operators.inference import refine_types
from rowsmith.operators.workbook_formulas import SUMMARY_FORMULA
from rowsmith.sources import delimited, documents, sql_dump, workbook
from rowsmith.streaming import paging


def statements(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "ordinal int, statement string")


def tuples(spark, *texts):
    return [tuple(r["tokens"]) for r in sql_dump.insert_rows(statements(spark, *texts)).orderBy("ordinal", "row_no").collect()]


def reasons(spark, *texts):
    made = statements(spark, *texts)
    found = sql_dump.skipped_statements(made, created=sql_dump.created_tables(made)).orderBy("ordinal").collect()
    return [(r["ordinal"], r["kind"], r["reason"]) for r in found]


def test_control_characters_stay_in_csv(spark, tmp_path):
    (tmp_path / "a.csv").write_text("a,b\n1,aa\x01bb\n2,c\x02\n")
    found = delimited.read_delimited(spark, str(tmp_path)).rows.orderBy("a").collect()
    assert [tuple(r) for r in found] == [("1", "aa\x01bb"), ("2", "c\x02")]


def test_empty_first_file_and_other_headers(spark, tmp_path):
    (tmp_path / "a.csv").write_text("")
    (tmp_path / "b.csv").write_text("k,v\n1,x\n")
    (tmp_path / "c.csv").write_text("k,v\n2,y\n")
    found = delimited.read_delimited(spark, str(tmp_path))
    assert found.columns == ["k", "v"]
    assert sorted(tuple(r) for r in found.rows.collect()) == [("1", "x"), ("2", "y")]
    (tmp_path / "d.csv").write_text("v,k\ny,2\n")
    with pytest.raises(ValueError, match="different headers"):
        delimited.read_delimited(spark, str(tmp_path))
    (tmp_path / "c.csv").write_text('k,v\n2,"y\nz"\n')
    with pytest.raises(ValueError, match="different headers"):
        delimited.read_delimited(spark, str(tmp_path))


def test_nested_tuples_are_whole(spark):
    assert tuples(spark, "INSERT INTO t VALUES (1,f(f(f(f(f(2))))))") == [("1", "f(f(f(f(f(2)))))")]


def test_nothing_but_tuples_makes_rows(spark):
    odd = "INSERT INTO t VALUES (1,'a') ON DUPLICATE KEY UPDATE a=VALUES(a)"
    assert tuples(spark, odd, "INSERT INTO t VALUES (2,'b') , (3,'c')") == [("2", "'b'"), ("3", "'c'")]
    assert reasons(spark, "CREATE TABLE t (a INT, b TEXT)", odd) == [(1, "INSERT", "Unsupported INSERT row syntax.")]


def test_all_reasons_of_skipping(spark):
    assert reasons(
        spark,
        "INSERT INTO t VALUES (1)",
        "CREATE" + " " * 70 + "TABLE t (a INT)",
        "INSERT INTO t (a, b) VALUES (1)",
        "INSERT INTO t VALUES (1)",
        "DROP  TABLE x",
        "SELECT\n1",
        "INSERT INTO u SELECT 1",
    ) == [
        (0, "INSERT", "Skipping INSERT for t because no supported CREATE TABLE was parsed first."),
        (2, "INSERT", "Skipping INSERT for t because the explicit column list does not match row width."),
        (4, "DROP TABLE", "Skipping unsupported DROP TABLE statement."),
        (5, "SELECT", "Skipping unsupported SELECT statement."),
        (6, "INSERT", "Only INSERT ... VALUES statements are supported."),
    ]


def test_dump_to_typed_tables(spark):
    found = sql_dump.dump_tables(
        statements(
            spark,
            "CREATE TABLE `a` (`id` int(11) NOT NULL, `name` varchar(20), PRIMARY KEY (`id`))",
            "INSERT INTO a VALUES (1,'x'),(2,NULL)",
            "INSERT INTO b VALUES (9)",
            "CREATE TABLE b (v double)",
            "INSERT INTO b (v) VALUES (1.5)",
        )
    )
    assert sorted(tuple(r) for r in found.tables["a"].collect()) == [(1, "x"), (2, None)]
    assert [tuple(r) for r in found.tables["b"].collect()] == [(1.5,)]
    assert [r["ordinal"] for r in found.skipped.collect()] == [2]
    assert {(r["table_name"], r["column_name"], r["primary_key"]) for r in found.columns.collect()} == {
        ("a", "id", True), ("a", "name", False), ("b", "v", False),
    }


@pytest.mark.parametrize(("preceding", "following"), [(5, 5), (0, 7), (9, 0), (1, 1)])
def test_frames_wider_than_a_chunk(spark, preceding, following):
    df = spark.range(40).select((F.col("id") % 2).alias("k"), "id")
    w = windows.BucketedWindow(df, ["k"], ["id"], F.floor(F.col("id") / 8))
    found = windows.rows_frame(w, {"n": F.count("*"), "s": F.sum("id")}, preceding, following, chunk_rows=3).collect()
    assert len(found) == 40
    for r in found:
        own = [i for i in range(r["k"], 40, 2)]
        at = own.index(r["id"])
        frame = own[max(0, at - preceding) : at + following + 1]
        assert (r["n"], r["s"]) == (len(frame), sum(frame))


def test_pages_go_on_after_null_keys(spark):
    df = spark.createDataFrame([(None, 1), (None, 2), (1, None), (1, 3), (2, 1)], "a int, b int")
    got, after = [], None
    while True:
        page = paging.fetch_page(df, ["a", "b"], after, 2)
        got += [tuple(r) for r in page.rows]
        if page.done:
            break
        after = page.last_key
    assert got == [(None, 1), (None, 2), (1, None), (1, 3), (2, 1)]


def test_null_under_the_only_key_is_a_record(spark):
    df = spark.createDataFrame([('{"a":{"b":1}}',), ('{"a":null}',)], "doc string")
    parsed = documents.parse_json_column(df, "doc")
    assert sorted(str(r["b"]) for r in reshape.flatten(documents.record_rows(parsed, "doc"), "record").collect()) == ["1", "None"]


def test_flattened_names_that_clash(spark):
    df = documents.parse_json_column(spark.createDataFrame([('{"a__b":1,"a":{"b":2}}',)], "doc string"), "doc")
    assert reshape.flatten(df, "doc").columns == ["a__b"]


def test_lists_of_one_name_share_a_table(spark):
    df = documents.parse_json_column(spark.createDataFrame([('{"a_b":[1,2],"a":{"b":[3]}}',)], "doc string"), "doc")
    child = reshape.normalize(df.withColumn("k", F.lit(7)), "doc", "t", "k").tables["t_a_b"].collect()
    assert sorted(r["value"] for r in child) == [1, 2, 3]
    assert len({r[reshape.ID] for r in child}) == 3


def test_null_items_of_lists_in_lists_stay(spark):
    df = documents.parse_json_column(spark.createDataFrame([('{"a":[[1],null,[2,null]]}',)], "doc string"), "doc")
    child = reshape.normalize(df.withColumn("k", F.lit(1)), "doc", "t", "k").tables["t_a"].collect()
    assert sorted(str(r["value"]) for r in child) == ["1", "2", "None", "None"]


def test_fractions_of_a_second_and_the_end_of_a_day():
    assert workbook._number_cell("45000.500002894", "date") == ("datetime", "2023-03-15 12:00:00.250")
    assert workbook._number_cell("45000.5", "date") == ("datetime", "2023-03-15 12:00:00")
    assert workbook._number_cell("0.9999999999", "time") == ("time", "23:59:59.999")
    assert workbook._number_cell("0.5", "time") == ("time", "12:00:00")


@pytest.mark.parametrize(
    ("formula", "expected"),
    [("=SUM(a)", True), ("=SUM(a)+SUM(b)", False), ("=COUNTIF(Data!A:A, \"x)(\")", True), ("=SUM(IF(a,(b)))", True), ("=AVG(a)", False)],
)
def test_one_function_at_the_root(texts, formula, expected):
    assert texts(formula).filter(F.col("v").rlike(SUMMARY_FORMULA)).count() == expected


def test_refining_reads_no_more_than_the_sample(spark):
    """A table whose later partitions can't be read is typed by its first rows."""
    late = F.when(F.col("id") < 100, F.lit("yes")).otherwise(F.raise_error(F.lit("read too far")).cast("string"))
    df = spark.range(0, 1000, 1, 10).select(late.alias("v"))
    assert refine_types(df, {"v": "TEXT"}) == {"v": "BOOLEAN"}
    none = spark.createDataFrame([], "v string")
    assert refine_types(none, {"v": "TEXT"}) == {"v": "TEXT"}


def test_first_rows_refine_types(spark):
    df = spark.range(0, 5000, 1, 8).select(F.when(F.col("id") < 64, F.col("id").cast("string")).otherwise("text").alias("v"))
    assert refine_types(df, {"v": "TEXT"}) == refine_types(df.limit(64), {"v": "TEXT"})


def test_loads_are_all_or_nothing(spark, monkeypatch):
    names = ("edge_one", "edge_two")
    for name in (*names, *[f"{n}__old" for n in names]):
        spark.sql(f"DROP TABLE IF EXISTS {name}")
    first = {n: spark.createDataFrame([(1,)], "v int") for n in names}
    second = {n: spark.createDataFrame([(2,)], "v int") for n in names}
    loads.load_tables(spark, first)
    with pytest.raises(ValueError, match="if_exists"):
        loads.load_tables(spark, second, "oops")
    publish = loads._publish

    def failing(session, stage, table):
        if table == "edge_two":
            raise RuntimeError("lost")
        publish(session, stage, table)

    monkeypatch.setattr(loads, "_publish", failing)
    for mode in ("replace", "append"):
        with pytest.raises(RuntimeError, match="lost"):
            loads.load_tables(spark, second, mode)
        assert [[r.v for r in spark.table(n).collect()] for n in names] == [[1], [1]]
    monkeypatch.setattr(loads, "_publish", publish)
    loads.load_tables(spark, second, "append")
    assert [sorted(r.v for r in spark.table(n).collect()) for n in names] == [[1, 2], [1, 2]]
    loads.load_tables(spark, second, "replace")
    assert [[r.v for r in spark.table(n).collect()] for n in names] == [[2], [2]]


def test_one_hot_key_is_spread_over_tasks(spark):
    rows = spark.range(0, 20_000, 1, 8).select(F.when(F.col("id") % 100 == 0, F.col("id") % 7).otherwise(99).alias("k"), "id")
    aqe = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        w = windows.BucketedWindow(rows.withColumn("at", F.xxhash64("id")), ["k"], ["at", "id"])
        sizes = [r["n"] for r in w.per_bucket(F.count("*").alias("n")).filter("k = 99").collect()]
        assert len(sizes) >= 4 and max(sizes) <= 2 * sum(sizes) / len(sizes)
        plain = windows.Window.partitionBy("k").orderBy("at", "id")
        expected = w.df.withColumn("rn", F.row_number().over(plain)).collect()
        found = windows.row_number(w, "rn").select("k", "id", "at", "rn").collect()
        assert sorted(map(tuple, found)) == sorted(map(tuple, expected))
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", aqe)


def test_dump_files_of_every_kind_are_cut(spark, tmp_path):
    names = {
        "crlf.sql": ("CREATE TABLE a (v TEXT);\r\n" + "INSERT INTO a VALUES ('x;\r\ny');\r\n" * 50).encode(),
        "latin one.sql": ("INSERT INTO b VALUES ('é');\n" * 20).encode("latin-1"),
        "open.sql": b"/* a comment;\nover a cut */ INSERT INTO c VALUES (1);\nINSERT INTO c VALUES ('it''s;\nhere');\n",
        "plain.sql": ("INSERT INTO d VALUES ('é');\n" * 30).encode(),
        "empty.sql": b"",
    }
    for name, content in names.items():
        (tmp_path / name).write_bytes(content)
    found = sql_dump.read_statements(spark, str(tmp_path))
    parts = {r["f"].replace("%20", " "): (r["n"], r["cuts"]) for r in found.groupBy(F.element_at(F.split("file", "/"), -1).alias("f")).agg(
        F.count("*").alias("n"), F.count_distinct("ordinal.pos").alias("cuts")).collect()}
    assert parts == {"crlf.sql": (51, 51), "latin one.sql": (20, 20), "open.sql": (2, 2), "plain.sql": (30, 30)}
    values = {r["statement"] for r in found.collect()}
    assert {"INSERT INTO b VALUES ('é')", "INSERT INTO d VALUES ('é')", "INSERT INTO a VALUES ('x;\r\ny')"} <= values
    assert {"INSERT INTO c VALUES (1)", "INSERT INTO c VALUES ('it''s;\nhere')"} <= values

from __future__ import annotations

import datetime as dt
import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from rowsmith.functions import json_table
from rowsmith.operators import (
    dml,
    joins,
    loads,
    quality,
    reshape,
    sinks,
    statistics,
    windows,
    workbook_formulas,
)
from rowsmith.sources.documents import parse_json_column
from rowsmith.streaming import paging
from tests.conftest import rows


@pytest.fixture(scope="module")
def skewed(spark):
    """Three keys, one of them with most rows; many equal order values; some NULL values."""
    rng = random.Random(7)
    data = [
        (rng.choice("aaaab"), rng.randrange(40), i, None if i % 9 == 0 else rng.randrange(100))
        for i in range(600)
    ] + [("single", 5, 1000, None), (None, 3, 1001, 4), (None, 9, 1002, 5), (None, 3, 1003, None)]
    return spark.createDataFrame(data, "k string, at int, id int, v int")


@pytest.fixture(params=[False, True], ids=["ascending", "descending"])
def pair(request, skewed):
    """The bucketed window and the plain window it must equal."""
    descending = request.param
    bucketed = windows.BucketedWindow(skewed, ["k"], ["at", "id"], F.floor(F.col("at") / 7), descending)
    order = [F.desc("at"), F.desc("id")] if descending else ["at", "id"]
    return bucketed, Window.partitionBy("k").orderBy(*order), order


def same(mine, plain):
    columns = sorted(plain.columns)
    assert sorted(rows(mine.select(*columns)), key=str) == sorted(rows(plain.select(*columns)), key=str)


def test_row_number(pair, skewed):
    w, plain, _ = pair
    same(windows.row_number(w, "n"), skewed.withColumn("n", F.row_number().over(plain)))


def test_rank_and_dense_rank(pair, skewed):
    w, _, order = pair
    plain = Window.partitionBy("k").orderBy(order[0])
    same(windows.rank(w, "at", "n"), skewed.withColumn("n", F.rank().over(plain)))
    same(windows.dense_rank(w, "at", "n"), skewed.withColumn("n", F.dense_rank().over(plain)))


@pytest.mark.parametrize("tiles", [1, 4, 7, 1000])
def test_ntile(pair, skewed, tiles):
    w, plain, _ = pair
    same(windows.ntile(w, tiles, "n"), skewed.withColumn("n", F.ntile(tiles).over(plain)))


def test_lag_lead(pair, skewed):
    w, plain, _ = pair
    expected = skewed.withColumns({"p": F.lag("v").over(plain), "q": F.lead("v").over(plain)})
    same(windows.lag_lead(w, "v", "p", "q"), expected)


def test_first_last(pair, skewed):
    w, plain, _ = pair
    whole = plain.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    expected = skewed.withColumns({"p": F.first("id").over(whole), "q": F.last("id").over(whole)})
    same(windows.first_last(w, "id", "p", "q"), expected)


def test_running_sum_and_partition_aggregate(pair, skewed):
    w, plain, _ = pair
    running = plain.rowsBetween(Window.unboundedPreceding, 0)
    same(windows.running_sum(w, "v", "s"), skewed.withColumn("s", F.sum("v").over(running)))
    whole = Window.partitionBy("k")
    expected = skewed.withColumn("s", F.sum("v").over(whole))
    same(windows.partition_aggregate(skewed, ["k"], F.sum("v").alias("s")), expected)


@pytest.mark.parametrize(("before", "after", "chunk"), [(2, 0, 10), (0, 3, 10), (3, 2, 5), (2, 2, 1000)])
def test_rows_frame(pair, skewed, before, after, chunk):
    w, plain, _ = pair
    mine = windows.rows_frame(w, {"s": F.sum("v"), "m": F.max("id")}, before, after, chunk)
    frame = plain.rowsBetween(-before, after)
    expected = skewed.withColumns({"s": F.sum("v").over(frame), "m": F.max("id").over(frame)})
    same(mine, expected)


def test_range_frame(skewed):
    mine = windows.range_frame(skewed, ["k"], F.col("at"), 6, {"n": ("count", "*"), "top": ("max", "id")})
    frame = Window.partitionBy("k").orderBy("at").rangeBetween(-6, 0)
    same(mine, skewed.withColumns({"n": F.count("*").over(frame), "top": F.max("id").over(frame)}))


def test_not_in(spark):
    df = spark.createDataFrame([(1,), (2,), (None,)], "k int")
    some = spark.createDataFrame([(2,)], "x int")
    assert rows(joins.not_in(df, "k", some)) == [(1,)]
    assert rows(joins.not_in(df, "k", some.union(df.filter("k IS NULL")))) == []
    assert len(rows(joins.not_in(df, "k", some.filter("false")))) == 3


def test_normalize(spark):
    text = (
        '{"id": 1, "info": {"city": "x", "geo": {"lat": 1.5}}, "extra": {"tags": ["a", "b"], "on": true},'
        ' "items": [{"sku": "p", "parts": [1, 2]}, {"sku": "q"}], "grid": [[1, 2], [], [3]], "none": []}'
    )
    df = parse_json_column(spark.createDataFrame([(7, text)], "k int, doc string"), "doc")
    result = reshape.normalize(df, "doc", "root", key="k")
    assert sorted(result.tables) == [
        "root", "root_extra_tags", "root_grid", "root_items", "root_items_parts", "root_none",
    ]
    root = result.tables["root"].first().asDict()
    assert root == {"_import_id": "7", "id": 1, "info__city": "x", "info__geo__lat": 1.5, "extra_on": True}
    assert sorted(rows(result.tables["root_items"])) == [("7/items/0", "7", "p"), ("7/items/1", "7", "q")]
    parts = result.tables["root_items_parts"]
    assert sorted(r["value"] for r in parts.collect()) == [1, 2]
    assert {r["parent_id"] for r in parts.collect()} == {"7/items/0"}
    assert sorted(r["value"] for r in result.tables["root_grid"].collect()) == [1, 2, 3]
    joined = reshape.join_child(result.tables, result.relations, "root_items_parts")
    assert {r["parent__sku"] for r in joined.collect()} == {"p"}
    assert quality.orphans(parts, "parent_id", result.tables["root_items"], "_import_id").count() == 0


def test_normalize_without_key_keeps_ids(spark):
    df = spark.range(20).select(F.struct(F.col("id"), F.array("id").alias("xs")).alias("doc"))
    result = reshape.normalize(df, "doc", "t")
    joined = reshape.join_child(result.tables, result.relations, "t_xs")
    assert joined.filter("value = parent__id").count() == 20


def test_flatten_and_drift(spark):
    df = parse_json_column(spark.createDataFrame([('{"a": {"b": [1], "c": 2}}',), ('{"z": 1}',)], "d string"), "d")
    flat = reshape.flatten(df, "d")
    assert flat.columns == ["a__b", "a__c", "z"]
    assert sorted(rows(flat), key=str) == [("[1]", 2, None), (None, None, 1)]
    scalar = spark.createDataFrame([(5,)], "d int")
    assert rows(reshape.flatten(scalar, "d")) == [(5,)]


def test_json_table_functions(spark):
    df = spark.createDataFrame([('{"a":1,"b":[2,{"c":null}],"s":"x y"}',)], "j string")
    each = {r["key"]: (r["value"], r["type"]) for r in json_table.json_each(df, "j").collect()}
    assert each == {"a": ("1", "number"), "b": ('[2,{"c":null}]', "array"), "s": ("x y", "string")}
    tree = {r["path"]: r["type"] for r in json_table.json_tree(df, "j").collect()}
    assert tree == {
        "$": "object", "$.a": "number", "$.b": "array", "$.b[0]": "number", "$.b[1]": "object",
        "$.b[1].c": "null", "$.s": "string",
    }


def test_constraints(spark):
    df = spark.createDataFrame([(1, 1, 5), (1, 1, None), (None, 2, -1)], "a int, b int, c int")
    assert quality.null_violations(df, ["a", "c"]).count() == 2
    assert rows(quality.duplicate_keys(df, ["a", "b"])) == [(1, 1, 2)]
    reasons = {r["reason"] for r in quality.primary_key_violations(df, ["a", "b"]).collect()}
    assert reasons == {"duplicate key", "null key"}
    assert [r["c"] for r in quality.check_violations(df, "c > 0").collect()] == [-1]
    parents = spark.createDataFrame([(2,)], "p int")
    assert quality.orphans(df, "a", parents, "p").count() == 2
    assert quality.cascade_delete(df, "b", parents).count() == 2
    renamed = spark.createDataFrame([(2, 20)], "o int, n int")
    assert sorted(r["b"] for r in quality.cascade_update(df, "b", renamed).collect()) == [1, 1, 20]


def test_rewrites(spark):
    df = spark.createDataFrame([(1, "a"), (2, None)], "k int, v string")
    updated = dml.update(df, {"v": F.lit("new"), "k": F.col("k") + 10}, F.col("v") == "a")
    assert sorted(rows(updated)) == [(2, None), (11, "new")]
    assert rows(dml.delete(df, F.col("v") == "a")) == [(2, None)]
    fresh = spark.createDataFrame([(2, "x"), (3, "y")], "k int, v string")
    assert sorted(rows(dml.upsert(df, fresh, ["k"]))) == [(1, "a"), (2, "x"), (3, "y")]
    assert sorted(rows(dml.upsert(df, fresh, ["k"], "nothing")), key=str) == [(1, "a"), (2, None), (3, "y")]
    assert rows(dml.delete_returning(df, F.col("k") == 1, ["v"])) == [("a",)]
    with pytest.raises(ValueError):
        dml.upsert(df, fresh, ["k"], "explode")


def test_csv_sink(spark, tmp_path):
    df = spark.createDataFrame(
        [(1, 'a "b", c', dt.datetime(2030, 1, 2, 3, 4, 5, 60), bytearray(b"x"), ""), (2, None, None, None, " s ")],
        "k int, t string, at timestamp, b binary, e string",
    )
    path = str(tmp_path / "out")
    sinks.write_csv(df.coalesce(1), path, ";")
    text = next((tmp_path / "out").glob("*.csv")).read_text().splitlines()
    assert text == ["k;t;at;b;e", '1;"a ""b"", c";2030-01-02T03:04:05.000060Z;eA==;', "2;;;; s "]
    line = df.select(sinks.csv_line(df).alias("l")).first()["l"]
    assert line == '1,"a ""b"", c",2030-01-02T03:04:05.000060Z,eA==,'


def test_load_order_and_names(spark):
    assert loads.load_order({"c": ["b"], "b": ["a"], "a": ["a"]}) == ["a", "b", "c"]
    with pytest.raises(ValueError, match="cycle"):
        loads.load_order({"a": ["b"], "b": ["a"]})
    df = spark.createDataFrame([("1", "x")], "`Order ID` string, v string")
    draft = loads.draft_table(df, "t")
    assert [c.target for c in draft.columns] == ["Order_ID", "v"]
    with pytest.raises(ValueError):
        loads.check_names([draft.with_column("v", target="Order_ID")])
    with pytest.raises(ValueError):
        loads.check_names([draft, draft])
    changed = draft.with_column("Order ID", type="TEXT")
    assert changed.warnings() == ["t.Order_ID: type TEXT overrides the inferred INTEGER"]
    assert rows(loads.apply_draft(df, changed)) == [("1", "x")]
    assert loads.distinct_warnings([" a", "a", "", "b"]) == ["a", "b"]


def test_load_tables(spark):
    df = spark.createDataFrame([(1,)], "k int")
    child = spark.createDataFrame([(1, 1)], "id int, k int")
    order = loads.load_tables(spark, {"child_t": child, "parent_t": df}, references={"child_t": ["parent_t"]})
    assert order == ["parent_t", "child_t"]
    with pytest.raises(ValueError, match="exist"):
        loads.load_tables(spark, {"parent_t": df})
    loads.load_tables(spark, {"parent_t": df}, "append")
    assert spark.table("parent_t").count() == 2
    loads.load_tables(spark, {"parent_t": df}, "replace")
    assert spark.table("parent_t").count() == 1
    broken = df.select(F.raise_error(F.lit("no")).alias("k"))
    with pytest.raises(Exception):
        loads.load_tables(spark, {"good_t": df, "bad_t": broken})
    assert not spark.catalog.tableExists("good_t")
    spark.sql("ANALYZE TABLE parent_t COMPUTE STATISTICS FOR ALL COLUMNS")
    report = loads.import_report({"parent_t": spark.table("parent_t")}).first()
    assert (report["row_count"], report["columns"]) == (1, "k int")
    for name in ("parent_t", "child_t"):
        spark.sql(f"DROP TABLE {name}")


def test_paging(spark):
    df = spark.range(25).select((F.col("id") % 3).alias("g"), "id")
    seen, after, pages = [], None, 0
    while True:
        page = paging.fetch_page(df, ["g", "id"], after, 10)
        seen += [tuple(r) for r in page.rows]
        after, pages = page.last_key, pages + 1
        if page.done:
            break
    assert seen == sorted(rows(df)) and pages == 3
    assert [len(p) for p in paging.iter_pages(df, 10)] == [10, 10, 5]
    empty = paging.fetch_page(df.filter("false"), ["id"])
    assert empty.done and empty.rows == []


def test_summary_and_lookup(spark):
    source = spark.createDataFrame([("a", 1), ("a", 2), ("b", 5)], "k string, v int")
    criteria = spark.createDataFrame([("a",), ("z",)], "region string")
    view = workbook_formulas.summary_view(
        criteria, "region", source, "k", {"n": F.count("*"), "total": F.sum("v")}
    )
    assert sorted(rows(view)) == [("a", 2, 3), ("z", 0, 0)]
    found = workbook_formulas.vlookup(criteria, "region", source, "k", "v", "v", "first")
    assert sorted(rows(found), key=str) == [("a", 1), ("z", None)]


def test_statistics(spark):
    df = spark.createDataFrame([(1, "b"), (None, "a")], "n int, s string")
    stats = {r["column_name"]: (r["null_count"], r["min_value"]) for r in statistics.column_statistics(df).collect()}
    assert stats == {"n": (1, "1"), "s": (0, "a")}

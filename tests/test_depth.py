"""Operators whose work must not follow depth, density or the size of old tables."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from rowsmith.functions import json_table
from rowsmith.operators import loads, quality, reshape
from rowsmith.operators import windows as W
from rowsmith.sources import documents
from tests.conftest import rows


def test_json_tree_is_one_scan_at_any_depth(spark, tmp_path):
    deep = "[" * 300 + "1" + "]" * 300
    docs = ['{"a":{"b":[1,"x",null,true,{"c":2.5}]},"d":"é"}', deep, '[{"a":1},{"a":{"b":[]}},{"a":"s"}]', "7", None]
    spark.createDataFrame(list(enumerate(docs)), "k int, j string").write.parquet(str(tmp_path / "t"))
    found = json_table.json_tree(spark.read.parquet(str(tmp_path / "t")), "j", ("k",))
    assert found._jdf.queryExecution().executedPlan().toString().count("FileScan") == 1
    by_doc = {}
    for r in found.collect():
        by_doc.setdefault(r["k"], {})[r["path"]] = (r["key"], r["value"], r["type"])
    assert by_doc[0] == {
        "$": (None, '{"a":{"b":[1,"x",null,true,{"c":2.5}]},"d":"é"}', "object"), "$.a": ("a", '{"b":[1,"x",null,true,{"c":2.5}]}', "object"),
        "$.a.b": ("b", '[1,"x",null,true,{"c":2.5}]', "array"), "$.a.b[0]": ("0", "1", "number"), "$.a.b[1]": ("1", "x", "string"),
        "$.a.b[2]": ("2", None, "null"), "$.a.b[3]": ("3", "true", "boolean"), "$.a.b[4]": ("4", '{"c":2.5}', "object"),
        "$.a.b[4].c": ("c", "2.5", "number"), "$.d": ("d", "é", "string"),
    }
    assert len(by_doc[1]) == 301 and by_doc[1]["$" + "[0]" * 300] == ("0", "1", "number")
    assert by_doc[2]["$[1].a.b"] == ("b", "[]", "array") and by_doc[2]["$[2].a"] == ("a", "s", "string")
    assert by_doc[3] == {"$": (None, "7", "number")} and by_doc[4] == {"$": (None, None, "null")}


@pytest.mark.parametrize("doc", ['{"k":1,"a":[{"x":1,"b":[1,2]},{"x":2}],"c":["p"]}', '{"k":1,"a":[{"x":1,"b":[1,2],"e":{}},{"x":2}],"c":["p"]}'])
def test_normalized_tables_parse_their_source_once(spark, doc):
    df = documents.parse_json_column(spark.createDataFrame([(7, doc)], "id int, doc string"), "doc")
    tables = reshape.normalize(df, "doc", "t", "id").tables
    assert sorted(tables) == ["t", "t_a", "t_a_b", "t_c"]
    for table in tables.values():
        assert "from_json" not in table._jdf.queryExecution().optimizedPlan().toString()
    assert sorted(rows(tables["t_a_b"].select("value"))) == [(1,), (2,)] and tables["t_c"].first()["value"] == "p"
    assert {r["_import_id"] for r in tables["t_a"].collect()} == {"7/a/0", "7/a/1"}


def plain_frame(data, preceding):
    found = []
    for k, at, v, i in data:
        frame = [w for j, b, w, _ in data if j == k and (b is None) == (at is None) and (at is None or at - preceding <= b <= at)]
        some = [w for w in frame if w is not None]
        found.append((i, len(frame), len(some), sum(some) if some else None, min(some, default=None), max(some, default=None)))
    return sorted(found)


@pytest.mark.parametrize("chunk", [2, 5, 256])
def test_dense_range_frames(spark, chunk):
    rng = random.Random(chunk)
    # Nearly all rows of one key lie within one frame.
    data = [("hot", rng.randrange(1000, 1080), rng.choice([None, *range(-50, 50)]), i) for i in range(250)]
    data += [(rng.choice(["cold", None]), rng.choice([None, *range(0, 3000, 37)]), rng.randrange(100), 1000 + i) for i in range(60)]
    df = spark.createDataFrame(data, "k string, at long, v int, i int")
    wanted = {"n": ("count", "*"), "m": ("count", "v"), "s": ("sum", "v"), "lo": ("min", "v"), "hi": ("max", "v")}
    for preceding in (0, 30, 5000):
        found = W.range_frame(df, ["k"], F.col("at"), preceding, wanted, chunk)
        assert sorted(rows(found.select("i", "n", "m", "s", "lo", "hi"))) == plain_frame(data, preceding)


def test_dense_frames_are_spread_over_tasks(spark):
    df = spark.range(0, 40_000, 1, 8).select(F.lit("hot").alias("k"), (F.col("id") % 5000).alias("at"), "id")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        values = df.groupBy("k", "at").agg(F.count("*").alias("n"))
        w = W.BucketedWindow(values, ["k"], ["at"])
        sizes = [r["n"] for r in w.per_bucket(F.count("*").alias("n")).collect()]
        assert len(sizes) >= 4 and max(sizes) <= 2 * sum(sizes) / len(sizes)
        found = W.range_frame(df, ["k"], F.col("at"), 10_000, {"n": ("count", "*"), "top": ("max", "id")})
        assert found.filter("n != 8 * (at + 1) OR top != 35000 + at").count() == 0
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_cascades_end_in_chains_cycles_and_self_references(spark):
    tables = {
        "a": spark.createDataFrame([(1, None), (2, 1), (3, 2), (4, 9), (5, 6), (6, 5)], "id int, up int"),
        "b": spark.createDataFrame([(10, 3), (11, 4), (12, None), (13, 3)], "id int, a int"),
        "c": spark.createDataFrame([(20, 10), (21, 11), (22, 13)], "id int, b int"),
    }
    keys = {n: ["id"] for n in tables}
    refs = [
        quality.Reference("a", "up", "a", "id"), quality.Reference("b", "a", "a", "id"),
        quality.Reference("c", "b", "b", "id"), quality.Reference("a", "id", "c", "id", "set null"),
    ]
    first = {"a": spark.createDataFrame([(1,), (5,), (99,)], "id int")}
    left = quality.cascade_graph(tables, keys, refs[:3], first)
    assert {n: sorted(r[0] for r in df.collect()) for n, df in left.items()} == {"a": [4], "b": [11, 12], "c": [21]}
    nulls = quality.cascade_graph(tables, keys, [refs[0], quality.Reference("b", "a", "a", "id", "set null")], first)
    assert sorted(rows(nulls["b"]), key=str) == [(10, None), (11, 4), (12, None), (13, None)]
    assert sorted(rows(nulls["c"])) == sorted(rows(tables["c"]))


NAMES = ("step_one", "step_two")


@pytest.fixture()
def clean(spark):
    def drop():
        for load in loads._open_loads(spark):
            spark.sql(f"DROP VIEW {load}")
        for name in NAMES:
            loads.drop_table(spark, name)
            for part in loads.orphan_parts(spark, [name]):
                spark.sql(f"DROP TABLE {part}")

    drop()
    yield
    drop()


def contents(spark):
    return [sorted(r.v for r in spark.table(n).collect()) for n in NAMES]


@pytest.mark.parametrize("mode", ["append", "replace"])
def test_a_load_that_dies_leaves_old_or_new(spark, clean, mode):
    old = {n: spark.createDataFrame([(1,)], "v int") for n in NAMES}
    new = {n: spark.createDataFrame([(2,)], "v int") for n in NAMES}
    expected = [[1, 2]] * 2 if mode == "append" else [[2]] * 2
    steps = len(list(loads.load_steps(spark, old)))
    seen = []
    for stop in range(1, steps + 1):
        loads.load_tables(spark, old, "replace")
        dying = loads.load_steps(spark, new, mode)
        last = [next(dying) for _ in range(stop)][-1]
        dying.close()
        loads.finish_loads(spark)
        seen.append((last, contents(spark)))
        # The next load finds whole tables.
        loads.load_tables(spark, new, "append")
        assert contents(spark) == [sorted([*c, 2]) for c in seen[-1][1]]
    committed = [s for s, _ in seen].index("committed")
    assert all(c == [[1], [1]] for _, c in seen[:committed])
    assert all(c == expected for _, c in seen[committed:])


def test_append_does_not_touch_old_rows(spark, clean):
    spark.createDataFrame([(1, "a")], "v int, w string").write.saveAsTable(NAMES[0])
    loads.load_tables(spark, {NAMES[0]: spark.createDataFrame([("b", 2)], "w string, v long")}, "append")
    parts = loads.table_parts(spark, NAMES[0])
    assert len(parts) == 2 and sorted(rows(spark.table(NAMES[0]))) == [(1, "a"), (2, "b")]
    loads.load_tables(spark, {NAMES[0]: spark.createDataFrame([(3, "c")], "v int, w string")}, "append")
    assert loads.table_parts(spark, NAMES[0])[:2] == parts
    assert rows(spark.table(parts[0])) == [(1, "a")]
    with pytest.raises(ValueError, match="columns differ"):
        loads.load_tables(spark, {NAMES[0]: spark.createDataFrame([(3,)], "v int")}, "append")
    assert spark.table(NAMES[0]).count() == 3 and loads.orphan_parts(spark, NAMES) == []
    loads.load_tables(spark, {NAMES[0]: spark.createDataFrame([("[1]",)], "z string")}, "replace")
    assert rows(spark.table(NAMES[0])) == [("[1]",)]
    assert not any(spark.catalog.tableExists(p) for p in parts)

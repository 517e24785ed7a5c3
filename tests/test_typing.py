from __future__ import annotations

import datetime as dt
import decimal
import math

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from rowsmith.functions import declared, names
from rowsmith.functions import tokens as K
from rowsmith.operators import coercion, inference


@pytest.mark.parametrize(
    ("name", "values", "expected"),
    [
        ("n", ["1", "2", None], "INTEGER"),
        ("n", ["+5", "-3"], "INTEGER"),
        ("code", ["007", "12"], "TEXT"),
        ("b", ["true", "No", " ON "], "BOOLEAN"),
        ("b", ["0", "1"], "BOOLEAN"),
        ("zeros", ["0", "0"], "INTEGER"),
        ("is_zero", ["0", "0"], "BOOLEAN"),
        ("u", ["6fa459ea-ee8a-3ca4-894e-db77e160355e"], "UUID"),
        ("t", ["2030-05-06T07:08:09Z", "2030-05-07"], "TIMESTAMP"),
        ("us_date", ["03/04/2030"], "TIMESTAMP"),
        ("eu_date", ["13.04.2030"], "TIMESTAMP"),
        ("time_of_day", ["9:15", "10:30:05.5"], "TIMESTAMP"),
        ("unix_timestamp", ["1700000000", "1700000001"], "TIMESTAMP"),
        ("number", ["1700000000"], "INTEGER"),
        ("t", ["2030-05-06", "soon"], "TEXT"),
        ("numeric_col", ["10.25", "3"], "DECIMAL(18,6)"),
        ("price", ["10.25", "3"], "FLOAT64"),
        ("x", ["Infinity", "INF", "1.5E+300", "1.0E+999"], "FLOAT64"),
        ("x", ["NaN", "#NUM!"], "FLOAT64"),
        ("x", ["9223372036854775808"], "FLOAT64"),
        ("x", ["1d"], "TEXT"),
        ("empty", [None, None], "TEXT"),
    ],
)
def test_inference(texts, name, values, expected):
    assert inference.infer_types(texts(*values, name=name)) == {name: expected}


def test_inference_of_typed_columns(spark):
    df = spark.createDataFrame(
        [(1, 1.0, True, bytearray(b"a"), [1], dt.datetime(2030, 1, 1), "x")],
        "whole int, real double, yes boolean, raw binary, list array<int>, at timestamp, s string",
    )
    assert inference.infer_types(df) == {
        "whole": "INTEGER", "real": "INTEGER", "yes": "BOOLEAN", "raw": "BLOB", "list": "TEXT",
        "at": "TIMESTAMP", "s": "TEXT",
    }


def test_inference_of_an_empty_table_and_nulls(spark, texts):
    assert inference.infer_types(texts("1").filter("false")) == {"v": "TEXT"}
    columns = inference.infer_columns(texts("1", None))
    assert columns == [inference.InferredColumn("v", "INTEGER", True)]


def test_sample_refinement(spark):
    df = spark.createDataFrame(
        [("yes", 1, "6fa459ea-ee8a-3ca4-894e-db77e160355e", 1700000000, "word")],
        "flag string, is_on int, id string, created_at bigint, note string",
    )
    given_types = {"flag": "TEXT", "is_on": "INTEGER", "id": "TEXT", "created_at": "INTEGER", "note": "TEXT"}
    assert inference.refine_types(df, given_types) == {
        "flag": "BOOLEAN", "is_on": "BOOLEAN", "id": "UUID", "created_at": "TIMESTAMP", "note": "TEXT",
    }


def test_timestamps(texts):
    cases = {
        "2030-05-06": "2030-05-06 00:00:00",
        "2030-05-06T07:08": "2030-05-06 07:08:00",
        "2030-05-06 07:08:09.1234567+02:00": "2030-05-06 05:08:09.123456",
        "20300506": "2030-05-06 00:00:00",
        "2030-02-31": "2030-03-03 00:00:00",
        "5/6/2030 7:08": "2030-05-06 07:08:00",
        "31.12.2030T23:59:58": "2030-12-31 23:59:58",
        "7:08:09": "1970-01-01 07:08:09",
        "1700000000": "2023-11-14 22:13:20",
        "1700000000123": "2023-11-14 22:13:20.123",
        "14/14/2030": None,
        "24:00": None,
        "later": None,
        "4102444800001": None,
    }
    parsed = texts(*cases).select("v", K.parse_timestamp(F.col("v")).cast("string").alias("t"))
    assert {r["v"]: r["t"] for r in parsed.collect()} == cases


def test_coercion(spark, texts):
    df = texts(" 7 ", "x", None)
    out = coercion.coerce_columns(df, {"v": "INTEGER"}).collect()
    assert [r["v"] for r in out] == [7, None, None]
    one = texts("é日").select(coercion.coerce(F.col("v"), df.schema["v"].dataType, "BLOB").alias("b"))
    assert bytes(one.first()["b"]) == bytes([0xE9, 0xE5])
    typed = spark.createDataFrame([(bytearray(b"hi"), [1, 2], 5)], "b binary, a array<int>, n int")
    text = coercion.coerce_columns(typed, {"b": "TEXT", "a": "TEXT", "n": "BOOLEAN"}).first()
    assert (text["b"], text["a"], text["n"]) == ("aGk=", "[1,2]", None)
    exact = coercion.coerce_columns(texts("1.25"), {"v": "DECIMAL(10,1)"}).first()
    assert exact["v"] == decimal.Decimal("1.3")


def test_boolean_profiles(texts):
    df = texts("on", "y", "yes")
    for profile, expected in (
        ("generic", [True, True, True]), ("sqlite", [None, True, True]), ("dump", [None, None, True]),
    ):
        out = coercion.coerce_columns(df, {"v": "BOOLEAN"}, profile).collect()
        assert [r["v"] for r in out] == expected


def test_reject_counts(texts):
    counts = coercion.reject_counts(texts("1", "x", None), {"v": "INTEGER"}).first()
    assert (counts["present"], counts["rejected"]) == (2, 1)


def test_names(texts):
    assert names.distinct_names(["Order ID", "Order ID", "2nd", "", "__a--b__"]) == [
        "Order_ID", "Order_ID_2", "column_2nd", "column_1", "a_b",
    ]
    assert names.header_names(["a", " ", None], 4) == ["a", "column_2", "column_3", "column_4"]


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text(alphabet="aZ9_ -é.\t", max_size=8), min_size=1, max_size=20))
def test_sanitize_twins_agree(texts, raw):
    out = texts(*raw).select("v", names.sanitize_column(F.col("v")).alias("clean")).collect()
    for row in out:
        assert row["clean"] == names.sanitize_identifier(row["v"])


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.one_of(st.integers(-(2**70), 2**70).map(str), st.floats(allow_nan=False).map(str)), min_size=1, max_size=20))
def test_numbers_like_python(texts, raw):
    out = texts(*raw).select(
        "v", K.parse_integer(F.col("v")).alias("i"), K.parse_double(F.col("v")).alias("d")
    )
    for row in out.collect():
        assert row["d"] == float(row["v"]) or math.isnan(row["d"])
        if row["v"].lstrip("-").isdigit():
            whole = int(row["v"])
            assert row["i"] == (whole if -(2**63) <= whole < 2**63 else None)


def test_declared_types(texts):
    df = texts("TINYINT(1)", "varchar(36)", "numeric(9,2)", "double", "varbinary(3)", "time")
    mysql = [r[0] for r in df.select(declared.mysql_target_type(F.col("v"))).collect()]
    sqlite = [r[0] for r in df.select(declared.sqlite_target_type(F.col("v"))).collect()]
    assert mysql == ["BOOLEAN", "UUID", "DECIMAL(9,2)", "FLOAT64", "BLOB", "TEXT"]
    assert sqlite == ["INTEGER", "UUID", "DECIMAL(9,2)", "FLOAT64", "TEXT", "TIMESTAMP"]

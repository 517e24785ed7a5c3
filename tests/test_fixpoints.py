"""Names and cell references settled in rounds equal one step after the other."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from rowsmith.functions import names
from rowsmith.operators import naming, workbook_formulas
from tests.conftest import rows


def named(spark, raw):
    df = spark.createDataFrame(list(enumerate(raw)), "i int, raw string")
    return [r[0] for r in naming.distinct_names(df, F.col("raw"), "i").orderBy("i").select("name").collect()]


@pytest.mark.parametrize("raw", [
    ["x", "x", "x_2"], ["x", "x_2", "x"], ["x_2", "x", "x", "x"], ["x", "x", "x_2", "x_2", "x_2_2", "x", "x_3"], ["a"], ["x_2_2", "x", "x", "x_2", "x_2", "x"],
    ["x_02", "x", "x", "x_1", "x"], ["", "1", "", "column_1", "column_1_2", ""],
])
def test_collisions(spark, raw):
    assert named(spark, raw) == names.distinct_names(raw)


def test_random_names_equal_the_loop(spark):
    rng = random.Random(12)
    raw = [rng.choice(["x", "x", "x", "y", "y"]) + "".join(rng.choices(["", "_2", "_3", "_4", "_10"], k=rng.randrange(4))) for _ in range(600)]
    assert named(spark, raw) == names.distinct_names(raw)


def test_chains_and_cycles_of_cells(spark):
    formulas = {f"A{i}": f"=A{i + 1}" for i in range(1, 300)} | {
        "B1": "=Other!a2", "B2": "='It''s'!$C$3", "B3": "=B4", "B4": "=B5", "B5": "=B3", "B6": "=B4", "B7": "=Z99", "B8": "=D1", "AB9": "=A1", "B10": "=A1*2",
    }

    def split(cell):
        letters = cell.rstrip("0123456789")
        col = 0
        for c in letters:
            col = col * 26 + ord(c) - 64
        return int(cell[len(letters) :]), col

    data = [("b", "Main", *split(c), "formula", None, f) for c, f in formulas.items()]
    data += [("b", "Main", 300, 1, "int", "42", None), ("b", "OTHER", 2, 1, "text", "far", None), ("b", "It's", 3, 3, "text", "quoted", None), ("b", "Main", 1, 4, "formula", None, "=SUM(A1:A3)")]
    data += [("c", "Main", 1, 1, "formula", None, "=A300"), ("c", "Main", 300, 1, "int", "7", None)]
    cells = spark.createDataFrame(data, "book string, sheet string, row_no int, col_no int, kind string, value string, formula string")
    found = {tuple(r)[:4]: (r["value"], r["state"]) for r in workbook_formulas.resolve_references(cells).collect()}
    main = lambda c: found[("b", "Main", *split(c))]
    assert all(main(f"A{i}") == ("42", "value") for i in range(1, 300)) and main("AB9") == ("42", "value")
    assert found[("c", "Main", 1, 1)] == ("7", "value")
    assert main("B1") == ("far", "value") and main("B2") == ("quoted", "value")
    assert {main(c) for c in ("B3", "B4", "B5", "B6")} == {(None, "cycle")}
    assert main("B7") == (None, "empty") and main("B8") == ("=SUM(A1:A3)", "formula")
    assert ("b", "Main", 10, 2) not in found
    assert rows(workbook_formulas.resolve_references(cells.filter("formula IS NULL"))) == []

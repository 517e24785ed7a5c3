"""Every registered query against its SQL, on the smallest tables."""

from __future__ import annotations

import importlib.util
from pathlib import Path

import duckdb
import pytest

from rowsmith.plans import Tables, registered
from rowsmith.plans.registry import TABLES
from tools.check import canonical_rows

ROOT = Path(__file__).resolve().parents[1]
SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF_DIR}/{name}.parquet'")
    return connection


@pytest.mark.parametrize("name", sorted(registered()))
def test_query(spark, duck, name):
    query = registered()[name]
    df = query.run(Tables(spark, SF_DIR))
    mine = [tuple(r) for r in df.collect()]
    if query.oracle is None:
        assert mine
        return
    cursor = duck.execute(query.oracle)
    columns = [d[0] for d in cursor.description]
    assert sorted(columns) == sorted(df.columns)
    assert canonical_rows(df.columns, mine) == canonical_rows(columns, cursor.fetchall())


def test_entry(spark):
    spec = importlib.util.spec_from_file_location("spark_entry", ROOT / "__spark_entry__.py")
    module = importlib.util.module_from_spec(spec)
    spec.loader.exec_module(module)
    assert module.entry(spark).count() == 5
    assert set(module.oracle_sql()) <= set(module.queries())

from __future__ import annotations

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from rowsmith.session import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    base = tmp_path_factory.mktemp("spark")
    session = build_session(
        "tests",
        "local[4]",
        **{
            "spark.sql.shuffle.partitions": "4",
            "spark.sql.warehouse.dir": str(base / "warehouse"),
            "spark.checkpoint.dir": str(base / "checkpoints"),
            "spark.driver.memory": "6g",
        },
    )
    yield session
    session.stop()


@pytest.fixture()
def texts(spark):
    """A one-column table of text values."""

    def make(*values, name="v"):
        return spark.createDataFrame([(v,) for v in values], f"`{name}` string")

    return make


def rows(df):
    return [tuple(r) for r in df.collect()]

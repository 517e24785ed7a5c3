"""Queries by name: a function of the tables, and the SQL it must agree with."""

from __future__ import annotations

import importlib
from collections.abc import Callable
from dataclasses import dataclass
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession

from rowsmith.session import use_utc

TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
    "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
)
MODULES = (
    "relational", "windowing", "scalars", "rewrites", "ingest", "typing_", "nested", "workbooks",
    "delivery",
)


class Tables:
    """The input tables of one scale folder, read lazily."""

    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        self.spark = use_utc(spark)
        self.sf_dir = sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        if name not in TABLES:
            raise AttributeError(name)
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def sql(self, query: str, args: list | None = None) -> DataFrame:
        """Spark SQL over the tables named in the text."""
        for name in TABLES:
            if name in query:
                getattr(self, name).createOrReplaceTempView(name)
        return self.spark.sql(query, args=args)


@dataclass(frozen=True)
class Query:
    run: Callable[[Tables], DataFrame]
    oracle: str | None


_QUERIES: dict[str, Query] = {}


def query(name: str, oracle: str | None = None) -> Callable:
    def register(run: Callable[[Tables], DataFrame]) -> Callable[[Tables], DataFrame]:
        if name in _QUERIES:
            raise ValueError(f"query registered twice: {name}")
        _QUERIES[name] = Query(run, oracle)
        return run

    return register


@lru_cache(maxsize=1)
def registered() -> dict[str, Query]:
    for module in MODULES:
        importlib.import_module(f"rowsmith.plans.{module}")
    return dict(_QUERIES)

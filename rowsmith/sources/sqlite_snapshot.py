"""Read-only snapshots of SQLite files.

A file that executors can open (a shared mount) is scanned through a Python data source,
one partition per rowid range. Files that arrive as bytes are opened in memory, one at a
time, on the executors.
"""

from __future__ import annotations

import sqlite3
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

ROWS_PER_FETCH = 10_000


def _quoted(name: str) -> str:
    return '"' + name.replace('"', '""') + '"'


def _open(path: str) -> sqlite3.Connection:
    return sqlite3.connect(f"file:{path}?mode=ro&immutable=1", uri=True)


def list_tables(path: str) -> list[str]:
    """User tables of a file, by name."""
    with _open(path) as connection:
        rows = connection.execute(
            "SELECT name FROM sqlite_master WHERE type = 'table'"
            " AND name NOT LIKE 'sqlite!_%' ESCAPE '!' ORDER BY name"
        )
        return [name for (name,) in rows]


def table_columns(path: str, table: str) -> list[tuple[str, str]]:
    """Name and declared type of the stored columns; generated ones are left out."""
    with _open(path) as connection:
        rows = connection.execute(f"PRAGMA table_xinfo({_quoted(table)})")
        return [(row[1], row[2]) for row in rows if row[6] == 0]


class RowidRange(InputPartition):
    def __init__(self, low: int, high: int) -> None:
        self.low = low
        self.high = high


class SqliteReader(DataSourceReader):
    def __init__(self, schema: T.StructType, options: dict[str, str]) -> None:
        self.columns = schema.fieldNames()
        self.path = options["path"]
        self.table = options["dbtable"]
        self.rows_per_partition = int(options.get("rowspartition", "1000000"))

    def partitions(self) -> Sequence[InputPartition]:
        with _open(self.path) as connection:
            low, high = connection.execute(
                f"SELECT min(rowid), max(rowid) FROM {_quoted(self.table)}"
            ).fetchone()
        if low is None:
            return [RowidRange(0, -1)]
        step = self.rows_per_partition
        return [RowidRange(at, min(at + step - 1, high)) for at in range(low, high + 1, step)]

    def read(self, partition: RowidRange) -> Iterator[tuple]:
        columns = ", ".join(_quoted(name) for name in self.columns)
        with _open(self.path) as connection:
            yield from connection.execute(
                f"SELECT {columns} FROM {_quoted(self.table)} WHERE rowid BETWEEN ? AND ?",
                (partition.low, partition.high),
            )


class SqliteSource(DataSource):
    """``spark.read.format("sqlite_snapshot").schema(...).option("dbtable", t).load(path)``"""

    @classmethod
    def name(cls) -> str:
        return "sqlite_snapshot"

    def reader(self, schema: T.StructType) -> DataSourceReader:
        return SqliteReader(schema, self.options)


def read_sqlite(
    spark: SparkSession, path: str, table: str, schema: str, rows_per_partition: int = 1_000_000
) -> DataFrame:
    spark.dataSource.register(SqliteSource)
    return (
        spark.read.format("sqlite_snapshot")
        .schema(schema)
        .option("dbtable", table)
        .option("rowsPartition", str(rows_per_partition))
        .load(path)
    )


def rows_from_bytes(files: DataFrame, table: str, schema: str) -> DataFrame:
    """The rows of one table out of SQLite files held as (path, content) rows."""
    names = T._parse_datatype_string(schema).fieldNames()
    query = f"SELECT {', '.join(_quoted(n) for n in names)} FROM {_quoted(table)}"

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for content in batch["content"]:
                connection = sqlite3.connect(":memory:")
                connection.deserialize(bytes(content))
                cursor = connection.execute(query)
                while rows := cursor.fetchmany(ROWS_PER_FETCH):
                    yield pd.DataFrame(rows, columns=names)
                connection.close()

    return files.select("content").mapInPandas(scan, schema)

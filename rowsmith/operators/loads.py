"""Loading tables: drafts, selection and renaming, order, staging and the import report."""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterable, Iterator, Mapping, Sequence
from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rowsmith.functions.names import distinct_names
from rowsmith.operators.coercion import coerce_columns, spark_type
from rowsmith.operators.inference import infer_columns

PREVIEW_ROWS = 8


@dataclass(frozen=True)
class ColumnDraft:
    source: str
    target: str
    inferred: str
    type: str
    contains_nulls: bool = False
    selected: bool = True


@dataclass(frozen=True)
class TableDraft:
    """What an import will do with one source table; edit it with ``with_column``."""

    name: str
    columns: tuple[ColumnDraft, ...]
    selected: bool = True

    def with_column(self, source: str, **changes: object) -> TableDraft:
        columns = tuple(replace(c, **changes) if c.source == source else c for c in self.columns)
        return replace(self, columns=columns)

    def warnings(self) -> list[str]:
        return [
            f"{self.name}.{c.target}: type {c.type} overrides the inferred {c.inferred}"
            for c in self.columns
            if c.selected and c.type != c.inferred
        ]


def draft_table(df: DataFrame, name: str) -> TableDraft:
    """Infer every column and propose clean, distinct names."""
    inferred = infer_columns(df)
    targets = distinct_names([c.name for c in inferred])
    return TableDraft(
        name,
        tuple(
            ColumnDraft(c.name, target, c.type, c.type, c.contains_nulls)
            for c, target in zip(inferred, targets)
        ),
    )


def preview(df: DataFrame, rows: int = PREVIEW_ROWS) -> DataFrame:
    return df.limit(rows)


def check_names(drafts: Iterable[TableDraft]) -> None:
    """Target names must be present and distinct; raises before any job runs."""
    tables = [d.name.strip() for d in drafts if d.selected]
    if "" in tables or len(set(tables)) != len(tables):
        raise ValueError("target table names must be present and unique")
    for draft in drafts:
        names = [c.target.strip() for c in draft.columns if c.selected]
        if "" in names or len(set(names)) != len(names):
            raise ValueError(f"column names of {draft.name} must be present and unique")
        for column in draft.columns:
            spark_type(column.type)


def apply_draft(df: DataFrame, draft: TableDraft, profile: str = "generic") -> DataFrame:
    """Select, coerce and rename by a draft, in one projection."""
    chosen = [c for c in draft.columns if c.selected]
    typed = coerce_columns(
        df.select(*[F.col(f"`{c.source}`") for c in chosen]),
        {c.source: c.type for c in chosen},
        profile,
    )
    return typed.toDF(*[c.target for c in chosen])


def load_order(references: Mapping[str, Sequence[str]]) -> list[str]:
    """Tables after the tables they refer to; raises on a cycle. Self references are fine."""
    waiting = {t: {p for p in ps if p != t and p in references} for t, ps in references.items()}
    order: list[str] = []
    while waiting:
        ready = [t for t, parents in waiting.items() if not parents]
        if not ready:
            raise ValueError(f"tables refer to each other in a cycle: {sorted(waiting)}")
        for table in ready:
            del waiting[table]
            order.append(table)
        for parents in waiting.values():
            parents.difference_update(ready)
    return order


PARTS = "rowsmith.parts"
LOAD = "rowsmith_load_"


def load_tables(
    spark: SparkSession,
    tables: Mapping[str, DataFrame],
    if_exists: str = "error",
    references: Mapping[str, Sequence[str]] | None = None,
) -> list[str]:
    """Write all tables, or none.

    Every load writes a new part, so an append neither reads nor rewrites old rows: a table of several parts is a view
    of them, one of a single part is that part under the table's name, and a property of either lists the parts. When all
    parts are written, one record names the parts of every table: from then on the load counts. The names are then
    given to the new parts, one table after the other, and the record goes. A failure on the way brings the old parts back; a process
    that dies leaves either no record (the old tables, and parts that ``orphan_parts`` lists) or a record that the
    next load carries out first (``finish_loads``).

    ``if_exists`` is ``error``, ``replace`` or ``append``. A plain table of that name becomes the first part.
    """
    before: dict[str, list[str] | None] = {}
    try:
        for _ in load_steps(spark, tables, if_exists, references, before):
            pass
    except BaseException:
        _undo(spark, before)
        raise
    return list(before)


def load_steps(
    spark: SparkSession,
    tables: Mapping[str, DataFrame],
    if_exists: str = "error",
    references: Mapping[str, Sequence[str]] | None = None,
    before: dict[str, list[str] | None] | None = None,
) -> Iterator[str]:
    """The steps of ``load_tables``, which runs them all; it can stop dead after any of them."""
    if if_exists not in ("error", "replace", "append"):
        raise ValueError(f"if_exists is error, replace or append, not {if_exists!r}")
    finish_loads(spark)
    order = load_order({t: (references or {}).get(t, ()) for t in tables})
    if if_exists == "error":
        taken = [t for t in order if spark.catalog.tableExists(t)]
        if taken:
            raise ValueError(f"tables already exist: {taken}")
    before = {} if before is None else before
    before |= {table: table_parts(spark, table) for table in order}
    yield "begun"
    after: dict[str, list[str]] = {}
    for table in order:
        part = f"{table}__part_{uuid.uuid4().hex}"
        rows = tables[table]
        if if_exists == "append" and before[table]:
            rows = _like(rows, spark.table(table).schema)
        rows.write.saveAsTable(part)
        spark.sql(f"ALTER TABLE {part} SET TBLPROPERTIES ('{PARTS}' = '{json.dumps([part])}')")
        after[table] = [*(before[table] or ()), part] if if_exists == "append" else [part]
        yield f"staged {table}"
    load = f"{LOAD}{uuid.uuid4().hex}"
    spark.sql(f"CREATE VIEW {load} TBLPROPERTIES ('{PARTS}' = '{json.dumps(after)}') AS SELECT 1 AS committed")
    yield "committed"
    for table in order:
        _publish(spark, after[table], table)
        yield f"published {table}"
    spark.sql(f"DROP VIEW {load}")
    yield "closed"
    for table in order:
        for part in set(before[table] or ()) - set(after[table]):
            spark.sql(f"DROP TABLE IF EXISTS {part}")
    yield "done"


def _like(rows: DataFrame, schema: T.StructType) -> DataFrame:
    """The rows under the names and types a table has; a missing or unknown column is an error, as in a union by name."""
    known, given = {f.name.lower() for f in schema}, {c.lower() for c in rows.columns}
    if known != given:
        raise ValueError(f"columns differ: {sorted(known ^ given)}")
    return rows.select(*[F.col(f"`{f.name}`").cast(f.dataType).alias(f.name) for f in schema])


def _property(spark: SparkSession, table: str) -> list[str] | dict[str, list[str]] | None:
    found = spark.sql(f"SHOW TBLPROPERTIES {table}").filter(F.col("key") == PARTS).first()
    return json.loads(found["value"]) if found else None


def _is_view(spark: SparkSession, table: str) -> bool:
    return spark.catalog.getTable(table).tableType == "VIEW"


def table_parts(spark: SparkSession, table: str) -> list[str] | None:
    """The parts of a table, None where there is no such table. One that no load made is to be a part of its own."""
    if not spark.catalog.tableExists(table):
        return None
    parts = _property(spark, table)
    if parts is None and _is_view(spark, table):
        raise ValueError(f"{table} is a view that no load made")
    return parts or [f"{table}__part_plain"]


def _publish(spark: SparkSession, parts: list[str], table: str) -> None:
    """Give the name to these parts; carrying it out again, also after half of it, changes nothing."""
    now = table_parts(spark, table)
    if now == parts:
        return
    if now is not None and _is_view(spark, table):
        if len(parts) == 1:
            spark.sql(f"DROP VIEW {table}")
    elif now is not None:
        spark.sql(f"ALTER TABLE {table} RENAME TO {now[0]}")
    if len(parts) == 1:
        spark.sql(f"ALTER TABLE {parts[0]} RENAME TO {table}")
        return
    rows = " UNION ALL ".join(f"SELECT * FROM {part}" for part in parts)
    spark.sql(f"CREATE OR REPLACE VIEW {table} TBLPROPERTIES ('{PARTS}' = '{json.dumps(parts)}') AS {rows}")


def _open_loads(spark: SparkSession) -> list[str]:
    return [row["viewName"] for row in spark.sql(f"SHOW VIEWS LIKE '{LOAD}*'").collect()]


def finish_loads(spark: SparkSession) -> list[str]:
    """Carry out loads that were recorded and then cut off; the tables they hold."""
    done = []
    for load in _open_loads(spark):
        for table, parts in _property(spark, load).items():
            _publish(spark, parts, table)
            done.append(table)
        spark.sql(f"DROP VIEW IF EXISTS {load}")
    return done


def _undo(spark: SparkSession, before: Mapping[str, list[str] | None]) -> None:
    """Back to the parts from before: no record of the load, old views, no new parts."""
    for load in _open_loads(spark):
        if _property(spark, load).keys() == before.keys():
            spark.sql(f"DROP VIEW {load}")
    for table, parts in before.items():
        if parts is None:
            drop_table(spark, table)
        else:
            _publish(spark, parts, table)
    for part in orphan_parts(spark, before):
        spark.sql(f"DROP TABLE IF EXISTS {part}")


def orphan_parts(spark: SparkSession, tables: Iterable[str]) -> list[str]:
    """Parts of the tables that no manifest names: what a load left that died before it was recorded."""
    found = []
    for table in tables:
        named = set(table_parts(spark, table) or ())
        for load in _open_loads(spark):
            named |= set(_property(spark, load).get(table, ()))
        stored = [r["tableName"] for r in spark.sql(f"SHOW TABLES LIKE '{table}__part_*'").collect()]
        found += [part for part in stored if part not in named]
    return found


def drop_table(spark: SparkSession, table: str) -> None:
    """Drop a table with all its parts, if it is there."""
    parts = table_parts(spark, table)
    if parts is None:
        return
    spark.sql(f"DROP {'VIEW' if _is_view(spark, table) else 'TABLE'} {table}")
    for part in parts:  # none is left of a table of one part
        spark.sql(f"DROP TABLE IF EXISTS {part}")


def import_report(tables: Mapping[str, DataFrame], warnings: Mapping[str, Iterable[str]] | None = None) -> DataFrame:
    """``table_name, row_count, column_count, columns, warnings`` of every table, one count each.

    ``warnings`` are what readers reported beside the rows, for example ``DelimitedTable.warnings``; they cost no scan.
    """
    counts = [
        df.agg(F.count("*").alias("row_count")).select(
            F.lit(name).alias("table_name"),
            "row_count",
            F.lit(len(df.columns)).alias("column_count"),
            F.lit(", ".join(f"{f.name} {f.dataType.simpleString()}" for f in df.schema)).alias(
                "columns"
            ),
            F.array(*map(F.lit, distinct_warnings((warnings or {}).get(name, ())))).cast("array<string>").alias("warnings"),
        )
        for name, df in tables.items()
    ]
    return reduce(DataFrame.unionByName, counts)


def distinct_warnings(warnings: Iterable[str]) -> list[str]:
    """Warnings without blanks and repeats, in first-seen order."""
    return list(dict.fromkeys(w.strip() for w in warnings if w.strip()))

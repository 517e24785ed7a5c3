"""Table constraints as jobs: each check returns the rows or keys that break it."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rowsmith.session import checkpointed


def null_violations(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """NOT NULL: the offending rows, once per NULL column, named in ``violated_column``."""
    missing = F.array_compact(F.array(*[F.when(F.col(c).isNull(), F.lit(c)) for c in columns]))
    return df.withColumn("violated_column", F.explode(missing))


def duplicate_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """UNIQUE: keys that occur more than once, with their count. Keys with NULL pass."""
    present = df.dropna(subset=list(keys))
    return present.groupBy(*keys).agg(F.count("*").alias("occurrences")).filter("occurrences > 1")


def primary_key_violations(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """PRIMARY KEY, single or composite: repeated keys and keys with NULL, in one aggregate."""
    counted = df.groupBy(*keys).agg(F.count("*").alias("occurrences"))
    has_null = F.lit(False)
    for key in keys:
        has_null = has_null | F.col(key).isNull()
    return counted.filter(has_null | (F.col("occurrences") > 1)).withColumn(
        "reason", F.when(has_null, F.lit("null key")).otherwise(F.lit("duplicate key"))
    )


def check_violations(df: DataFrame, check: str | Column) -> DataFrame:
    """CHECK: rows where the expression is false; unknown passes."""
    condition = F.expr(check) if isinstance(check, str) else check
    return df.filter(~condition)


def orphans(child: DataFrame, column: str, parent: DataFrame, parent_column: str) -> DataFrame:
    """FOREIGN KEY: child rows whose value has no parent. NULL passes."""
    keys = parent.select(F.col(parent_column).alias(column))
    return child.filter(F.col(column).isNotNull()).join(keys, column, "left_anti")


def cascade_delete(child: DataFrame, column: str, deleted: DataFrame) -> DataFrame:
    """Child rows that stay after their parents in ``deleted`` (one column) are gone."""
    keys = deleted.select(F.col(deleted.columns[0]).alias("deleted_key_"))
    return child.join(keys, child[column] == keys["deleted_key_"], "left_anti")


def cascade_update(child: DataFrame, column: str, renamed: DataFrame) -> DataFrame:
    """Child rows after parent keys change; ``renamed`` holds (old, new) with unique old."""
    keys = renamed.toDF("old_key_", "new_key_")
    joined = child.join(keys, child[column] == keys["old_key_"], "left")
    return joined.withColumn(column, F.coalesce("new_key_", column)).select(*child.columns)


@dataclass(frozen=True)
class Reference:
    """``child.column`` refers to ``parent.parent_column``; rows go with their parent, or lose the reference (``set null``)."""

    child: str
    column: str
    parent: str
    parent_column: str
    on_delete: str = "cascade"


def cascade_graph(
    tables: Mapping[str, DataFrame], keys: Mapping[str, Sequence[str]], references: Sequence[Reference], deleted: Mapping[str, DataFrame]
) -> dict[str, DataFrame]:
    """All tables after the rows of ``deleted`` and everything that depends on them are gone.

    ``keys`` names a unique key of each table, ``deleted`` has keys of rows to delete. Only rows that were deleted
    last are followed in each round, over every reference, so chains, self references and cycles end as soon as nothing new
    is found. Rounds follow the longest chain.
    """
    if any(r.on_delete not in ("cascade", "set null") for r in references):
        raise ValueError("on_delete is cascade or set null")
    new = {name: checkpointed(deleted[name].select(*keys[name]).distinct()) for name in deleted}
    gone = dict(new)
    while new:
        found: dict[str, DataFrame] = {}
        for r in (r for r in references if r.parent in new and r.on_delete == "cascade"):
            parents = _matching(tables[r.parent], new[r.parent], keys[r.parent]).select(F.col(r.parent_column).alias("parent_key_")).distinct()
            children = tables[r.child].join(parents, F.col(r.column) == F.col("parent_key_"), "left_semi").select(*keys[r.child])
            found[r.child] = found[r.child].unionAll(children) if r.child in found else children
        new = {}
        for name, rows in found.items():
            rows = rows.distinct()
            if name in gone:
                rows = rows.join(gone[name], list(keys[name]), "left_anti")
            rows = checkpointed(rows)
            if not rows.isEmpty():
                new[name] = rows
                gone[name] = gone[name].unionAll(rows) if name in gone else rows
    left = {name: _matching(df, gone[name], keys[name], "left_anti") if name in gone else df for name, df in tables.items()}
    for r in (r for r in references if r.on_delete == "set null" and r.parent in gone):
        lost = _matching(tables[r.parent], gone[r.parent], keys[r.parent]).select(F.col(r.parent_column).alias("lost_")).distinct()
        child = left[r.child]
        joined = child.join(lost, F.col(r.column) == F.col("lost_"), "left").withColumn(r.column, F.when(F.col("lost_").isNull(), F.col(r.column)))
        left[r.child] = joined.select(*child.columns)
    return left


def _matching(df: DataFrame, keys: DataFrame, names: Sequence[str], how: str = "left_semi") -> DataFrame:
    return df.join(keys, list(names), how).select(*df.columns)


def apply_defaults(df: DataFrame, defaults: Mapping[str, Column]) -> DataFrame:
    """DEFAULT: add the columns an insert leaves out; present columns keep their NULLs."""
    return df.withColumns({c: v for c, v in defaults.items() if c not in df.columns})


def generated_columns(df: DataFrame, expressions: Mapping[str, str]) -> DataFrame:
    """GENERATED ALWAYS AS (...) STORED: computed from the row when it is written."""
    return df.withColumns({name: F.expr(sql) for name, sql in expressions.items()})

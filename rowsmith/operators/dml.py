"""INSERT, UPDATE, DELETE, upsert and ALTER as rewrites of a table snapshot."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def insert(target: DataFrame, rows: DataFrame) -> DataFrame:
    """Append by column name; columns the new rows leave out are NULL."""
    return target.unionByName(rows, allowMissingColumns=True).select(*target.columns)


def update(target: DataFrame, changes: Mapping[str, Column], where: Column) -> DataFrame:
    """Changes see the old row, as in SQL; rows where the condition is unknown stay."""
    return target.select(
        *[
            F.when(where, changes[c]).otherwise(F.col(c)).alias(c) if c in changes else F.col(c)
            for c in target.columns
        ]
    )


def delete(target: DataFrame, where: Column) -> DataFrame:
    return target.filter(~F.coalesce(where, F.lit(False)))


def upsert(
    target: DataFrame, rows: DataFrame, keys: Sequence[str], do: str = "update"
) -> DataFrame:
    """ON CONFLICT (keys) DO UPDATE or DO NOTHING; keys are unique on both sides."""
    if do == "update":
        return target.join(rows.select(*keys), list(keys), "left_anti").unionByName(rows)
    if do == "nothing":
        return target.unionByName(rows.join(target.select(*keys), list(keys), "left_anti"))
    raise ValueError(f"unknown conflict action: {do}")


def update_returning(
    target: DataFrame, changes: Mapping[str, Column], where: Column, columns: Sequence[str]
) -> DataFrame:
    """RETURNING: the changed rows, after the change."""
    return update(target.filter(where), changes, F.lit(True)).select(*columns)


def delete_returning(target: DataFrame, where: Column, columns: Sequence[str]) -> DataFrame:
    return target.filter(where).select(*columns)


def alter(
    target: DataFrame,
    rename: Mapping[str, str] | None = None,
    add: Mapping[str, Column] | None = None,
    drop: Sequence[str] = (),
) -> DataFrame:
    """ALTER TABLE: drop, rename and add columns, one projection and no data movement."""
    altered = target.drop(*drop).withColumnsRenamed(dict(rename or {}))
    return altered.withColumns(dict(add)) if add else altered

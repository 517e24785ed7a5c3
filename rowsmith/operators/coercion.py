"""Coerce columns to the eight target types, and count what does not fit."""

from __future__ import annotations

import re
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rowsmith.functions import tokens as K

TARGET_TYPES = ("TEXT", "INTEGER", "BOOLEAN", "FLOAT64", "BLOB", "UUID", "DECIMAL(18,6)", "TIMESTAMP")

SPARK_TYPES = {
    "TEXT": "string",
    "INTEGER": "bigint",
    "BOOLEAN": "boolean",
    "FLOAT64": "double",
    "BLOB": "binary",
    "UUID": "string",
    "TIMESTAMP": "timestamp",
}


def spark_type(target: str) -> str:
    """The Spark type name behind a target type; declared decimals keep their digits."""
    if target in SPARK_TYPES:
        return SPARK_TYPES[target]
    if re.fullmatch(r"DECIMAL\(\d+(\s*,\s*\d+)?\)", target):
        return target.lower()
    raise ValueError(f"unknown target type: {target}")


def _to_text(value: Column, data_type: T.DataType) -> Column:
    if isinstance(data_type, T.BinaryType):
        return F.base64(value)
    if isinstance(data_type, (T.ArrayType, T.MapType, T.StructType, T.VariantType)):
        return F.to_json(value)
    return value.cast("string")


def _to_bytes(value: Column, data_type: T.DataType) -> Column:
    if isinstance(data_type, T.BinaryType):
        return value
    text = value.cast("string")
    if not isinstance(data_type, T.StringType):
        return F.encode(text, "UTF-8")
    # One byte per character, its low eight bits.
    low_bytes = F.transform(
        F.filter(F.split(text, ""), lambda ch: ch != ""),
        lambda ch: F.lpad(F.hex(F.ascii(ch).bitwiseAND(0xFF)), 2, "0"),
    )
    return F.when(
        text.rlike(r"^[\x00-\x7f]*$"), text.cast("binary")
    ).otherwise(F.unhex(F.array_join(low_bytes, "")))


def _parse_text(text: Column, target: str, profile: str) -> Column:
    if target == "BOOLEAN":
        return K.parse_boolean(text, profile)
    if target == "INTEGER":
        return K.parse_integer(text)
    if target == "FLOAT64":
        return K.parse_double(text)
    if target == "TIMESTAMP":
        # Workbooks and dumps hold ISO text only.
        iso_only = profile in ("workbook", "dump")
        return K.parse_iso_timestamp(text) if iso_only else K.parse_timestamp(text)
    return F.when(text.rlike(K.DOUBLE_PATTERN), text.try_cast(spark_type(target)))


def _needs_strip(data_type: T.DataType, target: str) -> bool:
    return isinstance(data_type, T.StringType) and target not in ("TEXT", "UUID", "BLOB")


def coerce(
    value: Column, data_type: T.DataType, target: str, profile: str = "generic"
) -> Column:
    """``value`` as ``target``; NULL where it does not fit. Text to parse is stripped text."""
    if target in ("TEXT", "UUID"):
        return _to_text(value, data_type)
    if target == "BLOB":
        return _to_bytes(value, data_type)
    if isinstance(data_type, T.StringType):
        return _parse_text(value, target, profile)
    if isinstance(data_type, T.NumericType):
        if target == "BOOLEAN":
            return F.when(value == 1, F.lit(True)).when(value == 0, F.lit(False))
        if target == "TIMESTAMP":
            return K.epoch_to_timestamp(value.try_cast("bigint"))
    return value.try_cast(spark_type(target))


def _with_stripped_text(df: DataFrame, targets: Mapping[str, str]) -> DataFrame:
    stripped = {
        f"__stripped_{field.name}": K.strip(F.col(f"`{field.name}`"))
        for field in df.schema.fields
        if field.name in targets and _needs_strip(field.dataType, targets[field.name])
    }
    return df.withColumns(stripped) if stripped else df


def _fitted(field: T.StructField, target: str, profile: str) -> Column:
    source = f"__stripped_{field.name}" if _needs_strip(field.dataType, target) else field.name
    return coerce(F.col(f"`{source}`"), field.dataType, target, profile)


def coerce_columns(
    df: DataFrame, targets: Mapping[str, str], profile: str = "generic"
) -> DataFrame:
    """Coerce the named columns; the others pass through.

    The profile picks the boolean words and date forms that a kind of source knows.
    """
    projected = []
    for field in df.schema.fields:
        target = targets.get(field.name)
        if target is None:
            projected.append(F.col(f"`{field.name}`"))
            continue
        metadata = {"logicalType": "uuid"} if target == "UUID" else {}
        projected.append(_fitted(field, target, profile).alias(field.name, metadata=metadata))
    return _with_stripped_text(df, targets).select(*projected)


def reject_counts(
    df: DataFrame, targets: Mapping[str, str], profile: str = "generic"
) -> DataFrame:
    """Per column: values present, values that do not fit the target type."""
    fields = [field for field in df.schema.fields if field.name in targets]
    aggregates = []
    for i, field in enumerate(fields):
        value = F.col(f"`{field.name}`")
        fitted = _fitted(field, targets[field.name], profile)
        aggregates += [
            F.count(value).alias(f"present{i}"),
            F.count_if(value.isNotNull() & fitted.isNull()).alias(f"rejected{i}"),
        ]
    rows = [
        F.struct(
            F.lit(field.name).alias("column_name"),
            F.lit(targets[field.name]).alias("target_type"),
            F.col(f"present{i}").alias("present"),
            F.col(f"rejected{i}").alias("rejected"),
        )
        for i, field in enumerate(fields)
    ]
    summary = _with_stripped_text(df, targets).agg(*aggregates)
    return summary.select(F.inline(F.array(*rows)))

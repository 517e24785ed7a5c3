"""``json_each`` and ``json_tree`` over a column of JSON text."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def json_type(value: Column) -> Column:
    """object, array, string, number, boolean or null."""
    kind = F.schema_of_variant(value)
    return (
        F.when(value.isNull() | (kind == "VOID"), "null")
        .when(kind.startswith("OBJECT"), "object")
        .when(kind.startswith("ARRAY"), "array")
        .when(kind == "STRING", "string")
        .when(kind == "BOOLEAN", "boolean")
        .otherwise("number")
    )


def variant_text(value: Column) -> Column:
    """Strings without quotes, objects and lists as JSON text."""
    return F.try_variant_get(value, "$", "string")


def _explode(df: DataFrame, column: str) -> DataFrame:
    """One row per member of the object or list in a variant column."""
    view = df.alias("outer_")
    members = df.sparkSession.tvf.variant_explode(F.col(column).outer())
    return view.lateralJoin(members)


def json_each(df: DataFrame, column: str, keep: tuple[str, ...] = ()) -> DataFrame:
    """``keep..., key, value, type``: the direct members of each document."""
    parsed = df.select(*keep, F.parse_json(F.col(column)).alias("doc_"))
    rows = _explode(parsed, "doc_")
    return rows.select(
        *keep,
        F.coalesce(F.col("key"), F.col("pos").cast("string")).alias("key"),
        variant_text(F.col("value")).alias("value"),
        json_type(F.col("value")).alias("type"),
    )


def _text_and_type(node: object) -> tuple[str | None, str]:
    if node is None:
        return None, "null"
    if isinstance(node, str):
        return node, "string"
    if isinstance(node, bool):
        return str(node).lower(), "boolean"
    if isinstance(node, (dict, list)):
        return json.dumps(node, sort_keys=True, separators=(",", ":"), ensure_ascii=False), "object" if isinstance(node, dict) else "array"
    return json.dumps(node), "number"


def _nodes(document: object) -> Iterator[tuple[str | None, str | None, str, str]]:
    """``key, value, type, path`` of a document and all below it, by an explicit stack."""
    stack: list[tuple[str | None, str, object]] = [(None, "$", document)]
    while stack:
        key, path, node = stack.pop()
        yield key, *_text_and_type(node), path
        if isinstance(node, dict):
            stack += [(name, f"{path}.{name}", value) for name, value in node.items()]
        elif isinstance(node, list):
            stack += [(str(i), f"{path}[{i}]", value) for i, value in enumerate(node)]


def _trees(column: str) -> Callable:
    names = ["key", "value", "type", "path"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept = [n for n in batch.schema.names if n != column]
            rows: list[tuple] = []
            places: list[int] = []

            def flush() -> pa.RecordBatch:
                at = pa.array(places, pa.int32())
                columns = list(zip(*rows, strict=True)) if rows else [()] * 4
                made = [*(batch.column(n).take(at) for n in kept), *(pa.array(c, pa.string()) for c in columns)]
                rows.clear()
                places.clear()
                return pa.RecordBatch.from_arrays(made, [*kept, *names])

            for place, text in enumerate(batch.column(column).to_pylist()):
                for node in _nodes(None if text is None else json.loads(text)):
                    rows.append(node)
                    places.append(place)
                    if len(rows) == 10_000:
                        yield flush()
            yield flush()

    return run


def json_tree(df: DataFrame, column: str, keep: tuple[str, ...] = ()) -> DataFrame:
    """``keep..., key, value, type, path``: every value of each document, at any level.

    Each document is parsed once and expanded by a stack, whatever its depth and however its types are mixed: one scan,
    no schema, no shuffle. A NULL document is one ``null``; text that is not JSON is an error.
    """
    own = df.select(*keep, F.col(column).cast("string").alias("doc_"))
    schema = T.StructType([*own.schema.fields[:-1], *[T.StructField(n, T.StringType()) for n in ("key", "value", "type", "path")]])
    return own.mapInArrow(_trees("doc_"), schema)

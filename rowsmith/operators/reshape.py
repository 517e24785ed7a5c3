"""Nested records as flat tables: flatten, or normalize into parent and child tables.

Both walk the schema on the driver and emit plain projections and explodes. Row ids are
paths (``42/items/0``), built from the parent's id and the position, so ids are unique
and repeatable without a global counter, a sort or a shuffle.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable, Iterator, Mapping
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rowsmith.session import checkpointed, scratch_folder

ID = "_import_id"
PARENT_ID = "parent_id"


@dataclass(frozen=True)
class ParentRelation:
    """``child.parent_id`` refers to ``parent._import_id``."""

    parent: str
    child_column: str = PARENT_ID
    parent_column: str = ID


@dataclass
class NormalizedTables:
    tables: dict[str, DataFrame] = field(default_factory=dict)
    relations: dict[str, ParentRelation] = field(default_factory=dict)


def _joined_lists(lists: Column, kind: T.ArrayType) -> Column:
    """The items of all lists; a NULL among the lists stays one NULL item."""
    none = F.array(F.lit(None).cast(kind.elementType))
    return F.flatten(F.transform(lists, lambda one: F.coalesce(one, none)))


def _get(value: Column, name: str) -> Column:
    return value.getField(name)


def flat_columns(value: Column, kind: T.DataType, prefix: str = "") -> Iterator[tuple[str, Column]]:
    """``a__b`` columns for objects inside objects; lists as JSON text; a scalar is ``value``."""
    if not isinstance(kind, T.StructType):
        yield prefix or "value", value
        return
    for f in kind.fields:
        name = f"{prefix}__{f.name}" if prefix else f.name
        inner = _get(value, f.name)
        if isinstance(f.dataType, T.StructType):
            yield from flat_columns(inner, f.dataType, name)
        elif isinstance(f.dataType, (T.ArrayType, T.MapType, T.VariantType)):
            yield name, F.to_json(inner)
        else:
            yield name, inner


def named_columns(pairs: Iterable[tuple[str, Column]]) -> list[Column]:
    """One column per name; where a key equals a flattened name, the later one stays."""
    return [value.alias(name) for name, value in dict(pairs).items()]


def flatten(df: DataFrame, record: str, keep: tuple[str, ...] = ()) -> DataFrame:
    """One row per record, nested objects as ``__`` joined columns."""
    kind = df.schema[record].dataType
    return df.select(*keep, *named_columns(flat_columns(F.col(record), kind)))


def drift_union(frames: list[DataFrame]) -> DataFrame:
    """Union of record batches with different keys: first-seen order, absent is NULL."""
    union = frames[0]
    for frame in frames[1:]:
        union = union.unionByName(frame, allowMissingColumns=True)
    return union


def has_nested_list(kind: T.DataType) -> bool:
    if isinstance(kind, T.ArrayType):
        return True
    return isinstance(kind, T.StructType) and any(has_nested_list(f.dataType) for f in kind.fields)


def _split(
    value: Column, kind: T.StructType, prefix: str = ""
) -> tuple[list[tuple[str, Column]], list[tuple[str, Column, T.ArrayType]]]:
    """Own columns and child lists of an object.

    Objects that hold a list somewhere join names by ``_``; objects without use ``__``.
    """
    own: list[tuple[str, Column]] = []
    children: list[tuple[str, Column, T.ArrayType]] = []
    for f in kind.fields:
        name = f"{prefix}_{f.name}" if prefix else f.name
        inner = _get(value, f.name)
        if isinstance(f.dataType, T.ArrayType):
            children.append((name, inner, f.dataType))
        elif isinstance(f.dataType, T.StructType) and has_nested_list(f.dataType):
            deeper, below = _split(inner, f.dataType, name)
            own += deeper
            children += below
        elif isinstance(f.dataType, T.StructType):
            own += list(flat_columns(inner, f.dataType, name))
        else:
            own.append((name, inner))
    return own, children


def union_tables(first: DataFrame, second: DataFrame) -> DataFrame:
    """Rows of both; a column they type differently becomes text, one they lack is NULL."""
    kinds = dict(second.dtypes)
    odd = [n for n, kind in first.dtypes if kinds.get(n, kind) != kind]
    for name in odd:
        first, second = (t.withColumn(name, F.col(f"`{name}`").cast("string")) for t in (first, second))
    return first.unionByName(second, allowMissingColumns=True)


def normalize(
    df: DataFrame, record: str, name: str, key: str | None = None
) -> NormalizedTables:
    """Parent and child tables of a struct column.

    ``key`` is a unique column that becomes the root id; without one, rows are numbered. The records are scanned and
    parsed once and written; each table reads what it needs of them, so all see the same ids.
    """
    result = NormalizedTables()
    root = F.monotonically_increasing_id() if key is None else F.col(key)
    _add_table(result, _written(df.select(root.cast("string").alias(ID), F.col(record).alias("record_"))), name, None)
    return result


def _storable(kind: T.DataType) -> bool:
    """Whether Parquet holds the type: no object without fields, no names that differ in case only, no variants."""
    if isinstance(kind, T.StructType):
        names = {f.name.lower() for f in kind.fields}
        return len(names) == len(kind.fields) > 0 and all(_storable(f.dataType) for f in kind.fields)
    if isinstance(kind, T.ArrayType):
        return _storable(kind.elementType)
    return not isinstance(kind, (T.VariantType, T.NullType, T.MapType))


def _written(df: DataFrame) -> DataFrame:
    """Written once as columns, so that readers prune; a checkpoint where Parquet can't hold the type."""
    if not _storable(df.schema):
        return checkpointed(df)
    path = scratch_folder(df.sparkSession, "records")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _add_table(
    result: NormalizedTables, source: DataFrame, name: str, parent: str | None
) -> None:
    kind = source.schema["record_"].dataType
    keys = [ID] if parent is None else [ID, PARENT_ID]
    if parent is not None:
        result.relations[name] = ParentRelation(parent)
    def add(table: DataFrame) -> None:
        known = result.tables.get(name)
        result.tables[name] = table if known is None else union_tables(known, table)

    if not isinstance(kind, T.StructType):
        add(source.select(*keys, F.col("record_").alias("value")))
        return
    own, children = _split(F.col("record_"), kind)
    add(source.select(*keys, *named_columns(own)))
    met: Counter[str] = Counter()
    for child, items, list_kind in children:
        met[child] += 1
        # Two lists of one name share a table; their ids stay apart.
        step = child if met[child] == 1 else f"{child}~{met[child]}"
        # A list inside a list adds its items to the same child table.
        while isinstance(list_kind.elementType, T.ArrayType):
            items, list_kind = _joined_lists(items, list_kind.elementType), list_kind.elementType
        # The outer form, as the inner one makes Spark parse the record again in a filter.
        listed = source.select(
            F.col(ID).alias(PARENT_ID), F.posexplode_outer(items).alias("pos_", "record_")
        )
        exploded = listed.filter("pos_ IS NOT NULL").select(
            F.concat_ws("/", PARENT_ID, F.lit(step), F.col("pos_").cast("string")).alias(ID),
            PARENT_ID,
            "record_",
        )
        _add_table(result, exploded, f"{name}_{child}", name)


def join_child(
    tables: Mapping[str, DataFrame], relations: Mapping[str, ParentRelation], child: str
) -> DataFrame:
    """A child table next to its parent's columns, which are prefixed by ``parent__``."""
    relation = relations[child]
    parent = tables[relation.parent]
    renamed = parent.select(
        *[F.col(f"`{c}`").alias(f"parent__{c.lstrip('_')}") for c in parent.columns]
    )
    on = tables[child][relation.child_column] == renamed[
        f"parent__{relation.parent_column.lstrip('_')}"
    ]
    return tables[child].join(renamed, on, "inner")

"""Column type inference from every value of a table, in one aggregate.

Each value is turned into a bit set of the shapes it fits. Two bit aggregates and a
count per column then say what all values, and what any value, look like. The
aggregate is partial on the map side, so a task shuffles one row per column, whatever
the size of the table or the skew of its values.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rowsmith.functions import names as N
from rowsmith.functions import tokens as K

BOOLEAN_WORD = 1 << 0
ZERO_OR_ONE = 1 << 1
MEANS_TRUE = 1 << 2
MEANS_FALSE = 1 << 3
UUID = 1 << 4
TEMPORAL_SHAPE = 1 << 5
TIMESTAMP = 1 << 6
TIMESTAMP_OR_EPOCH = 1 << 7
INTEGER = 1 << 8
LEADING_ZERO = 1 << 9
FIXED_POINT = 1 << 10
HAS_POINT = 1 << 11
DOUBLE = 1 << 12
BYTES = 1 << 13
STRICT_UUID = 1 << 14
SHORT_BOOLEAN_WORD = 1 << 15


@dataclass(frozen=True)
class InferredColumn:
    name: str
    type: str
    contains_nulls: bool


def _bit(condition: Column, bit: int) -> Column:
    return F.when(condition, F.lit(bit)).otherwise(F.lit(0))


KNOWN_WORDS = (
    *K.TRUE_TOKENS,
    *K.FALSE_TOKENS,
    *K.POSITIVE_INFINITY_TOKENS,
    *K.NEGATIVE_INFINITY_TOKENS,
    *K.NAN_TOKENS,
)


def _word_shapes(word: Column) -> Column:
    short_true, short_false = K.BOOLEAN_TOKENS["sqlite"]
    return (
        F.when(word.isin(*short_true), F.lit(BOOLEAN_WORD | SHORT_BOOLEAN_WORD | MEANS_TRUE))
        .when(word.isin(*short_false), F.lit(BOOLEAN_WORD | SHORT_BOOLEAN_WORD | MEANS_FALSE))
        .when(word.isin(*K.TRUE_TOKENS), F.lit(BOOLEAN_WORD | MEANS_TRUE))
        .when(word.isin(*K.FALSE_TOKENS), F.lit(BOOLEAN_WORD | MEANS_FALSE))
        .otherwise(F.lit(DOUBLE))
    )


def _integer_text_shapes(text: Column, number: Column) -> Column:
    switch = BOOLEAN_WORD | ZERO_OR_ONE | SHORT_BOOLEAN_WORD
    return _any_of(
        [
            F.lit(DOUBLE | INTEGER),
            _bit(text == "1", switch | MEANS_TRUE),
            _bit(text == "0", switch | MEANS_FALSE),
            _bit((F.length(text) > 1) & text.startswith("0"), LEADING_ZERO),
            _bit(~text.startswith("+"), FIXED_POINT),
            _bit(number.between(0, K.MAX_EPOCH_MILLIS), TIMESTAMP_OR_EPOCH),
            # Eight digits are a compact date.
            _bit(
                F.length(text).isin(8, 9) & text.rlike(K.LOOSE_ISO_PATTERN),
                TIMESTAMP | TIMESTAMP_OR_EPOCH,
            ),
        ]
    )


def _decimal_text_shapes(text: Column) -> Column:
    # A fixed-point number is one without exponent, plus sign or bare point.
    loose = text.startswith("+") | text.startswith(".") | text.startswith("-.") | text.endswith(".")
    fixed = ~(text.contains("e") | text.contains("E") | loose)
    return _any_of(
        [F.lit(DOUBLE), _bit(fixed, FIXED_POINT), _bit(text.contains("."), HAS_POINT)]
    )


def _date_text_shapes(text: Column) -> Column:
    # ISO components roll over, so every ISO-shaped text is an instant.
    parsed = text.rlike(K.LOOSE_ISO_PATTERN) | K.parse_day_first_or_clock(text).isNotNull()
    return _any_of(
        [
            _bit(text.rlike(K.TEMPORAL_SHAPE_PATTERN), TEMPORAL_SHAPE),
            _bit(parsed, TIMESTAMP | TIMESTAMP_OR_EPOCH),
        ]
    )


def _uuid_shapes(text: Column) -> Column:
    return F.when(text.rlike(K.STRICT_UUID_PATTERN), F.lit(UUID | STRICT_UUID)).when(
        text.rlike(K.UUID_PATTERN), F.lit(UUID)
    )


def _starts_like_number(text: Column) -> Column:
    return text.between("0", ":") | text.between("+", "/")


def _text_shapes(text: Column, number: Column, word: Column) -> Column:
    """Shapes of stripped text; each test runs only on text that can still pass it."""
    numeric = (
        F.when(number.isNotNull(), _integer_text_shapes(text, number))
        .when(text.rlike(K.DOUBLE_PATTERN), _decimal_text_shapes(text))
        .when(
            text.rlike(K.PLAIN_ISO_PATTERN),
            F.lit(TEMPORAL_SHAPE | TIMESTAMP | TIMESTAMP_OR_EPOCH),
        )
        .when(F.length(text) == 36, F.coalesce(_uuid_shapes(text), F.lit(0)))
        .when(text.rlike(K.HEX_PATTERN), F.lit(INTEGER))
        .when(word.isin(*KNOWN_WORDS), _word_shapes(word))
        .otherwise(_date_text_shapes(text))
    )
    return (
        F.when(_starts_like_number(text), numeric)
        .when(F.length(text) == 36, F.coalesce(_uuid_shapes(text), F.lit(0)))
        .when(word.isin(*KNOWN_WORDS), _word_shapes(word))
        .otherwise(F.lit(0))
    )


def _any_of(bits: Sequence[Column]) -> Column:
    shapes = bits[0]
    for bit in bits[1:]:
        shapes = shapes.bitwiseOR(bit)
    return shapes


def _double_shapes(value: Column) -> Column:
    whole = value == F.round(value)
    return _any_of(
        [
            F.lit(HAS_POINT | DOUBLE),
            _bit(~F.isnan(value) & (F.abs(value) < float("inf")), FIXED_POINT),
            _bit(whole, INTEGER),
            _bit(value.isin(0.0, 1.0), BOOLEAN_WORD | ZERO_OR_ONE),
            _bit(value == 1.0, MEANS_TRUE),
            _bit(value == 0.0, MEANS_FALSE),
            _bit(whole & value.between(0, K.MAX_EPOCH_MILLIS), TIMESTAMP_OR_EPOCH),
        ]
    )


def _kind_of(data_type: T.DataType) -> str:
    """How the values of a Spark type are judged; integers and booleans read like text."""
    if isinstance(data_type, (T.StringType, T.IntegralType, T.BooleanType)):
        return "text"
    if isinstance(data_type, T.NumericType):
        return "double"
    if isinstance(data_type, (T.TimestampType, T.TimestampNTZType, T.DateType)):
        return "time"
    return "bytes" if isinstance(data_type, T.BinaryType) else "nested"


def _long_form(df: DataFrame, kinds: list[str]) -> DataFrame:
    """``position, value``: one row per cell, its value as text."""
    cells = []
    for i, (field, kind) in enumerate(zip(df.schema.fields, kinds)):
        value = F.col(f"`{field.name}`")
        if kind in ("text", "double"):
            text = value.cast("string")
        else:
            text = F.when(value.isNotNull(), F.lit(""))
        cells += [F.lit(i), text]
    return df.select(F.stack(F.lit(len(kinds)), *cells).alias("position", "value"))


def _shapes(kinds: list[str]) -> Column:
    """The shapes of a cell by the kind of its column; mostly there is only text."""
    text = F.col("text")
    per_kind = {
        "text": _text_shapes(text, F.col("number"), F.col("word")),
        "double": _double_shapes(text.cast("double")),
        "time": F.lit(TEMPORAL_SHAPE | TIMESTAMP | TIMESTAMP_OR_EPOCH),
        "bytes": F.lit(BYTES),
        "nested": F.lit(0),
    }
    present = sorted(set(kinds))
    shapes = per_kind[present[-1]]
    for kind in present[:-1]:
        positions = [i for i, k in enumerate(kinds) if k == kind]
        shapes = F.when(F.col("position").isin(positions), per_kind[kind]).otherwise(shapes)
    return shapes


def evidence_frame(df: DataFrame) -> DataFrame:
    """One row per column of ``df``: name, non-null and null counts, shape bit sets.

    Cells are unpivoted inside the scan's task, so one small expression serves any number
    of columns; each task then hands on one row per column.
    """
    kinds = [_kind_of(field.dataType) for field in df.schema.fields]
    text = F.col("text")
    # Staged projections, so that no intermediate value is computed twice. A cast that
    # fails is slow, so only digits get that far.
    cells = _long_form(df, kinds).select("position", K.strip(F.col("value")).alias("text"))
    cells = cells.withColumns(
        {
            "number": F.when(text.rlike(K.INTEGER_PATTERN), text.try_cast("bigint")),
            "word": F.when((F.length(text) <= 9) & ~text.between("0", ":"), F.lower(text)),
        }
    )
    judged = cells.select("position", F.when(text.isNotNull(), _shapes(kinds)).alias("shapes"))
    names = F.array(*[F.lit(field.name) for field in df.schema.fields])
    found = judged.groupBy("position").agg(
        F.count("shapes").alias("non_null"),
        F.count_if(F.col("shapes").isNull()).alias("nulls"),
        F.coalesce(F.bit_and("shapes"), F.lit(0)).alias("every"),
        F.coalesce(F.bit_or("shapes"), F.lit(0)).alias("some"),
    )
    return found.select(F.get(names, F.col("position")).alias("name"), "non_null", "nulls", "every", "some")


def _all(bit: int, bits: str = "every") -> Column:
    return F.col(bits).bitwiseAND(bit) != 0


def _any(bit: int) -> Column:
    return _all(bit, "some")


def _hints(pattern: re.Pattern) -> Column:
    return F.lower(F.trim("name")).rlike(pattern.pattern)


def decided_type() -> Column:
    """The target type of an evidence row, by fixed precedence and hints in its name."""
    boolean = _all(BOOLEAN_WORD) & (
        ~_all(ZERO_OR_ONE) | _hints(N.BOOLEAN_NAME) | (_any(MEANS_TRUE) & _any(MEANS_FALSE))
    )
    timestamp = (_hints(N.TEMPORAL_NAME) & _all(TIMESTAMP_OR_EPOCH)) | (
        _any(TEMPORAL_SHAPE) & _all(TIMESTAMP)
    )
    decimal = _hints(N.DECIMAL_NAME) & _all(FIXED_POINT) & _any(HAS_POINT)
    return (
        F.when(F.col("non_null") == 0, "TEXT")
        .when(boolean, "BOOLEAN")
        .when(_all(UUID), "UUID")
        .when(timestamp, "TIMESTAMP")
        .when(_all(INTEGER), F.when(_any(LEADING_ZERO), "TEXT").otherwise("INTEGER"))
        .when(decimal, "DECIMAL(18,6)")
        .when(_all(DOUBLE), "FLOAT64")
        .when(_all(BYTES), "BLOB")
        .otherwise("TEXT")
    )


def refined_type(declared: Column) -> Column:
    """A declared TEXT or INTEGER type upgraded by the evidence of a sample."""
    timestamps = F.when(_hints(N.TEMPORAL_NAME), _all(TIMESTAMP_OR_EPOCH)).otherwise(
        _all(TIMESTAMP)
    )
    from_text = (
        F.when(_all(STRICT_UUID), "UUID")
        .when(_all(SHORT_BOOLEAN_WORD), "BOOLEAN")
        .when(timestamps, "TIMESTAMP")
    )
    from_integer = F.when(
        _hints(N.BOOLEAN_NAME) & _all(SHORT_BOOLEAN_WORD), "BOOLEAN"
    ).when(_hints(N.TEMPORAL_NAME) & timestamps, "TIMESTAMP")
    upgrade = F.when(declared == "TEXT", from_text).when(declared == "INTEGER", from_integer)
    return F.coalesce(F.when(F.col("non_null") > 0, upgrade), declared)


def type_frame(df: DataFrame) -> DataFrame:
    """``column_name, target_type, contains_nulls``, one row per column, as a plan."""
    return evidence_frame(df).select(
        F.col("name").alias("column_name"),
        decided_type().alias("target_type"),
        (F.col("nulls") > 0).alias("contains_nulls"),
    )


def infer_columns(df: DataFrame) -> list[InferredColumn]:
    """Run the scan; what reaches the driver is one small row per column."""
    found = {
        r["column_name"]: InferredColumn(r["column_name"], r["target_type"], r["contains_nulls"])
        for r in type_frame(df).collect()
    }
    return [found.get(name, InferredColumn(name, "TEXT", False)) for name in df.columns]


def infer_types(df: DataFrame) -> dict[str, str]:
    return {column.name: column.type for column in infer_columns(df)}


def refined_frame(
    df: DataFrame, declared: dict[str, str], sample_rows: int = 64
) -> DataFrame:
    """``column_name, target_type``: declared types, upgraded by the first rows.

    Those are read here and now, from the first partition that has any: the rest of the table is not touched.
    """
    names = [F.col(f"`{name}`") for name in declared]
    pairs = [x for name, kind in declared.items() for x in (F.lit(name), F.lit(kind))]
    given = F.create_map(*pairs)[F.col("name")]
    rows = df.select(*names)
    sample = evidence_frame(df.sparkSession.createDataFrame(rows.head(sample_rows), rows.schema))
    return sample.select(
        F.col("name").alias("column_name"), refined_type(given).alias("target_type")
    )


def refine_types(df: DataFrame, declared: dict[str, str], sample_rows: int = 64) -> dict[str, str]:
    found = refined_frame(df, declared, sample_rows).collect()
    return {**declared, **{r["column_name"]: r["target_type"] for r in found}}

"""CSV export: value rendering, quoting and the distributed writer."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def iso_instant(value: Column) -> Column:
    """``2024-01-15T10:20:30.123Z``; microseconds appear only where they are not zero."""
    base = F.date_format(value, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    return F.concat(F.regexp_replace(base, r"000$", ""), F.lit("Z"))


def render(value: Column, kind: T.DataType) -> Column:
    """A cell as export text; NULL is empty."""
    if isinstance(kind, T.BinaryType):
        text = F.base64(value)
    elif isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        text = iso_instant(value)
    elif isinstance(kind, (T.ArrayType, T.MapType, T.StructType)):
        text = F.to_json(value)
    else:
        text = value.cast("string")
    return F.coalesce(text, F.lit(""))


def rendered(df: DataFrame) -> DataFrame:
    return df.select(*[render(F.col(f"`{f.name}`"), f.dataType).alias(f.name) for f in df.schema])


def escape_cell(text: Column, delimiter: str = ",") -> Column:
    """Quote a cell that holds the delimiter, a quote or a line end; double its quotes."""
    special = (
        F.contains(text, F.lit(delimiter))
        | F.contains(text, F.lit('"'))
        | F.contains(text, F.lit("\n"))
        | F.contains(text, F.lit("\r"))
    )
    doubled = F.replace(text, F.lit('"'), F.lit('""'))
    return F.when(special, F.concat(F.lit('"'), doubled, F.lit('"'))).otherwise(text)


def csv_line(df: DataFrame, delimiter: str = ",") -> Column:
    """The export line of a row, as one column expression over ``df``."""
    cells = [escape_cell(render(F.col(f"`{f.name}`"), f.dataType), delimiter) for f in df.schema]
    return F.concat_ws(delimiter, *cells)


def write_csv(
    df: DataFrame, path: str, delimiter: str = ",", header: bool = True, mode: str = "errorifexists"
) -> None:
    """Write a query result as CSV part files, in parallel and without a driver pass."""
    rendered(df).write.mode(mode).csv(
        path,
        sep=delimiter,
        header=header,
        quote='"',
        escape='"',
        emptyValue="",
        nullValue="",
        ignoreLeadingWhiteSpace=False,
        ignoreTrailingWhiteSpace=False,
    )

"""GZip and ZIP wrappers over ``binaryFile`` style rows (path, content)."""

from __future__ import annotations

import gzip
import io
import zipfile
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from rowsmith.session import small_batches
from rowsmith.sources.formats import detect_format, format_of_name, gzip_inner_name


def _gunzip_all(content: pd.Series) -> pd.Series:
    return content.map(gzip.decompress)


def gunzip(content: Column) -> Column:
    """Unpack gzip bytes in a column; for ``.gz`` paths Spark's own codec does this."""
    return pandas_udf(_gunzip_all, "binary")(content)


_MEMBERS = pa.schema([("path", pa.string()), ("member", pa.string()), ("content", pa.binary())])
#: Bytes of unpacked members that leave a task together.
MEMBER_BYTES = 4 << 20


def _list_members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    found, held = [], 0
    for batch in batches:
        # One archive at a time, so a task never holds more than one unpacked member and what is about to leave.
        for path, content in zip(batch.column("path"), batch.column("content")):
            with zipfile.ZipFile(io.BytesIO(content.as_py())) as archive:
                for info in archive.infolist():
                    if info.is_dir() or format_of_name(info.filename) == "unknown":
                        continue
                    found.append((path.as_py(), info.filename, archive.read(info)))
                    held += len(found[-1][2])
                    if held >= MEMBER_BYTES:
                        yield _member_batch(found)
                        found, held = [], 0
    if found:
        yield _member_batch(found)


def _member_batch(found: list[tuple]) -> pa.RecordBatch:
    columns = [pa.array(c, f.type) for c, f in zip(zip(*found, strict=True), _MEMBERS, strict=True)]
    return pa.RecordBatch.from_arrays(columns, schema=_MEMBERS)


def zip_members(archives: DataFrame) -> DataFrame:
    """``path, member, content, format``: the members of recognised formats."""
    packed = archives.select(F.col("path").cast("string").alias("path"), F.col("content").cast("binary").alias("content"))
    members = small_batches(packed).mapInArrow(_list_members, "path string, member string, content binary")
    return members.withColumn("format", detect_format(F.col("member")))


def gzip_candidates(archives: DataFrame, path: str = "path") -> DataFrame:
    """The inner name and format of gzip wrappers whose inner name is recognised."""
    inner = archives.withColumn("member", gzip_inner_name(F.col(path))).withColumn(
        "format", detect_format(F.col("member"))
    )
    return inner.filter(F.col("format.format_key") != "unknown")

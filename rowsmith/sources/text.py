"""Line and byte level reading: encodings and ordered lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def decode_bytes(content: Column, encoding: str = "auto") -> Column:
    """Bytes to text: ``utf8``, ``latin1``, or UTF-8 with Latin-1 where it is not valid."""
    latin1 = F.decode(content, "ISO-8859-1")
    if encoding == "latin1":
        return latin1
    utf8 = content.cast("string")
    if encoding == "utf8":
        return utf8
    return F.when(F.is_valid_utf8(utf8), utf8).otherwise(latin1)


def raw_lines(spark: SparkSession, path: str) -> DataFrame:
    """``file, block, pos, line``: the lines of text files, in order of (block, pos); ``file`` is a hash of the path.

    The scan splits large files.
    """
    return spark.read.text(path).select(
        F.xxhash64("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("pos"),
        F.col("value").alias("line"),
    )


def decode_lines(lines: DataFrame, encoding: str, latin1_files: DataFrame | None) -> DataFrame:
    """Fix the text of Latin-1 files; a file is Latin-1 as a whole, as an editor reads it."""
    latin1 = F.decode(F.col("line").cast("binary"), "ISO-8859-1")
    if encoding == "latin1":
        return lines.withColumn("line", latin1)
    if latin1_files is None:
        return lines
    flagged = lines.join(latin1_files.withColumn("latin1_", F.lit(True)), "file", "left")
    return flagged.withColumn(
        "line", F.when(F.col("latin1_"), latin1).otherwise(F.col("line"))
    ).drop("latin1_")


WHOLE_LINES = {"quote": "", "header": "true", "encoding": "ISO-8859-1", "maxCharsPerColumn": "-1"}


def lines_below_header(spark: SparkSession, path: str, unused_mark: str) -> DataFrame:
    """``file, line`` of all lines below the header that are not blank.

    Spark's CSV reader drops the first line of each file where the file begins, so files
    still split and no row has to be matched. Bytes pass through unchanged, as no line holds
    ``unused_mark``.
    """
    if not unused_mark:
        raise ValueError(f"{path} holds every control character; none is left to read whole lines by")
    body = spark.read.options(**WHOLE_LINES, sep=unused_mark).schema("line string").csv(path)
    as_bytes = F.encode(F.col("line"), "ISO-8859-1").cast("string")
    return body.select(F.xxhash64("_metadata.file_path").alias("file"), as_bytes.alias("line"))

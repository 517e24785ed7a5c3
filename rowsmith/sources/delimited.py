"""Delimited text: CSV, TSV and any other single or multi character delimiter.

Fields are cut by one regular expression with possessive repeats, which runs inside
the JVM in time linear in the line. Quoting, escaping, header naming, short rows and
blank rows follow the options.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F

from rowsmith.functions.names import distinct_names, header_names
from rowsmith.functions.tokens import blank_to_null, strip
from rowsmith.sources.sections import LINE_MARKS, QuotedFields, block_facts, cut_records, open_files, raw_blocks
from rowsmith.sources.text import decode_bytes, decode_lines, lines_below_header, raw_lines

# The delimiters that sniffing considers, in order of preference.
SNIFFED_DELIMITERS = (",", "\t", ";", "|")
SNIFFED_LINES = 10
CONSISTENT_BONUS = 100


@dataclass(frozen=True)
class DelimitedOptions:
    delimiter: str = ","
    quote: str = '"'
    escape: str = '"'
    header: bool = True
    malformed: str = "pad"  # or "skip"
    encoding: str = "auto"  # or "utf8", "latin1"


FORMAT_OPTIONS = {
    "csv": DelimitedOptions(),
    "tsv": DelimitedOptions(delimiter="\t"),
    "psv": DelimitedOptions(delimiter="|"),
}


@dataclass(frozen=True)
class DelimitedTable:
    """String-typed rows plus what the reader learned about the source."""

    rows: DataFrame
    columns: list[str]
    delimiter: str
    skipped_rows: int
    warnings: tuple[str, ...] = ()


def split_fields(line: Column, options: DelimitedOptions = DelimitedOptions()) -> Column:
    """The fields of one record, with quotes resolved."""
    mark, quote, escape = (re.escape(x) for x in (options.delimiter, options.quote, options.escape))
    plain = F.split(line, mark, -1)
    if len(options.delimiter) == 1:
        bare = f"[^{quote}{mark}]++"
    else:
        bare = f"(?:(?!{mark})[^{quote}])++"
    if options.escape == options.quote:
        inner = f"[^{quote}]++|{quote}{quote}"
        literal_quote = quote + quote
    else:
        inner = f"[^{quote}{escape}]++|{escape}{quote}|{quote}{quote}|{escape}"
        literal_quote = f"{escape}{quote}|{quote}{quote}"
    quoted = f"{quote}((?:{inner})*+)(?:{quote}|$)"
    field = f"{mark}((?:{bare}|{quote}(?:{inner})*+(?:{quote}|$))*+)"
    cut = F.regexp_extract_all(F.concat(F.lit(options.delimiter), line), F.lit(f"(?s){field}"), 1)
    unquoted = F.transform(
        cut,
        lambda cell: F.when(
            F.contains(cell, F.lit(options.quote)),
            F.regexp_replace(
                F.regexp_replace(cell, f"(?s){quoted}", "$1"), literal_quote, options.quote
            ),
        ).otherwise(cell),
    )
    return F.when(F.contains(line, F.lit(options.quote)), unquoted).otherwise(plain)


def table_width(df: DataFrame, fields: str = "fields") -> int:
    """The widest row sets the number of columns; one partial aggregate."""
    return df.agg(F.max(F.size(fields))).first()[0] or 0


def has_content(fields: Column) -> Column:
    return F.exists(fields, lambda cell: strip(cell) != "")


def record_rows(
    lines: DataFrame, options: DelimitedOptions = DelimitedOptions(), line: str = "line"
) -> DataFrame:
    """Add ``fields`` to the lines that have content; blank rows go.

    A visible character outside delimiters and quotes settles it without cutting the
    line; only lines of nothing but delimiters and quotes are cut to be sure.
    """
    marks = re.escape(options.delimiter + options.quote)
    text, fields = F.col(line), split_fields(F.col(line), options)
    doubtful = F.contains(text, F.lit(options.quote)) | text.rlike(r"[^\x00-\x7f]")
    filled = text.rlike(rf"[\x21-\x7e&&[^{marks}]]") | (doubtful & has_content(fields))
    return lines.filter(filled).withColumn("fields", fields)


def fields_to_columns(
    df: DataFrame,
    names: Sequence[str],
    malformed: str = "pad",
    fields: str = "fields",
    keep: Sequence[str] = (),
) -> DataFrame:
    """Cells are stripped and empty cells are NULL.

    Rows of another width are padded, or dropped where ``malformed`` is ``skip``.
    """
    rows = df
    if malformed == "skip":
        rows = rows.filter(F.size(fields) == len(names))
    cells = [
        blank_to_null(F.get(F.col(fields), F.lit(i))).alias(name) for i, name in enumerate(names)
    ]
    return rows.select(*keep, *cells)


def delimiter_scores(
    lines: DataFrame, source: str = "source", order: str = "line_no", line: str = "line"
) -> DataFrame:
    """``source, delimiter, score`` over the first ten non-empty lines of each source.

    Only those lines are split; the cut to ten lines is salted, see ``first_per_group``.
    """
    text = F.rtrim(F.regexp_replace(F.col(line), r"[\s﻿]+$", ""))
    numbered = lines.select(source, F.col(order).alias("n"), text.alias("text")).filter("text <> ''")
    first = first_per_group(numbered, [source], "n", SNIFFED_LINES)
    candidates = F.array(*[F.lit(d) for d in SNIFFED_DELIMITERS])
    counted = first.select(
        source, "text", F.posexplode(candidates).alias("preference", "delimiter")
    ).withColumn("cuts", F.size(F.split("text", F.concat(F.lit(r"\Q"), "delimiter", F.lit(r"\E")), -1)) - 1)
    total = F.sum("cuts")
    consistent = F.min("cuts") == F.max("cuts")
    return counted.groupBy(source, "preference", "delimiter").agg(
        F.when(total > 0, total + F.when(consistent, F.lit(CONSISTENT_BONUS)).otherwise(F.lit(0)))
        .otherwise(F.lit(-1))
        .alias("score")
    )


def first_per_group(df: DataFrame, keys: Sequence[str], order: str, count: int) -> DataFrame:
    """The first rows of each group by an order column, skew-safe.

    Two steps: a salted group keeps its own first rows, so a source with a third of all
    rows is cut down on many tasks before its survivors meet.
    """
    salt = F.pmod(F.xxhash64(order), F.lit(256))

    def keep_first(frame: DataFrame, groups: list[str]) -> DataFrame:
        ranked = frame.withColumn(
            "rank_", F.row_number().over(Window.partitionBy(*groups).orderBy(order))
        )
        return ranked.filter(F.col("rank_") <= count).drop("rank_")

    salted = keep_first(df.withColumn("salt_", salt), [*keys, "salt_"]).drop("salt_")
    return keep_first(salted, list(keys))


def sniff_delimiter(
    lines: DataFrame, source: str = "source", order: str = "line_no", line: str = "line"
) -> DataFrame:
    """``source, delimiter, score``: the best delimiter, the earlier candidate on a tie."""
    best = F.max(F.struct("score", (-F.col("preference")).alias("tie"), "delimiter"))
    return (
        delimiter_scores(lines, source, order, line)
        .groupBy(source)
        .agg(best.alias("best"))
        .select(
            source,
            F.when(F.col("best.score") < 0, F.lit(","))
            .otherwise(F.col("best.delimiter"))
            .alias("delimiter"),
            F.col("best.score").alias("score"),
        )
    )


def read_delimited(
    spark: SparkSession, path: str, options: DelimitedOptions | None = None
) -> DelimitedTable:
    """Read delimited files of one layout into string columns.

    An empty delimiter is sniffed. The first record of each file is its header. Files split, also where quoted fields
    hold line ends (``sections``). ``warnings`` tells of files that end inside quotes or are Latin-1.
    """
    options = options or DelimitedOptions()
    if not options.delimiter:
        ordered = raw_lines(spark, path).withColumn("order_", F.struct("block", "pos"))
        found = sniff_delimiter(ordered, "file", "order_")
        best = found.groupBy("delimiter").count().orderBy(F.desc("count"), "delimiter").first()
        options = replace(options, delimiter=best["delimiter"] if best else ",")
    automaton = QuotedFields(options.delimiter, options.quote, options.escape)
    facts = block_facts(raw_blocks(spark, path), automaton, options.encoding)
    header = F.when(F.col("opening"), decode_bytes(F.col("first"), options.encoding))
    found = facts.agg(
        F.bool_or("odd").alias("spans"), F.max("width").alias("width"), F.bit_or("marks").alias("marks"),
        F.min(header).alias("header"), F.count_distinct(header).alias("headers"), open_files(facts).alias("open"),
        F.sum((F.col("latin1") & F.col("last")).cast("int")).alias("latin1"),
    ).first()
    head: list[str] | None = None
    if found["spans"]:
        sections = cut_records(raw_blocks(spark, path), automaton, facts)
        records, leading = sections.records, record_rows(sections.leading, options)
        if options.header:
            head = _one_header(leading.select("fields").distinct().take(2), path)
        else:
            records = records.unionByName(sections.leading)
        width = max(sections.width, table_width(record_rows(sections.glued, options)))
        rows = record_rows(records, options)
    else:
        width = found["width"] or 0
        if options.header:
            _one_header([None] * min(found["headers"], 2), path)
            lines = lines_below_header(spark, path, _unused_mark(found["marks"] or 0))
            head = spark.range(1).select(split_fields(F.lit(found["header"] or ""), options)).first()[0]
        else:
            lines = raw_lines(spark, path)
        latin1 = facts.filter(F.col("latin1") & F.col("last")).select("file") if found["latin1"] else None
        rows = record_rows(decode_lines(lines, options.encoding, latin1), options)
    width = max(width, len(head or ()))
    if width == 0:
        raise ValueError(f"no non-empty rows in {path}")
    names = distinct_names(header_names(head or (), width))
    skipped = 0
    if options.malformed == "skip":
        skipped = rows.filter(F.size("fields") != width).count()
    table = fields_to_columns(rows, names, options.malformed)
    return DelimitedTable(table, names, options.delimiter, skipped, _warnings(found, options))


def _one_header(headers: Sequence, path: str) -> list[str]:
    if len(headers) > 1:
        raise ValueError(f"{path}: files with different headers; read files of one layout together")
    return headers[0][0] if headers and headers[0] else []


def _unused_mark(marks: int) -> str:
    return next((mark for i, mark in enumerate(LINE_MARKS) if not marks >> i & 1), "")


def _warnings(found: Row, options: DelimitedOptions) -> tuple[str, ...]:
    warnings = []
    if found["open"]:
        warnings.append(f"{found['open']} file(s) end inside a quoted field")
    if found["latin1"] and options.encoding == "auto":
        warnings.append(f"{found['latin1']} file(s) are not UTF-8 and were read as Latin-1")
    return tuple(warnings)

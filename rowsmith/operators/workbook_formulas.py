"""Spreadsheet formulas as relational operators.

A range is a column of a table; a summary sheet is a table of criteria joined to one
grouped aggregate, instead of one scan per cell.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rowsmith.session import checkpointed
from rowsmith.sources.workbook import cell_text

# The aggregates a summary sheet may consist of.
SUMMARY_FUNCTIONS = ("COUNTIF", "COUNTA", "SUM", "SUMIF", "SUMPRODUCT")


def _call(levels: int) -> str:
    """The arguments of one call in their parentheses, with calls inside to a fixed depth."""
    plain = r"""[^()"']++|"[^"]*+"|'[^']*+'"""
    pattern = rf"\((?:{plain})*+\)"
    for _ in range(levels):
        pattern = rf"\((?:{plain}|{pattern})*+\)"
    return pattern


# One function at the root: its first parenthesis closes at the end. Formulas nest 64 levels at most.
SUMMARY_FORMULA = rf"(?is)^=\s*({'|'.join(SUMMARY_FUNCTIONS)})\s*{_call(64)}\s*$"


def countif(cells: Column, criterion: Column) -> Column:
    return F.count_if(cells == criterion)


def counta(cells: Column) -> Column:
    return F.count(cells)


def sum_range(cells: Column) -> Column:
    return F.coalesce(F.sum(cells), F.lit(0))


def sumif(cells: Column, criterion: Column, summed: Column) -> Column:
    return F.coalesce(F.sum(F.when(cells == criterion, summed)), F.lit(0))


def sumproduct(left: Column, right: Column) -> Column:
    return F.coalesce(F.sum(left * right), F.lit(0))


def iff(condition: Column, then: Column, otherwise: Column) -> Column:
    return F.when(condition, then).otherwise(otherwise)


def negate(value: Column) -> Column:
    return F.lit(0) - value


def summary_view(
    criteria: DataFrame, criterion: str, source: DataFrame, cells: str, measures: Mapping[str, Column]
) -> DataFrame:
    """One row per criterion with COUNTIF/SUMIF style measures over its matching rows.

    The source is aggregated once, on the map side first, and only groups are joined.
    A criterion without rows gets zeros.
    """
    grouped = source.groupBy(F.col(cells).alias(criterion)).agg(
        *[m.alias(name) for name, m in measures.items()]
    )
    joined = criteria.join(grouped, criterion, "left")
    return joined.select(
        *criteria.columns, *[F.coalesce(F.col(n), F.lit(0)).alias(n) for n in measures]
    )


def vlookup(
    df: DataFrame, key: str, table: DataFrame, table_key: str, value: str, row_no: str, name: str
) -> DataFrame:
    """Exact-match VLOOKUP: the value of the first matching row, NULL without a match."""
    first = table.groupBy(F.col(table_key).alias("lookup_key_")).agg(
        F.min_by(value, row_no).alias(name)
    )
    return df.join(first, df[key] == first["lookup_key_"], "left").drop("lookup_key_")


def cell_reference(cells: DataFrame, book: str, sheet: str, row_no: int, col_no: int) -> DataFrame:
    """The constant a formula refers to, as a one-row table for a scalar subquery or join."""
    at = (
        (F.col("book") == book)
        & (F.col("sheet") == sheet)
        & (F.col("row_no") == row_no)
        & (F.col("col_no") == col_no)
    )
    text = cell_text(F.col("kind"), F.col("value"), F.col("formula"))
    return cells.filter(at).agg(F.max(text).alias("value"))


# A formula that is nothing but a reference: a sheet, plain or in quotes, a column and a row.
REFERENCE = r"^=\s*(?:(?:'((?:[^']|'')+)'|([A-Za-z0-9_.]+))!)?\$?([A-Za-z]{1,3})\$?([0-9]{1,7})\s*$"
CELL = ("book", "sheet", "row_no", "col_no")


def _cell(*parts: Column) -> Column:
    return F.struct(*[part.alias(name) for part, name in zip(parts, CELL, strict=True)])


def referenced_cell() -> Column:
    """The cell that ``formula`` refers to, NULL where it is no mere reference. Sheet names don't depend on case."""
    part = lambda i: F.regexp_extract("formula", REFERENCE, i)
    quoted = F.replace(part(1), F.lit("''"), F.lit("'"))
    sheet = F.coalesce(F.nullif(quoted, F.lit("")), F.nullif(part(2), F.lit("")), F.col("sheet"))
    letters = F.split(F.upper(part(3)), "")
    column = F.aggregate(letters, F.lit(0), lambda number, letter: F.when(letter == "", number).otherwise(number * 26 + F.ascii(letter) - 64))
    target = _cell(F.col("book"), F.lower(sheet), part(4).try_cast("int"), column)
    return F.when(F.col("formula").rlike(REFERENCE), target)


def resolve_references(cells: DataFrame) -> DataFrame:
    """``book, sheet, row_no, col_no, value, state`` of every cell whose formula is a reference.

    Chains are followed by pointer jumping: each round a cell takes over what its target refers to, so a chain of
    n cells takes log n rounds. In every round the ends of open chains settle; when none does, what is left runs in cycles.
    ``state`` is ``value``, ``formula`` (the chain ends in another formula, whose text is the value), ``empty`` or ``cycle``.
    """
    here = _cell(F.col("book"), F.lower("sheet"), F.col("row_no"), F.col("col_no"))
    known = checkpointed(cells.select(*CELL, "kind", "value", "formula", here.alias("cell_"), referenced_cell().alias("target_")))
    state = checkpointed(known.filter("target_ IS NOT NULL").select("cell_", F.col("target_").alias("end_")))
    left = None
    while True:
        following = state.select(F.col("cell_").alias("n_cell"), F.col("end_").alias("n_end"))
        jumped = state.join(following, F.col("end_") == F.col("n_cell"), "left")
        jumped = checkpointed(jumped.select("cell_", F.coalesce("n_end", "end_").alias("end_"), F.col("n_cell").isNotNull().alias("open_")))
        now = jumped.filter("open_").count()
        state = jumped.select("cell_", "end_")
        if now == 0 or now == left:
            break
        left = now
    ends = known.select(F.col("cell_").alias("e_cell"), cell_text(F.col("kind"), F.col("value"), F.col("formula")).alias("text_"), F.col("formula").isNotNull().alias("computed_"))
    settled = jumped.join(ends, F.col("end_") == F.col("e_cell"), "left")
    kind = F.when(F.col("open_"), "cycle").when(F.col("e_cell").isNull() | F.col("text_").isNull(), "empty").when(F.col("computed_"), "formula").otherwise("value")
    settled = settled.select(F.col("cell_").alias("s_cell"), F.when(~F.col("open_"), F.col("text_")).alias("text_"), kind.alias("state"))
    named = known.select(*CELL, "cell_").join(settled, F.col("cell_") == F.col("s_cell"))
    return named.select(*CELL, F.col("text_").alias("value"), "state")


def formula_columns(df: DataFrame, formulas: Mapping[str, Column]) -> DataFrame:
    """Per-row formula columns in order; a later one may use an earlier one."""
    for name, formula in formulas.items():
        df = df.withColumn(name, formula)
    return df


def summary_candidates(rows: DataFrame) -> DataFrame:
    """``book, sheet, is_summary`` from workbook rows.

    A summary sheet has a header, a formula in every filled data row, and no formula
    other than the five aggregates.
    """
    formulas = F.filter("formulas", lambda f: f.isNotNull())
    filled = (F.size(formulas) > 0) | F.exists("values", lambda v: F.trim(v) != "")
    aggregates_only = (F.size(formulas) > 0) & F.forall(
        formulas, lambda f: f.rlike(SUMMARY_FORMULA)
    )
    below_header = F.col("row_no") > F.col("first_row")
    judged = F.bool_and(F.when(below_header & filled, aggregates_only))
    return rows.groupBy("book", "sheet").agg(
        F.coalesce(judged, F.lit(False)).alias("is_summary")
    )

"""Results in pages: keyset pages for a reader, a bounded stream for a full drain."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

PAGE_ROWS = 1000


@dataclass(frozen=True)
class Page:
    rows: list[Row]
    done: bool
    last_key: tuple | None


def _after(keys: Sequence[str], values: Sequence[object]) -> Column:
    """Lexicographic ``keys > values``, NULL before all; the leading comparison reaches the scan."""
    condition = F.lit(False)
    equal = F.lit(True)
    for key, value in zip(keys, values):
        column = F.col(key)
        beyond = column.isNotNull() if value is None else F.coalesce(column > F.lit(value), F.lit(False))
        condition = condition | (equal & beyond)
        equal = equal & column.eqNullSafe(F.lit(value))
    return condition if values[0] is None else (F.col(keys[0]) >= F.lit(values[0])) & condition


def page_frame(
    df: DataFrame, keys: Sequence[str], after: Sequence[object] | None = None, rows: int = PAGE_ROWS
) -> DataFrame:
    """The next ``rows`` rows by key; a top-k, so no page sorts the whole result."""
    source = df if after is None else df.filter(_after(keys, after))
    return source.orderBy(*keys).limit(rows)


def fetch_page(
    df: DataFrame, keys: Sequence[str], after: Sequence[object] | None = None, rows: int = PAGE_ROWS
) -> Page:
    """One page on the driver; one row more is read to know whether it is the last."""
    fetched = page_frame(df, keys, after, rows + 1).collect()
    page = fetched[:rows]
    last = tuple(page[-1][k] for k in keys) if page else None
    return Page(page, len(fetched) <= rows, last)


def iter_pages(df: DataFrame, rows: int = PAGE_ROWS) -> Iterator[list[Row]]:
    """All rows in pages, holding one partition of the result at a time."""
    page: list[Row] = []
    for row in df.toLocalIterator():
        page.append(row)
        if len(page) == rows:
            yield page
            page = []
    if page:
        yield page

"""Identifier cleanup, as plain Python for schemas and as a Column for data."""

from __future__ import annotations

import re
from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from rowsmith.functions.tokens import strip


def sanitize_identifier(raw: str, prefix: str = "column") -> str:
    cleaned = re.sub(r"[^A-Za-z0-9]+", "_", raw).strip("_")
    if not cleaned:
        return f"{prefix}_1"
    return f"{prefix}_{cleaned}" if cleaned[0].isdigit() else cleaned


def sanitize_column(raw: Column, prefix: str = "column") -> Column:
    """The column twin of :func:`sanitize_identifier`."""
    cleaned = F.trim(F.regexp_replace(strip(raw), "[^A-Za-z0-9]+", "_"), F.lit("_"))
    return (
        F.when(cleaned == "", F.lit(f"{prefix}_1"))
        .when(cleaned.rlike("^[0-9]"), F.concat(F.lit(f"{prefix}_"), cleaned))
        .otherwise(cleaned)
    )


def distinct_names(raw_names: Iterable[str], prefix: str = "column") -> list[str]:
    """Clean the names and number the repeats: ``a``, ``a_2``, ``a_3``."""
    taken: set[str] = set()
    names = []
    for raw in raw_names:
        base = sanitize_identifier(raw, prefix)
        name, number = base, 2
        while name in taken:
            name, number = f"{base}_{number}", number + 1
        taken.add(name)
        names.append(name)
    return names


def header_names(cells: Iterable[str | None], width: int) -> list[str]:
    """Names from a header row; a blank or missing cell becomes ``column_N``."""
    cells = [(cell or "").strip() for cell in cells]
    cells += [""] * (width - len(cells))
    return [cell or f"column_{i}" for i, cell in enumerate(cells[:width], start=1)]


# What a column name has to look like to hint at a type.
TEMPORAL_NAME = re.compile(r"(^|_)(date|time|datetime|timestamp|epoch)(_|$)|_at$")
BOOLEAN_NAME = re.compile(
    r"^is_|^has_|(^|_)(bool|boolean|flag|enabled|disabled|active|inactive)(_|$)"
)
DECIMAL_NAME = re.compile(r"(^|_)(decimal|numeric)(_|$)")

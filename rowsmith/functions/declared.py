"""Target types for the column types declared by MySQL and SQLite schemas."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# What a declared type says (a pattern found anywhere in it, upper case), and the type that stands for it.
# The first line that fits decides; TEXT is the rest.
UUID = r"UUID|GUID|UNIQUEIDENTIFIER|CHAR\(36\)"
MYSQL_TYPES = (
    (r"BOOL|^BIT\(1|^TINYINT\(1", "BOOLEAN"),
    (UUID, "UUID"),
    (r"(BIG|SMALL|TINY|MEDIUM| )INT|^INT|^YEAR", "INTEGER"),
    (r"DECIMAL|NUMERIC", "DECIMAL"),
    (r"FLOAT|DOUBLE|REAL", "FLOAT64"),
    (r"BLOB|BINARY", "BLOB"),
    (r"DATE|TIMESTAMP", "TIMESTAMP"),
)
SQLITE_TYPES = (
    (r"BOOL", "BOOLEAN"),
    (r"INT", "INTEGER"),
    (UUID, "UUID"),
    (r"REAL|FLOA|DOUB", "FLOAT64"),
    (r"BLOB", "BLOB"),
    (r"DECIMAL|NUMERIC", "DECIMAL"),
    (r"DATE|TIME", "TIMESTAMP"),
)
DEFAULT_DECIMAL = "DECIMAL(18,6)"


def _target(declared: Column, types: tuple[tuple[str, str], ...]) -> Column:
    kind = F.upper(F.trim(declared))
    sized = F.replace(kind, F.lit("NUMERIC"), F.lit("DECIMAL"))
    decimal = F.when(kind.contains("("), sized).otherwise(DEFAULT_DECIMAL)
    found = [F.when(kind.rlike(said), decimal if name == "DECIMAL" else F.lit(name)) for said, name in types]
    return F.when(kind.isNotNull(), F.coalesce(*found, F.lit("TEXT"))).otherwise("TEXT")


def mysql_target_type(declared: Column) -> Column:
    return _target(declared, MYSQL_TYPES)


def sqlite_target_type(declared: Column) -> Column:
    return _target(declared, SQLITE_TYPES)

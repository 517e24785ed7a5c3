"""The registry of source formats, and detection over a file inventory."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Format key, label, family, support state, extensions.
FORMATS = (
    ("nativeDb", "Native database", "database", "complete", (".ddb",)),
    ("csv", "CSV", "delimitedText", "complete", (".csv",)),
    ("tsv", "TSV", "delimitedText", "complete", (".tsv",)),
    ("genericDelimited", "Generic Delimited Text", "delimitedText", "complete", (".txt", ".dat", ".log", ".psv")),
    ("fixedWidth", "Fixed-width Text", "delimitedText", "planned", ()),
    ("xlsx", "Excel (.xlsx)", "spreadsheet", "complete", (".xlsx",)),
    ("xls", "Excel (.xls)", "spreadsheet", "partial", (".xls",)),
    ("ods", "OpenDocument Spreadsheet", "spreadsheet", "planned", (".ods",)),
    ("json", "JSON", "structuredDocument", "complete", (".json",)),
    ("ndjson", "NDJSON / JSONL", "structuredDocument", "complete", (".ndjson", ".jsonl")),
    ("xml", "XML", "structuredDocument", "complete", (".xml",)),
    ("yaml", "YAML", "structuredDocument", "investigate", (".yaml", ".yml")),
    ("toml", "TOML", "structuredDocument", "deferred", (".toml",)),
    ("htmlTable", "HTML Tables", "webMarkup", "complete", (".html", ".htm")),
    ("markdownTable", "Markdown Tables", "webMarkup", "investigate", (".md",)),
    ("sqlite", "SQLite", "database", "complete", (".db", ".sqlite", ".sqlite3")),
    ("duckdb", "DuckDB", "database", "planned", (".duckdb",)),
    ("access", "Microsoft Access", "legacyBusiness", "investigate", (".mdb", ".accdb")),
    ("dbf", "DBF / FoxPro", "legacyBusiness", "investigate", (".dbf",)),
    ("sqlDump", "SQL Dump", "databaseDump", "complete", (".sql",)),
    ("postgresPlainDump", "PostgreSQL Plain SQL Dump", "databaseDump", "planned", ()),
    ("parquet", "Parquet", "analytical", "planned", (".parquet",)),
    ("jsonLogStream", "JSON Log Stream", "logsEvents", "planned", ()),
    ("delimitedLog", "Delimited Log File", "logsEvents", "investigate", ()),
    ("zipArchive", "ZIP Wrapper", "compressedArchive", "complete", (".zip",)),
    ("gzipArchive", "GZip Wrapper", "compressedArchive", "complete", (".gz",)),
    ("bzip2Archive", "BZip2 Wrapper", "compressedArchive", "investigate", (".bz2",)),
    ("xzArchive", "XZ Wrapper", "compressedArchive", "investigate", (".xz",)),
    ("clipboardTable", "Clipboard Table", "webMarkup", "investigate", ()),
    ("pdfTables", "PDF Tables", "webMarkup", "deferred", (".pdf",)),
    ("unknown", "Unknown", "delimitedText", "notStarted", ()),
)

SQLITE_SIGNATURE = "SQLite format 3"

_BY_EXTENSION = {
    extension: (key, label, family, state)
    for key, label, family, state, extensions in FORMATS
    for extension in extensions
}


def format_registry(spark: SparkSession) -> DataFrame:
    rows = [(k, label, fam, state, list(ext)) for k, label, fam, state, ext in FORMATS]
    return spark.createDataFrame(
        rows,
        "format_key string, label string, family string, support_state string,"
        " extensions array<string>",
    )


def format_of_name(name: str) -> str:
    """The format key behind a file name, on the driver or in a task."""
    base = name.rsplit("/", 1)[-1]
    dot = base.rfind(".")
    extension = base[dot:].lower() if dot > 0 else ""
    return _BY_EXTENSION.get(extension, ("unknown",))[0]


def path_extension(path: Column) -> Column:
    """The last extension of the last path part, lower case; empty for dot files."""
    return F.lower(F.regexp_extract(path, r"[^/]+(\.[^./]*)$", 1))


def detect_format(path: Column, content: Column | None = None) -> Column:
    """``struct<format_key, label, family, support_state>`` looked up in a constant map.

    Given the content too, a database file is known by its signature, whatever its name.
    """
    entries = []
    for extension, values in _BY_EXTENSION.items():
        entries += [F.lit(extension), _format_struct(*values)]
    unknown = _format_struct(*FORMATS[-1][:4])
    named = F.coalesce(F.create_map(*entries)[path_extension(path)], unknown)
    if content is None:
        return named
    sqlite = next(values for values in _BY_EXTENSION.values() if values[0] == "sqlite")
    return F.when(has_sqlite_signature(content), _format_struct(*sqlite)).otherwise(named)


def _format_struct(key: str, label: str, family: str, state: str) -> Column:
    return F.struct(
        F.lit(key).alias("format_key"),
        F.lit(label).alias("label"),
        F.lit(family).alias("family"),
        F.lit(state).alias("support_state"),
    )


def has_sqlite_signature(content: Column) -> Column:
    return F.substring(content, 1, len(SQLITE_SIGNATURE)) == F.lit(SQLITE_SIGNATURE).cast("binary")


def gzip_inner_name(path: Column) -> Column:
    """The name inside a gzip wrapper: the file name without its last extension."""
    return F.regexp_extract(path, r"([^/]+?)(\.[^./]*)?$", 1)

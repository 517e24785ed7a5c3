"""SQL dumps as tables: CREATE TABLE and INSERT ... VALUES statements.

Statements are cut by regular expressions with possessive repeats inside the JVM; one pass over each then marks
quotes, brackets and commas and keeps the bracket depth as a running sum, so tuples nest to any depth. Nothing here
understands SQL beyond those two statements; all others are listed with the reason for skipping them.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rowsmith.functions.declared import mysql_target_type
from rowsmith.operators.coercion import coerce_columns
from rowsmith.session import scratch_folder
from rowsmith.sources.sections import DumpLines, block_facts, cut_records, raw_blocks

SINGLE = r"'(?:[^'\\]++|\\.|'')*+(?:'|$)"
DOUBLE = r'"(?:[^"\\]++|\\.)*+(?:"|$)'
BACKTICK = r"`[^`]*+(?:`|$)"
QUOTED = f"{SINGLE}|{DOUBLE}|{BACKTICK}"
COMMENT = r"--(?=\s|$)[^\n]*+|\#[^\n]*+|/\*(?:[^*]++|\*(?!/))*+(?:\*/|$)"
NAME = r"(?:`[^`]*`|[A-Za-z_][A-Za-z0-9_$]*)"
QUALIFIED = rf"(?:{NAME}\s*\.\s*)*({NAME})"


MARK = re.compile(rf"(?s){QUOTED}|[(),]")
CREATE_HEAD = re.compile(rf"(?is)CREATE\s+(?:TEMPORARY\s+)?TABLE\s+(?:IF\s+NOT\s+EXISTS\s+)?{QUALIFIED}\s*")
INSERT_HEAD = re.compile(rf"(?is)INSERT\s+(?:(?:LOW_PRIORITY|DELAYED|HIGH_PRIORITY|IGNORE)\s+)*INTO\s+{QUALIFIED}\s*")
VALUES = re.compile(r"(?i)\s*VALUES")
# What a column type holds in brackets doesn't nest.
ARGUMENTS = rf"\((?:[^()'\"`]++|{QUOTED})*+\)"
# The words that end a declared type.
CONSTRAINT_WORDS = (
    "NOT NULL", "NULL", "DEFAULT", "AUTO_INCREMENT", "PRIMARY KEY", "UNIQUE", "COMMENT", "COLLATE", "CHARACTER SET",
    "REFERENCES", "CHECK", "ON UPDATE", "GENERATED ALWAYS", "AS ", "VIRTUAL", "STORED",
)
COLUMN_PATTERN = (
    rf"(?is)^\s*({NAME})\s+((?:(?! (?:{'|'.join(CONSTRAINT_WORDS)}))[^()'\"]|{QUOTED}|{ARGUMENTS})++)(.*)$"
)
# Statement kinds of two words; any other kind is the first word.
TWO_WORD_KINDS = ("LOCK TABLES", "UNLOCK TABLES", "DROP TABLE", "ALTER TABLE", "CREATE VIEW")
SNIPPET_LENGTH = 120
SPACES = re.compile(r"\s+")


def split_statements(text: Column) -> Column:
    """Statements of a dump chunk, without comments and closing semicolons."""
    piece = rf"(?s)((?:{COMMENT}|{QUOTED}|[^;'\"`#/-]++|[-/])++);?"
    pieces = F.regexp_extract_all(text, F.lit(piece), 1)
    clean = F.transform(
        pieces, lambda p: _trim(F.regexp_replace(p, rf"(?s)({QUOTED})|{COMMENT}", "$1"))
    )
    return F.filter(clean, lambda p: p != "")


def statement_rows(df: DataFrame, text: Column, *keep: Column | str, number: str = "ordinal") -> DataFrame:
    """``keep..., number, statement``: a row for each statement of a chunk.

    The outer form, as the inner one makes Spark cut the chunk again in a filter.
    """
    pieces = df.select(*keep, F.posexplode_outer(split_statements(text)).alias(number, "statement"))
    return pieces.filter(F.col(number).isNotNull())


def _trim(text: Column) -> Column:
    return F.trim(text, F.lit(" \n\r\t\f"))


def snippet(statement: str) -> str:
    compact = SPACES.sub(" ", statement).strip(" ")
    return compact if len(compact) <= SNIPPET_LENGTH else f"{compact[: SNIPPET_LENGTH - 1]}…"


def _unquote(name: str) -> str:
    name = name.strip(" ")
    return name[1:-1] if len(name) > 1 and name[0] == name[-1] == "`" and "`" not in name[1:-1] else name


def groups(text: str, at: int = 0, first_only: bool = False) -> tuple[list[list[str]], int] | None:
    """Items of each bracketed group from ``at`` on and where the last one ends.

    Items are cut at commas of depth one. None where anything but white space and commas stands between the groups, or
    a bracket stays open; ``first_only`` stops behind the first group.
    """
    found, items, depth, start, end = [], [], 0, at, at
    for mark in MARK.finditer(text, at):
        kind = mark.group()
        if kind == "(":
            if depth == 0:
                if text[end : mark.start()].strip(BETWEEN_GROUPS):
                    return None
                items, start = [], mark.end()
            depth += 1
        elif kind == ")":
            depth -= 1
            if depth < 0:
                return None
            if depth == 0:
                items.append(text[start : mark.start()])
                found.append(items)
                end = mark.end()
                if first_only:
                    return found, end
        elif depth == 0 and kind != ",":
            return None
        elif depth == 1 and kind == ",":
            items.append(text[start : mark.start()])
            start = mark.end()
    return None if depth or text[end:].strip(BETWEEN_GROUPS) else (found, end)


BETWEEN_GROUPS = " \t\n\x0b\f\r,"
#: Groups that hold no other brackets; where this matches, ``groups`` finds nothing wrong.
FLAT_GROUPS = re.compile(rf"(?s)(?:[{BETWEEN_GROUPS}]*+\((?:[^()'\"`]++|{QUOTED})*+\))*+[{BETWEEN_GROUPS}]*+\Z")


FIRST_WORDS = re.compile(r"\s*(\S+)(?:\s+(\S+))?(?:\s+(\S+))?")


def statement_kind(statement: str) -> str:
    """The words that a statement begins with, however much white space is between them."""
    if statement[:6].upper() == "INSERT":
        return "INSERT"
    words = [word.upper() for word in FIRST_WORDS.match(statement).groups() if word]
    if words[:2] == ["CREATE", "TABLE"] or words[:3] == ["CREATE", "TEMPORARY", "TABLE"]:
        return "CREATE TABLE"
    return " ".join(words[:2]) if " ".join(words[:2]) in TWO_WORD_KINDS else words[0]


def _parsed_insert(statement: str, rows: bool = True) -> Iterator[dict]:
    """One ``insert`` entry and, where nothing is wrong, one ``row`` entry for each tuple if ``rows`` are wanted."""
    head = INSERT_HEAD.match(statement)
    listed = groups(statement, head.end(), True) if head and statement[head.end() : head.end() + 1] == "(" else None
    values = VALUES.match(statement, listed[1] if listed else head.end()) if head else None
    if not values:
        yield {"entry": "skip", "kind": "INSERT", "reason": "Only INSERT ... VALUES statements are supported."}
        return
    table = _unquote(head.group(1))
    columns = [_unquote(c) for c in listed[0][0]] if listed else None
    if rows or not FLAT_GROUPS.match(statement, values.end()):
        tuples = groups(statement, values.end())
    else:
        tuples = groups(statement, values.end(), True) if columns is not None and "(" in statement[values.end() :] else ([], 0)
    entry = {"entry": "insert", "kind": "INSERT", "table_name": table, "parts": []}
    if tuples is None:
        yield entry | {"reason": "Unsupported INSERT row syntax."}
    elif columns is not None and len(columns) != (len(tuples[0][0]) if tuples[0] else 0):
        yield entry | {"parts": [f"Skipping INSERT for {table} because the explicit column list does not match row width."]}
    else:
        yield entry
        for row_no, tokens in enumerate(tuples[0] if rows else ()):
            yield {"entry": "row", "table_name": table, "row_no": row_no, "columns": columns, "parts": tokens}


def _parsed_create(statement: str) -> Iterator[dict]:
    """One ``create`` entry: the segments of the body, and the names in the first brackets of each."""
    head = CREATE_HEAD.match(statement)
    if not head:
        return
    body = groups(statement, head.end(), True) if statement[head.end() : head.end() + 1] == "(" else None
    segments = [segment.strip(" \n\r\t\f") for segment in body[0][0]] if body else []
    first = [groups(segment, segment.index("("), True) if "(" in segment else None for segment in segments]
    keys = [[_unquote(k) for k in found[0][0]] if found else [] for found in first]
    yield {"entry": "create", "table_name": _unquote(head.group(1)), "parts": segments, "keys": keys}


ENTRY = "entry string, table_name string, kind string, reason string, snippet string, columns array<string>, row_no int, parts array<string>, keys array<array<string>>"
_ENTRY = pa.schema([
    ("entry", pa.string()), ("table_name", pa.string()), ("kind", pa.string()), ("reason", pa.string()), ("snippet", pa.string()),
    ("columns", pa.list_(pa.string())), ("row_no", pa.int32()), ("parts", pa.list_(pa.string())), ("keys", pa.list_(pa.list_(pa.string()))),
])


def _parse(statement: str, rows: bool = True) -> Iterator[dict]:
    kind = statement_kind(statement)
    if kind == "INSERT":
        yield from _parsed_insert(statement, rows)
    elif kind == "CREATE TABLE":
        yield from _parsed_create(statement)
    else:
        yield {"entry": "skip", "kind": kind, "reason": f"Skipping unsupported {kind} statement."}


def _parser(statement: str) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            others = [n for n in batch.schema.names if n != statement]
            entries, places = [], []

            def flush() -> pa.RecordBatch:
                at = pa.array(places, pa.int32())
                parsed = [pa.array([e.get(f.name) for e in entries], f.type) for f in _ENTRY]
                entries.clear()
                places.clear()
                return pa.RecordBatch.from_arrays([*(batch.column(n).take(at) for n in others), *parsed], [*others, *_ENTRY.names])

            for place, text in enumerate(batch.column(statement)):
                text = text.as_py()
                if not text or not text.strip():
                    continue
                for entry in _parse(text):
                    if entry["entry"] in ("skip", "insert"):
                        entry["snippet"] = snippet(text)
                    entries.append(entry)
                    places.append(place)
                    if len(entries) >= 10_000:
                        yield flush()
            yield flush()

    return run


def parsed(statements: DataFrame, statement: str = "statement") -> DataFrame:
    """What each statement says, in one pass: entries ``create``, ``insert``, ``row`` and ``skip`` beside the other columns."""
    if "entry" in statements.columns:
        return statements
    kept = [f for f in statements.schema.fields if f.name != statement]
    schema = T.StructType([*kept, *T.StructType.fromDDL(ENTRY).fields])
    return statements.mapInArrow(_parser(statement), schema)


def created_tables(statements: DataFrame, statement: str = "statement") -> DataFrame:
    """``created_name, created_at``: the first CREATE TABLE of each table."""
    created = parsed(statements, statement).filter("entry = 'create'")
    return created.groupBy(F.col("table_name").alias("created_name")).agg(F.min("ordinal").alias("created_at"))


_SKIP = [n for n in _ENTRY.names if n in ("entry", "table_name", "kind", "reason", "snippet", "parts")]


def _short_skips(statement: str, known: dict[str, list[dict]]) -> list[dict]:
    """Entries of a short statement other than an INSERT; dumps repeat them, so ``known`` keeps some."""
    if statement not in known:
        if len(known) >= 10_000:
            known.clear()
        known[statement] = [entry | {"snippet": snippet(statement)} for entry in _parse(statement, False)]
    return known[statement]


def _skipper(statement: str, early: bool) -> Callable:
    """Entries ``skip`` and ``insert``, without rows; an INSERT that nothing is wrong with only where it can come too early."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, list[dict]] = {}
        for batch in batches:
            others = [n for n in batch.schema.names if n != statement]
            found, places = {n: [] for n in _SKIP}, []
            for place, text in enumerate(batch.column(statement).to_pylist()):
                if not text or not text.strip():
                    continue
                for entry in _short_skips(text, known) if len(text) <= SNIPPET_LENGTH and text[:6].upper() != "INSERT" else _parse(text, False):
                    if entry["entry"] == "skip" or entry["entry"] == "insert" and (early or entry.get("reason") or entry["parts"]):
                        if "snippet" not in entry:
                            entry["snippet"] = snippet(text)
                        places.append(place)
                        for n in _SKIP:
                            found[n].append(entry.get(n))
            parsed = [pa.array(found[n], _ENTRY.field(n).type) for n in _SKIP]
            at = pa.array(places, pa.int32())
            yield pa.RecordBatch.from_arrays([*(batch.column(n).take(at) for n in others), *parsed], [*others, *_SKIP])

    return run


def _skip_entries(statements: DataFrame, statement: str, early: bool) -> DataFrame:
    """The entries that ``skipped_statements`` is made of; text that isn't parsed yet is parsed for them alone."""
    if "entry" in statements.columns:
        return statements.filter("entry IN ('skip', 'insert')")
    kept = [f for f in statements.schema.fields if f.name != statement]
    own = [f for f in T.StructType.fromDDL(ENTRY).fields if f.name in _SKIP]
    return statements.mapInArrow(_skipper(statement, early), T.StructType([*kept, *own]))


def skipped_statements(
    statements: DataFrame, statement: str = "statement", created: DataFrame | None = None
) -> DataFrame:
    """``ordinal, kind, reason, snippet`` of the statements an import leaves out.

    With ``created`` (see ``created_tables``), an INSERT must follow the CREATE TABLE of its table.
    """
    entries = _skip_entries(statements, statement, created is not None)
    reason = F.col("reason")
    if created is not None:
        entries = entries.join(F.broadcast(created), F.col("table_name") == F.col("created_name"), "left")
        early = (F.col("entry") == "skip") | F.coalesce(F.col("created_at") < F.col("ordinal"), F.lit(False))
        lost = F.concat(F.lit("Skipping INSERT for "), "table_name", F.lit(" because no supported CREATE TABLE was parsed first."))
        reason = F.coalesce(reason, F.when(~early, lost))
    entries = entries.withColumn("reason", F.coalesce(reason, F.get("parts", F.lit(0))))
    kept = [c for c in statements.columns if c not in (statement, "ordinal", *_ENTRY.names)]
    return entries.filter("reason IS NOT NULL").select(*kept, "ordinal", "kind", "reason", "snippet")


def dump_columns(statements: DataFrame, statement: str = "statement") -> DataFrame:
    """Declared columns of the CREATE TABLE statements, with constraints and target type."""
    pairs = F.arrays_zip(F.col("parts").alias("text"), F.col("keys").alias("keys"))
    created = parsed(statements, statement).filter("entry = 'create'").select("table_name", pairs.alias("segments"))
    upper_is = lambda pattern: lambda s: F.upper(s["text"]).rlike(pattern)
    of_keys = lambda pattern: F.transform(F.filter("segments", upper_is(pattern)), lambda s: s["keys"])
    table_keys = created.select(
        "table_name",
        F.flatten(of_keys("^PRIMARY KEY")).alias("pk"),
        F.flatten(F.filter(of_keys("^UNIQUE( |$)"), lambda names: F.size(names) == 1)).alias("uniques"),
        F.transform(
            F.filter(
                "segments",
                lambda s: (s["text"] != "")
                & ~F.upper(s["text"]).rlike(
                    "^(PRIMARY KEY|UNIQUE |KEY |INDEX |FULLTEXT |SPATIAL |CONSTRAINT |FOREIGN KEY|CHECK )"
                ),
            ),
            lambda s: s["text"],
        ).alias("definitions"),
    )
    columns = table_keys.select(
        "table_name", "pk", "uniques", F.posexplode("definitions").alias("source_index", "definition")
    )
    constraints = F.upper(F.regexp_extract("definition", COLUMN_PATTERN, 3))
    declared = F.trim(F.regexp_extract("definition", COLUMN_PATTERN, 2))
    name = F.regexp_replace(F.trim(F.regexp_extract("definition", COLUMN_PATTERN, 1)), "^`([^`]*)`$", "$1")
    return columns.filter(F.col("definition").rlike(COLUMN_PATTERN)).select(
        "table_name",
        "source_index",
        name.alias("column_name"),
        declared.alias("declared_type"),
        mysql_target_type(declared).alias("target_type"),
        constraints.contains("NOT NULL").alias("not_null"),
        (constraints.contains("PRIMARY KEY") | F.array_contains("pk", name)).alias("primary_key"),
        (constraints.contains("UNIQUE") | F.array_contains("uniques", name)).alias("unique"),
    )


def literal_kind(text: Column) -> Column:
    """null, bool, bytes, int, string, double or raw, for one stripped SQL literal."""
    upper, first = F.upper(text), F.substring(text, 1, 1)
    return (
        F.when(first.isin("'", '"') & text.endswith(first) & (F.length(text) >= 2), "string")
        .when((text == "") | (upper == "NULL"), "null")
        .when(upper.isin("TRUE", "FALSE"), "bool")
        .when(text.rlike(HEX_LITERAL), "bytes")
        .when(text.rlike(r"^([bB]'[01]*'|[+-]?\d{1,19})$"), "int")
        .when(text.rlike(r"^[+-]?(\.\d+|\d+(\.\d*)?)([eE][+-]?\d+)?$"), "double")
        .otherwise("raw")
    )


HEX_LITERAL = "^(0[xX][0-9a-fA-F]*|[xX]'[0-9a-fA-F]*')$"


def literal_text(text: Column) -> Column:
    """The value of one stripped SQL literal as text: NULL for NULL, hex digits for bytes."""
    first = F.substring(text, 1, 1)
    quoted = first.isin("'", '"') & text.endswith(first) & (F.length(text) >= 2)
    hexed = F.regexp_replace(text, "^0[xX]|^[xX]'|'$", "")
    hexed = F.when(F.length(hexed) % 2 == 1, F.concat(F.lit("0"), hexed)).otherwise(hexed)
    marked = F.when(text.rlike(HEX_LITERAL), hexed).when(
        text.rlike("^[bB]'[01]*'$"), F.conv(F.regexp_replace(text, "[bB']", ""), 2, 10)
    )
    word = F.upper(text)
    return (
        F.when(quoted, _decode_quoted(text))
        .when(first.isin("0", "x", "X", "b", "B"), F.coalesce(marked, text))
        .when(word.isin("TRUE", "FALSE"), F.lower(text))
        .when(~word.isin("", "NULL"), text)
    )


# What a letter after a backslash stands for; other characters are themselves.
ESCAPES = {"0": "\0", "b": "\b", "n": "\n", "r": "\r", "t": "\t", "Z": "\x1a"}


def _decode_quoted(token: Column) -> Column:
    quote, body = F.substring(token, 1, 1), F.substring(token, F.lit(2), F.length(token) - 2)
    # A private-use mark stands for an escaped character until doubled quotes are resolved.
    mark = ""
    decoded = F.regexp_replace(body, r"(?s)\\(.)", f"{mark}$1")
    decoded = F.replace(decoded, F.concat(quote, quote), quote)
    for letter, char in ESCAPES.items():
        decoded = F.replace(decoded, F.lit(mark + letter), F.lit(char))
    decoded = F.replace(decoded, F.lit(mark), F.lit(""))
    special = F.contains(body, F.lit("\\")) | F.contains(body, quote)
    return F.when(special, decoded).otherwise(body)


def insert_rows(statements: DataFrame, statement: str = "statement") -> DataFrame:
    """``table_name, ordinal, row_no, columns, tokens`` for every INSERT row tuple.

    ``columns`` is NULL without an explicit list; ``tokens`` are undecoded literals. A
    statement without VALUES, with anything but tuples after it, or whose list does not match its
    row width gives no rows; ``skipped_statements`` reports it. A long statement does not stay one row.
    """
    rows = parsed(statements, statement).filter("entry = 'row'")
    return rows.select("table_name", "ordinal", "row_no", "columns", F.col("parts").alias("tokens"))


def dump_rows(rows: DataFrame, table: str, columns: Sequence[str]) -> DataFrame:
    """The rows of one table as text columns, in declared column order.

    An explicit column list is followed by name; columns it leaves out are NULL.
    """
    own = rows.filter(F.col("table_name") == table)

    def place(i: int, column: str) -> Column:
        named = F.array_position("columns", F.lit(column)).cast("int") - 1
        at = F.when(F.col("columns").isNull(), F.lit(i)).when(named >= 0, named)
        return _trim(F.get("tokens", at)).alias(column)

    tokens = own.select(*[place(i, c) for i, c in enumerate(columns)])
    return tokens.select(*[literal_text(F.col(f"`{c}`")).alias(c) for c in columns])


@dataclass(frozen=True)
class DumpTables:
    """Typed tables of a dump, their declared columns, the statements left out, and values left out of rows."""

    tables: dict[str, DataFrame]
    columns: DataFrame
    skipped: DataFrame
    warnings: DataFrame


def dump_tables(statements: DataFrame, statement: str = "statement") -> DumpTables:
    """Every created table with its inserted rows, typed as declared.

    ``statements`` has ``ordinal`` and the text; with a ``file``, files in name order are one dump. They are read
    and parsed once: what they say is written to one folder per kind and table, and each table reads its own. Only
    declared columns come to the driver. ``warnings`` counts the rows with more values than their table has columns.
    """
    if "file" in statements.columns:
        statements = statements.select(F.struct("file", "ordinal").alias("ordinal"), statement)
    found = parsed(statements, statement)
    path = scratch_folder(statements.sparkSession, "dump")
    found.write.partitionBy("entry", "table_name").parquet(path)
    found = statements.sparkSession.read.schema(found.schema).parquet(path)
    created = created_tables(found)
    columns = dump_columns(found).distinct()
    declared: dict[str, dict[str, str]] = {}
    for row in columns.orderBy("table_name", "source_index").collect():
        declared.setdefault(row["table_name"], {})[row["column_name"]] = row["target_type"]
    rows = insert_rows(found)
    early = F.coalesce(F.col("created_at") < F.col("ordinal"), F.lit(False))
    # One row per created table; a join by its name would put all rows of a table into one task.
    rows = rows.join(F.broadcast(created), F.col("table_name") == F.col("created_name")).filter(early)
    tables = {
        name: coerce_columns(dump_rows(rows, name, list(kinds)), kinds, "dump") for name, kinds in declared.items()
    }
    widths = columns.groupBy(F.col("table_name").alias("w_table")).agg(F.count_distinct("column_name").alias("width"))
    wide = rows.join(F.broadcast(widths), F.col("table_name") == F.col("w_table")).filter(F.col("columns").isNull() & (F.size("tokens") > F.col("width")))
    warnings = wide.groupBy("table_name").agg(F.count("*").alias("rows")).select(
        "table_name", F.lit("Values beyond the declared columns were left out.").alias("warning"), "rows"
    )
    return DumpTables(tables, columns, skipped_statements(found, created=created), warnings)


def read_statements(spark: SparkSession, path: str, encoding: str = "auto") -> DataFrame:
    """``file, ordinal, statement`` of dump files.

    A dump is cut behind the lines that end a statement, wherever those lie: strings and comments go on over line ends
    and file blocks (see ``sections``). Files that are not UTF-8 are Latin-1.
    """
    automaton = DumpLines()
    facts = block_facts(raw_blocks(spark, path, named=True), automaton, encoding)
    sections = cut_records(raw_blocks(spark, path, named=True), automaton, facts)
    pieces = sections.records.unionByName(sections.leading)
    place = F.struct("block", F.col("at").alias("pos")).alias("place")
    statements = statement_rows(pieces, F.col("line"), "file", place, number="part")
    return statements.select("file", F.struct("place.block", "place.pos", "part").alias("ordinal"), "statement")

"""Records that go on over line ends, found without moving the text.

An automaton reads lines; its state at a line's end says whether the record goes on. What a block of a file does to the
states is a small map, and such maps compose. So the first scan gives one row per block, those rows are scanned in file order,
and then each block knows the state in which it begins and is cut into records on its own. Only fragments at
block ends are shuffled. Nothing is pinned: a repeated scan cuts the same files into the same blocks.

The driver holds one entry per block that begins inside a record or belongs to a Latin-1 file: some
bytes for ``spark.sql.files.maxPartitionBytes`` of text.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rowsmith.functions.tokens import WHITESPACE
from rowsmith.session import scratch_folder

#: Kinds of rows: a record, parts of one that other blocks continue or begin, and the facts of a block.
WHOLE, HEAD, MIDDLE, TAIL, FACTS = range(5)
#: Characters one of which delimited text must not hold, so that Spark's CSV reader hands over whole lines.
LINE_MARKS = tuple(map(chr, (*range(1, 9), *range(14, 32))))
_MARKS = re.compile(b"[\x01-\x08\x0e-\x1f]")


@dataclass(frozen=True)
class QuotedFields:
    """Delimited text: a line with an odd number of quotes opens or closes a quoted section."""

    delimiter: str
    quote: str
    escape: str

    states = 2

    def _bare(self, line: bytes) -> bytes:
        return line if self.escape == self.quote else line.replace((self.escape + self.quote).encode(), b"")

    def quotes(self, lines: pa.BinaryArray) -> np.ndarray:
        """How many quotes each line has; an escaped one is none."""
        mark = self.quote.encode()
        if self.escape == self.quote and len(mark) == 1:
            return _per_line(lines, mark)
        return np.array([self._bare(v).count(mark) for v in lines.to_pylist()], dtype=np.int64)

    def ends(self, lines: pa.BinaryArray, state: int) -> np.ndarray:
        return (state + np.cumsum(self.quotes(lines))) & 1

    @cached_property
    def _nothing(self) -> str:
        return WHITESPACE + self.quote + "".join(c for c in self.delimiter)

    def filled(self, record: bytes) -> bool:
        return bool(record.decode("utf-8", "replace").strip(self._nothing))

    @cached_property
    def _field(self) -> re.Pattern[bytes]:
        mark, quote, escape = (re.escape(c.encode()) for c in (self.delimiter, self.quote, self.escape))
        quoted = b"%s(?:[^%s%s]++|%s%s|%s%s|%s)*+(?:%s|$)" % (quote, quote, escape, escape, quote, quote, quote, escape, quote)
        return re.compile(b"(?s)%s(?:(?!%s)[^%s]|%s)*+" % (mark, mark, quote, quoted))

    def width(self, record: bytes) -> int:
        """Number of fields; 0 for a record of nothing but delimiters, quotes and white space."""
        if not self.filled(record):
            return 0
        mark, quote = self.delimiter.encode(), self.quote.encode()
        if self.escape != self.quote and quote in record:
            return len(self._field.findall(mark + record))
        return 1 + sum(part.count(mark) for part in record.split(quote)[::2])

    def widest(self, records: pa.BinaryArray) -> int:
        mark = self.delimiter.encode()
        if len(mark) == 1 and not (self.quotes(records) if len(records) else np.zeros(1)).any():
            counts = _per_line(records, mark)
            while len(counts) and counts.max() >= 0:
                at = int(counts.argmax())
                if self.filled(records[at].as_py()):
                    return int(counts[at]) + 1
                counts[at] = -1
            return 0
        return max(map(self.width, records.to_pylist()), default=0)


#: States of a dump: between statements, in one, and inside what the key opened.
BETWEEN, INSIDE = 0, 1
_OPENERS = {b"'": 2, b'"': 3, b"`": 4, b"/*": 5}
_OPEN = re.compile(rb"""['"`]|--(?=\s|$)|\#|/\*""")
_CLOSE = {
    2: re.compile(rb"(?s)(?:[^'\\]++|\\.|'')*+'"), 3: re.compile(rb'(?s)(?:[^"\\]++|\\.)*+"'),
    4: re.compile(rb"[^`]*+`"), 5: re.compile(rb"(?s).*?\*/"),
}


@dataclass(frozen=True)
class DumpLines:
    """SQL text: a record ends with a line whose last mark outside quotes and comments is a semicolon."""

    states = 6

    def step(self, line: bytes, state: int) -> int:
        at, opened = 0, state
        while True:
            if state > INSIDE:
                closed = _CLOSE[state].match(line, at)
                if not closed:
                    return state
                at, state = closed.end(), INSIDE
            found = _OPEN.search(line, at)
            if not found:
                stop = len(line)
                break
            state = _OPENERS.get(found.group())
            if state is None:  # a comment up to the line's end
                stop = found.start()
                break
            at = found.end()
        text = line[:stop].rstrip()
        if not text:
            return opened if opened in (BETWEEN, INSIDE) else INSIDE
        return BETWEEN if text.endswith(b";") and len(text) > at else INSIDE

    def ends(self, lines: pa.BinaryArray, state: int) -> np.ndarray:
        found = []
        for line in lines.to_pylist():
            state = self.step(line, state)
            found.append(state)
        return np.array(found, dtype=np.int64)

    def filled(self, record: bytes) -> bool:
        return bool(record.strip())

    def widest(self, records: pa.BinaryArray) -> int:
        return 0


Automaton = QuotedFields | DumpLines


def _per_line(lines: pa.BinaryArray, mark: bytes) -> np.ndarray:
    """How often a byte stands in each line: one pass over the bytes of all."""
    _, offsets, data = lines.buffers()
    if not len(lines) or data is None:
        return np.zeros(len(lines), dtype=np.int64)
    kind = np.int64 if pa.types.is_large_binary(lines.type) else np.int32
    ends = np.frombuffer(offsets, kind)[lines.offset : lines.offset + len(lines) + 1]
    places = np.flatnonzero(np.frombuffer(data, np.uint8)[ends[0] : ends[-1]] == mark[0]) + ends[0]
    return np.diff(np.searchsorted(places, ends)).astype(np.int64)


def _runs(batch: pa.RecordBatch) -> Iterator[tuple[int | str, int, pa.BinaryArray]]:
    """File, block and lines of each block of a batch, in order."""
    if not batch.num_rows:
        return
    files = batch.column("file").dictionary_encode()
    blocks = batch.column("block").to_numpy()
    codes = files.indices.to_numpy()
    cuts = np.flatnonzero((np.diff(codes) != 0) | (np.diff(blocks) != 0)) + 1
    for start, stop in zip([0, *cuts.tolist()], [*cuts.tolist(), batch.num_rows], strict=True):
        yield files.dictionary[int(codes[start])].as_py(), int(blocks[start]), batch.column("line").slice(start, stop - start)


def _is_utf8(lines: pa.BinaryArray) -> bool:
    try:
        lines.cast(pa.large_string() if pa.types.is_large_binary(lines.type) else pa.string())
    except pa.ArrowInvalid:
        return False
    return True


def _facts(automaton: Automaton, file_type: pa.DataType) -> Callable:
    schema = pa.schema([
        ("file", file_type), ("block", pa.int64()), ("turn", pa.list_(pa.int32())), ("utf8", pa.bool_()), ("odd", pa.bool_()),
        ("filled", pa.bool_()), ("width", pa.int32()), ("marks", pa.int64()), ("first", pa.binary()),
    ])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row = None

        def done() -> pa.RecordBatch:
            marks = sum(1 << i for i, c in enumerate(LINE_MARKS) if c.encode() in row["marks"])
            return pa.RecordBatch.from_pylist([row | {"marks": marks}], schema)

        for batch in batches:
            for file, block, lines in _runs(batch):
                if row is None or (row["file"], row["block"]) != (file, block):
                    if row:
                        yield done()
                    turn = list(range(automaton.states))
                    row = dict(file=file, block=block, turn=turn, utf8=True, odd=False, filled=False, width=0, marks=set(), first=None)
                ends = {state: automaton.ends(lines, state) for state in set(row["turn"])}
                row["turn"] = [int(ends[state][-1]) for state in row["turn"]]
                row["odd"] |= any((e != e[0]).any() or e[0] != s for s, e in ends.items())
                row["utf8"] = row["utf8"] and _is_utf8(lines)
                row["width"] = max(row["width"], automaton.widest(lines))
                for line in lines:
                    if row["filled"] and row["first"] is not None:
                        break
                    raw = line.as_py()
                    row["filled"] = row["filled"] or automaton.filled(raw)
                    if row["first"] is None and raw.strip(b" "):
                        row["first"] = raw
                if isinstance(automaton, QuotedFields):
                    for line in lines.to_pylist() if _holds_marks(lines) else ():
                        row["marks"].update(_MARKS.findall(line))
        if row:
            yield done()

    return run


def _holds_marks(lines: pa.BinaryArray) -> bool:
    data = lines.buffers()[2]
    return data is not None and _MARKS.search(memoryview(data)) is not None


def _starts(states: int) -> Callable:
    """The state in which each block begins, and in which its file's part up to its end ends; blocks come file by file in order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        file, state = None, 0
        for batch in batches:
            begins, ends = [], []
            for this, turn in zip(batch.column("file").to_pylist(), batch.column("turn").to_pylist(), strict=True):
                state = state if this == file else 0
                file = this
                begins.append(state)
                state = turn[state]
                ends.append(state)
            columns = [*batch.columns, pa.array(begins, pa.int32()), pa.array(ends, pa.int32())]
            yield pa.RecordBatch.from_arrays(columns, [*batch.schema.names, "begins", "ends"])

    return run


def raw_blocks(spark: SparkSession, path: str, named: bool = False) -> DataFrame:
    """``file, block, line``: lines as bytes. ``named`` gives the path of the file instead of a hash of it, and cuts at ``\\n`` only."""
    reader = spark.read.option("lineSep", "\n") if named else spark.read
    file = F.col("_metadata.file_path")
    return reader.text(path).select(
        (file if named else F.xxhash64(file)).alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
        F.col("value").cast("binary").alias("line"),
    )


def _file_type(lines: DataFrame) -> tuple[str, pa.DataType]:
    return ("string", pa.string()) if lines.schema["file"].dataType.typeName() == "string" else ("long", pa.int64())


def _kept(df: DataFrame, name: str) -> DataFrame:
    path = scratch_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def block_facts(lines: DataFrame, automaton: Automaton, encoding: str = "auto") -> DataFrame:
    """One row per block: the state it begins and ends in, whether its file is Latin-1, and what else one scan tells.

    ``leads`` marks the first block of a file with content, ``last`` the last one.
    """
    ddl, arrow = _file_type(lines)
    schema = f"file {ddl}, block long, turn array<int>, utf8 boolean, odd boolean, filled boolean, width int, marks long, first binary"
    own = Window.partitionBy("file")
    latin1 = F.lit(encoding == "latin1") if encoding != "auto" else ~F.bool_and("utf8").over(own)
    leads = F.col("block") == F.min(F.when(F.col("filled"), F.col("block"))).over(own)
    opening = F.col("block") == F.min(F.when(F.col("first").isNotNull(), F.col("block"))).over(own)
    found = lines.mapInArrow(_facts(automaton, arrow), schema).select(
        "*", latin1.alias("latin1"), F.coalesce(leads, F.lit(False)).alias("leads"),
        F.coalesce(opening, F.lit(False)).alias("opening"), (F.col("block") == F.max("block").over(own)).alias("last"),
    )
    ordered = found.sortWithinPartitions("file", "block")
    ddl = f"{schema}, latin1 boolean, leads boolean, opening boolean, last boolean, begins int, ends int"
    return _kept(ordered.mapInArrow(_starts(automaton.states), ddl), "blocks")


def special_blocks(facts: DataFrame) -> dict[tuple[int | str, int], tuple[int, bool, bool]]:
    """State, leads and latin1 of the blocks that aren't as most are: between records, UTF-8, and leading if they are the first."""
    usual = (F.col("begins") == 0) & ~F.col("latin1") & (F.col("leads") == (F.col("block") == 0))
    rows = facts.filter(~usual).select("file", "block", "begins", "leads", "latin1").collect()
    return {(r["file"], r["block"]): (r["begins"], r["leads"], r["latin1"]) for r in rows}


def _cut(automaton: Automaton, special, wanted: str, file_type: pa.DataType) -> Callable:
    """``wanted`` is ``records`` (whole ones but the leading one) or ``rest`` (fragments, leading records, widths)."""
    schema = pa.schema([
        ("file", file_type), ("block", pa.int64()), ("at", pa.int64()), ("kind", pa.int32()), ("lead", pa.bool_()), ("line", pa.binary())
    ])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = special.value
        key, state, leads, latin1, at, held, first, headed, width = None, 0, False, False, 0, [], 0, False, 0
        out: list[tuple] = []

        def emit(kind: int, raw: bytes, place: int) -> None:
            nonlocal leads, width
            lead = leads and kind in (WHOLE, TAIL) and automaton.filled(raw)
            leads = leads and not lead
            if (wanted == "records") == (kind == WHOLE and not lead):
                out.append((*key, place, kind, lead, raw.decode("latin-1").encode() if latin1 else raw))

        def finish() -> None:
            if held:
                emit(TAIL if headed else MIDDLE, b"\n".join(held), first)
            if wanted == "rest" and key is not None:
                out.append((*key, width, FACTS, False, b""))

        def flush() -> pa.RecordBatch:
            columns = list(zip(*out, strict=True)) if out else [()] * 6
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

        for batch in batches:
            for file, block, column in _runs(batch):
                if (file, block) != key:
                    finish()
                    key = (file, block)
                    state, leads, latin1 = known.get(key, (0, block == 0, False))
                    at, held, first, width = 0, [], 0, 0
                    headed = state == 0
                ends = automaton.ends(column, state)
                if wanted == "records" and state == 0 and not held and not leads and not latin1 and not ends.any():
                    # Every line is a record.
                    if out:
                        yield flush()
                    n = len(column)
                    yield pa.RecordBatch.from_arrays([
                        pa.array([file] * n, file_type), pa.array(np.full(n, block)), pa.array(np.arange(at, at + n)),
                        pa.array(np.zeros(n, np.int32)), pa.array(np.zeros(n, bool)), column,
                    ], schema=schema)
                    at += n
                    continue
                lines, begin, records = column.to_pylist(), 0, []
                for stop in (np.flatnonzero(ends == 0) + 1).tolist():
                    if held or stop - begin > 1:
                        raw, place = b"\n".join([*held, *lines[begin:stop]]), first if held else at + begin
                    else:
                        raw, place = lines[begin], at + begin
                    held = []
                    if headed:
                        records.append(raw)
                    emit(WHOLE if headed else HEAD, raw, place)
                    headed, begin = True, stop
                if begin < len(lines):
                    first = first if held else at + begin
                    held += lines[begin:]
                if wanted == "rest":
                    width = max(width, automaton.widest(pa.array(records, pa.binary())))
                state, at = int(ends[-1]), at + len(lines)
                if len(out) > 10_000:
                    yield flush()
            if out:
                yield flush()
        finish()
        yield flush()

    return run


@dataclass(frozen=True)
class Sections:
    """Records of files that were cut: whole ones stay lazy, the fragments at block ends are glued."""

    records: DataFrame
    leading: DataFrame
    glued: DataFrame
    width: int


def cut_records(lines: DataFrame, automaton: Automaton, facts: DataFrame) -> Sections:
    """``file, block, at, line`` of every record; ``leading`` has the first one with content of each file, ``records`` the others.

    ``glued`` are those that began in another block than they end in, ``width`` is the widest of the rest.
    """
    ddl, arrow = _file_type(lines)
    schema = f"file {ddl}, block long, at long, kind int, lead boolean, line binary"
    special = lines.sparkSession.sparkContext.broadcast(special_blocks(facts))
    rest = _kept(lines.mapInArrow(_cut(automaton, special, "rest", arrow), schema), "fragments")
    opened = F.sum((F.col("kind") == TAIL).cast("int")).over(
        Window.partitionBy("file").orderBy("block", "kind").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    parts = rest.filter(F.col("kind").isin(HEAD, MIDDLE, TAIL)).withColumn("section", opened)
    glued = parts.groupBy("file", "section").agg(
        F.array_sort(F.collect_list(F.struct("block", "at", F.col("line").cast("string").alias("line")))).alias("parts"),
        F.bool_or("lead").alias("lead"),
    )
    glued = glued.select(
        "file", F.col("parts")[0]["block"].alias("block"), F.col("parts")[0]["at"].alias("at"), "lead",
        F.array_join(F.col("parts.line"), "\n").alias("line"),
    )
    columns = ("file", "block", "at", F.col("line").cast("string").alias("line"))
    whole = lines.mapInArrow(_cut(automaton, special, "records", arrow), schema).select(*columns)
    leading = rest.filter((F.col("kind") == WHOLE) & F.col("lead")).select(*columns).unionAll(glued.filter("lead").select(*columns))
    width = rest.filter(F.col("kind") == FACTS).agg(F.max("at")).first()[0] or 0
    return Sections(whole.unionAll(glued.filter(~F.col("lead")).select(*columns)), leading, glued.select(*columns), width)


def open_files(facts: DataFrame) -> Column:
    """How many files end inside a record."""
    return F.coalesce(F.sum((F.col("last") & (F.col("ends") != 0)).cast("int")), F.lit(0))

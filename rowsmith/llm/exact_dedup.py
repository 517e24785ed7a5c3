"""Exact duplicates by Grace hashing.

*Records.* Each task hashes its texts and sends the first of equal ones on as their carrier, so a copy that fills
a third of the table is one carrier a task. Records go to a table in the shared folder, texts with carriers only.
*Rounds.* Carriers are dealt to buckets by a hash that is new in every round. A bucket fills an open-addressing table that holds
``budget`` bytes of texts; equal means that hash and complete content are equal. Texts that find no place in a full table
are spilled: they leave with the round's table and are dealt again in the next one, all copies of a text alike.
Rounds end when nothing was spilled.
*Crowds.* A hash that more than ``CROWD`` carriers have is cut by salt into parts first; each part sends one carrier on
to the next round, so no bucket sees more than about ``CROWD`` copies of a text however many tasks there are.

Nulls and ties: NULL counts as the empty text. Of equal texts the row of the largest id stays; a NULL id is smaller than any, and
of rows with equal id and text exactly one stays. Nothing is normalised: texts are equal when identical.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rowsmith.llm.common import releasing, row_copies, row_hash, saved, small_batches

#: Bytes of texts in the table of a bucket, and of a task that looks for its carriers.
BUDGET = 64 << 20
TASK_BUDGET = 16 << 20
#: What an entry of a table takes besides its text.
ENTRY = 128
#: Carriers of one hash, above which it is cut by salt; twice as many in every round, so that rounds end.
CROWD = 4096
#: Rows that a task can number.
ROWS = 1 << 33

RECORDS = "id long, hash long, row long, carrier long, mark long, sha binary, size long, text string"
ROUND = "carrier long, same long, mark long, size long, text string"


class OpenTable:
    """Texts by open addressing with linear probing; ``find`` compares complete content."""

    def __init__(self, budget: int) -> None:
        self.budget, self.bytes = budget, 0
        self.slots = np.full(1 << 10, -1, dtype=np.int64)
        self.marks: list[int] = []
        self.texts: list[bytes] = []
        self.names: list[int] = []

    def _probe(self, mark: int, text: bytes | None) -> tuple[int, int]:
        """Slot and entry of an equal text, or the free slot and -1."""
        mask = len(self.slots) - 1
        at = mark & mask
        while (entry := int(self.slots[at])) >= 0:
            if text is not None and self.marks[entry] == mark and self.texts[entry] == text:
                return at, entry
            at = (at + 1) & mask
        return at, -1

    def _grow(self) -> None:
        self.slots = np.full(2 * len(self.slots), -1, dtype=np.int64)
        for entry, mark in enumerate(self.marks):
            self.slots[self._probe(mark, None)[0]] = entry

    def find(self, mark: int, text: bytes, name: int) -> int | None:
        """The name under which an equal text stands, after entering this one if it is new; None if the table is full."""
        at, entry = self._probe(mark, text)
        if entry >= 0:
            return self.names[entry]
        if self.texts and self.bytes + len(text) + ENTRY > self.budget:
            return None
        self.slots[at] = len(self.texts)
        self.marks.append(mark)
        self.texts.append(text)
        self.names.append(name)
        self.bytes += len(text) + ENTRY
        if 2 * len(self.texts) > len(self.slots):
            self._grow()
        return name


def _bytes(text: pa.StringScalar) -> bytes:
    return text.as_buffer().to_pybytes() if text.is_valid else b""


def _records(budget: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, shas = OpenTable(budget), {}
        row = TaskContext.get().partitionId() * ROWS
        for batch in batches:
            found = []
            for at, text in enumerate(batch.column("text")):
                raw = _bytes(text)
                mark = xxhash.xxh3_64_intdigest(raw) - (1 << 63)
                carrier = table.find(mark, raw, row)
                if carrier is None or carrier == row:
                    sha = hashlib.sha256(raw).digest()
                    if carrier == row:
                        shas[row] = sha
                    found.append((row, row, mark, sha, len(raw), at))
                else:
                    found.append((row, carrier, mark, shas[carrier], len(raw), None))
                row += 1
            rows, carriers, marks, digests, sizes, places = zip(*found, strict=True) if found else ((),) * 6
            texts = batch.column("text").fill_null("").take(pa.array(places, pa.int32()))
            longs = [pa.array(c, pa.int64()) for c in (rows, carriers, marks)]
            columns = [batch.column("id"), batch.column("hash"), *longs, pa.array(digests, pa.binary()), pa.array(sizes, pa.int64()), texts]
            yield pa.RecordBatch.from_arrays(columns, ["id", "hash", "row", "carrier", "mark", "sha", "size", "text"])

    return releasing(run)


def _bucket(budget: int) -> Callable:
    """One round in one bucket: ``same`` names the carrier of an equal text; rows without it go on with their text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = OpenTable(budget)
        for batch in batches:
            same, places = [], []
            columns = (batch.column(c).to_pylist() for c in ("carrier", "mark", "salt"))
            for at, (carrier, mark, salt, text) in enumerate(zip(*columns, batch.column("text"), strict=True)):
                # The salt makes a part of a crowd a text of its own.
                found = table.find(mark ^ (salt + 1) * 0x9E3779B97F4A7C1 if salt >= 0 else mark, _bytes(text), carrier)
                # The first of a crowd's part stands for the part in the next round.
                onward = found is None or (salt >= 0 and found == carrier)
                same.append(None if onward else found)
                places.append(at if onward else None)
            texts = batch.column("text").take(pa.array(places, pa.int32()))
            kept = [batch.column("carrier"), pa.array(same, pa.int64()), batch.column("mark"), batch.column("size"), texts]
            yield pa.RecordBatch.from_arrays(kept, ["carrier", "same", "mark", "size", "text"])

    return releasing(run)


def _dealt(carriers: DataFrame, crowd: int) -> tuple[DataFrame, bool]:
    """The carriers with a salt (-1: none), and whether there are crowds."""
    crowds = saved(carriers.groupBy("mark").agg(F.count("*").alias("many")).filter(F.col("many") > crowd), "crowds")
    if crowds.isEmpty():
        return carriers.withColumn("salt", F.lit(-1).cast("long")), False
    parts = crowds.select(F.col("mark").alias("c_mark"), F.ceil(F.col("many") * 2 / crowd).cast("long").alias("parts"))
    salted = carriers.join(parts, F.col("mark") == F.col("c_mark"), "left")
    salt = F.coalesce(F.pmod(F.xxhash64("carrier"), F.col("parts")), F.lit(-1).cast("long"))
    return salted.withColumn("salt", salt).drop("c_mark", "parts"), True


def same_carriers(carriers: DataFrame, budget: int = BUDGET, crowd: int = CROWD, buckets: int | None = None) -> DataFrame:
    """``carrier, same`` of every carrier (``carrier, mark, size, text``): ``same`` is one of those with an equal text.

    ``buckets`` is the number of buckets of a round; without it they are as many as fill half their budgets.
    """
    rounds, level = [], 0
    while True:
        dealt, crowded = _dealt(carriers, crowd << level)
        total = dealt.agg(F.sum(F.col("size") + ENTRY)).first()[0] or 0
        many = buckets or max(2 * total // budget + 1, carriers.sparkSession.sparkContext.defaultParallelism)
        key = F.xxhash64(F.lit(level), "mark", "salt")
        spread = small_batches(dealt.select("carrier", "mark", "size", "text", "salt").repartition(many, key))
        done = saved(spread.mapInArrow(_bucket(budget), ROUND), f"round-{level}")
        rounds.append((done.filter("same IS NOT NULL").select("carrier", "same"), crowded))
        carriers = done.filter("same IS NULL").drop("same")
        if carriers.isEmpty():
            break
        level += 1
    named = rounds.pop()[0]
    for links, crowded in reversed(rounds):
        if crowded:
            # What a part's copies name may have found its own equal in a later round.
            later = named.select(F.col("carrier").alias("l_carrier"), F.col("same").alias("l_same"))
            joined = links.join(later, F.col("same") == F.col("l_carrier"), "left")
            links = joined.select("carrier", F.coalesce("l_same", "same").alias("same"))
        named = named.unionAll(links)
    return named


def _classes(
    docs: DataFrame, id_col: str, text_col: str, row_mark: Column, task_budget: int = TASK_BUDGET, **limits: int | None
) -> tuple[DataFrame, DataFrame]:
    """Every row with its class, and one row of facts for each class."""
    columns = (F.col(f"`{id_col}`").cast("long"), row_mark, F.col(f"`{text_col}`").cast("string"))
    own = docs.select(*[c.alias(n) for c, n in zip(columns, ("id", "hash", "text"), strict=True)])
    records = saved(small_batches(own).mapInArrow(_records(task_budget), RECORDS), "records")
    carriers = records.filter("row = carrier").select("carrier", "mark", "size", "text")
    named = same_carriers(carriers, **limits).withColumnRenamed("carrier", "n_carrier")
    rows = records.join(named, records["carrier"] == F.col("n_carrier")).select("id", "hash", "row", "sha", "same")
    rows = saved(rows, "classes")
    last = F.max(F.struct("id", "row", "hash")).alias("last")
    facts = rows.groupBy(F.col("same").alias("f_same")).agg(last, F.count("*").alias("many"))
    return rows, facts


def exact_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **limits: int | None
) -> DataFrame:
    """Every row's id, ``keep_id`` (of the equal row that stays), ``group_size``, ``kept`` and ``text_sha256``.

    ``limits`` are ``task_budget`` and what ``same_carriers`` takes; no result depends on them.
    """
    rows, facts = _classes(docs, id_col, text_col, F.lit(0).cast("long"), **limits)
    joined = rows.join(facts, F.col("same") == F.col("f_same"))
    return joined.select(
        F.col("id").alias(id_col), F.col("last.id").alias("keep_id"), F.col("many").alias("group_size"),
        (F.col("row") == F.col("last.row")).alias("kept"), F.lower(F.hex("sha")).alias("text_sha256"),
    )


def without_exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` with one row of each group of equal texts: that of the largest id."""
    rows, facts = _classes(docs, id_col, text_col, row_hash(docs))
    many = rows.groupBy("id", "hash").agg(F.count("*").alias("rows"))
    keep = facts.select(F.col("last.id").alias("k_id"), F.col("last.hash").alias("k_hash")).distinct()
    found = many.join(keep, many["id"].eqNullSafe(keep["k_id"]) & (many["hash"] == keep["k_hash"]))
    return row_copies(docs, id_col, found.select("id", "hash", F.lit(1).cast("long").alias("copies"), "rows"))

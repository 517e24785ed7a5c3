"""Token counts kept by deltas: totals by source, language and tokenizer version.

A batch of changes is signed: an insert adds a document and its tokens, a delete takes both away, a revised count
adds the difference; a document that changes its group is deleted there and inserted here. Totals are sums, so a batch is added up to one row per
group, before and after its only shuffle, and written as a delta of its own. Nothing that was counted before is read again.

*Commit.* Each try to commit a batch writes a folder of its own under the batch's id, complete once Spark's commit has left its
``_SUCCESS`` file. A batch with a complete try is never applied again; a try that was cut off is not read, and the next one does not
touch it. An id names one set of changes. Where several writers commit the same id at once, each of them finishes and readers
take one of their folders, so the batch counts once. ``compact`` writes the totals with the ids they hold, under a name of its own,
and readers take the newest complete compaction and the deltas it doesn't hold.

Nulls are groups of their own; a NULL count is 0. Each row of a batch counts, repeated rows too. A batch without rows commits
and changes nothing. Groups whose sums have come back to nothing are not shown.
"""

from __future__ import annotations

import re
import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

KEYS = ("source", "lang", "tokenizer")
_ID = re.compile(r"[A-Za-z0-9][A-Za-z0-9_.-]*")


def _signed(rows: DataFrame, documents: Column, tokens: Column) -> DataFrame:
    keys = [F.col(k).cast("string").alias(k) for k in KEYS]
    whole = [c.cast("long") for c in (documents, F.coalesce(tokens, F.lit(0)))]
    return rows.select(*keys, whole[0].alias("documents"), whole[1].alias("tokens"))


def inserted(rows: DataFrame, tokens: str = "tokens") -> DataFrame:
    """Changes that add each row of ``rows`` (source, lang, tokenizer, tokens)."""
    return _signed(rows, F.lit(1), F.col(tokens))


def deleted(rows: DataFrame, tokens: str = "tokens") -> DataFrame:
    """Changes that take away rows that were inserted with these counts."""
    return _signed(rows, F.lit(-1), -F.col(tokens))


def revised(rows: DataFrame, old: str, new: str) -> DataFrame:
    """Changes that replace the count ``old`` by ``new`` within a group."""
    return _signed(rows, F.lit(0), F.coalesce(new, F.lit(0)) - F.coalesce(old, F.lit(0)))


def all_of(*changes: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, changes)


class TokenCounts:
    """Totals kept under ``folder``, which every executor can reach."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        self._files = path.getFileSystem(spark._jsc.hadoopConfiguration())

    def _path(self, *parts: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path("/".join([self.folder, *parts]))

    def _names(self, *parts: str) -> list[str]:
        """Names in a folder, in order; none where it is missing."""
        path = self._path(*parts)
        return sorted(s.getPath().getName() for s in self._files.listStatus(path)) if self._files.exists(path) else []

    def _complete(self, *parts: str) -> list[str]:
        """Names of the complete folders in a folder, in order."""
        return [n for n in self._names(*parts) if self._files.exists(self._path(*parts, n, "_SUCCESS"))]

    def _batches(self) -> dict[str, str]:
        """Ids of the committed batches, and the folder that counts for each."""
        tries = {b: self._complete("deltas", b) for b in self._names("deltas")}
        return {b: f"{self.folder}/deltas/{b}/{found[0]}" for b, found in tries.items() if found}

    def is_committed(self, batch_id: str) -> bool:
        return bool(self._complete("deltas", batch_id))

    def apply(self, batch_id: str, changes: DataFrame) -> bool:
        """Commit a batch of changes; False, and nothing done, if that id is committed already."""
        if not _ID.fullmatch(batch_id):
            raise ValueError(f"not a batch id: {batch_id!r}")
        if self.is_committed(batch_id):
            return False
        sums = changes.groupBy(*KEYS).agg(F.sum("documents").alias("documents"), F.sum("tokens").alias("tokens"))
        sums.write.parquet(f"{self.folder}/deltas/{batch_id}/{uuid.uuid4().hex}")
        return True

    def _parts(self, batches: dict[str, str]) -> list[str]:
        """Folders whose sum is the state after the given batches."""
        compactions = self._complete("totals")
        if not compactions:
            return list(batches.values())
        held = {r["batch_id"] for r in self.spark.read.parquet(f"{self.folder}/held/{compactions[-1]}").collect()}
        return [f"{self.folder}/totals/{compactions[-1]}", *[path for b, path in batches.items() if b not in held]]

    def _sum(self, paths: list[str]) -> DataFrame:
        schema = ", ".join(f"{k} string" for k in KEYS) + ", documents long, tokens long"
        rows = self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)
        sums = rows.groupBy(*KEYS).agg(F.sum("documents").alias("documents"), F.sum("tokens").alias("tokens"))
        return sums.filter("documents != 0 OR tokens != 0")

    def totals(self) -> DataFrame:
        """source, lang, tokenizer, documents, tokens."""
        return self._sum(self._parts(self._batches()))

    def compact(self) -> None:
        """Write the totals of the batches committed by now; the ids they hold go first, so neither is read alone."""
        batches = self._batches()
        name, sums = f"{len(self._complete('totals')):08d}-{uuid.uuid4().hex}", self._sum(self._parts(batches))
        self.spark.createDataFrame([(b,) for b in batches], "batch_id string").write.parquet(f"{self.folder}/held/{name}")
        sums.write.parquet(f"{self.folder}/totals/{name}")

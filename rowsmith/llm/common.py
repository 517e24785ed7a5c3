"""Small helpers that several operators share."""

from __future__ import annotations

import sys
import types
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rowsmith.session import scratch_folder, use_utc

#: A word is a run of anything but the ASCII white space characters.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return use_utc(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def saved(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once to the shared folder and read back: lineage ends in files that all executors see."""
    path = scratch_folder(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def word_count(text: Column) -> Column:
    """Number of words; 0 for NULL."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def held_out(doc_id: Column) -> Column:
    """True where crc32 of the id's text leaves 2 when divided by 4; a NULL id counts as empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 4 == 2


def _hashable(kind: T.DataType) -> bool:
    if isinstance(kind, T.ArrayType):
        return _hashable(kind.elementType)
    if isinstance(kind, T.StructType):
        return all(_hashable(f.dataType) for f in kind.fields)
    return not isinstance(kind, (T.MapType, T.VariantType))


def row_hash(df: DataFrame) -> Column:
    """A hash of all columns that Spark can hash; equal rows get equal values."""
    columns = [F.col(f"`{f.name}`") for f in df.schema.fields if _hashable(f.dataType)]
    return F.xxhash64(*columns) if columns else F.lit(0).cast("long")


def free_name(df: DataFrame, name: str) -> str:
    """``name``, lengthened until no column of ``df`` has it."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def row_copies(docs: DataFrame, id_col: str, copies: DataFrame) -> DataFrame:
    """Each row of ``docs`` as often as ``copies`` says; ``copies`` has (id, hash, copies, rows).

    ``hash`` is ``row_hash`` of the row. Rows that are equal in every hashed column share one entry, where
    ``rows`` says how many they are and ``copies`` how many rows remain of all of them together.
    """
    key, total, many, same_id, same_key = (free_name(docs, f"rs_{n}") for n in ("hash", "copies", "rows", "same_id", "same_key"))
    own = docs.withColumn(key, row_hash(docs))
    facts = copies.select(
        F.col("id").alias(same_id), F.col("hash").alias(same_key), F.col("copies").alias(total), F.col("rows").alias(many)
    )
    facts = facts.filter(F.col(total) > 0)
    match = F.col(f"`{id_col}`").cast("long").eqNullSafe(F.col(same_id)) & (F.col(key) == F.col(same_key))
    joined = own.join(facts, match).drop(same_id, same_key)
    one = joined.filter(F.col(many) == 1)
    equal = joined.filter(F.col(many) > 1).dropDuplicates([id_col, key])
    rows = one.unionByName(equal)
    spare = free_name(rows, "rs_copy")
    rows = rows.withColumn(spare, F.explode(F.sequence(F.lit(1).cast("long"), F.col(total))))
    return rows.select(*[F.col(f"`{c}`") for c in docs.columns])


def worker_store(name: str) -> dict:
    """A dictionary that lives as long as the Python worker, or until the worker asks for another one.

    Functions travel by value, so their module globals are new in every task; this is not. Only one is kept: a worker
    that goes on to another operator's task gives back what the one before remembered.
    """
    holder = sys.modules.setdefault("rowsmith_worker_store", types.ModuleType("rowsmith_worker_store"))
    stores = holder.__dict__.setdefault("stores", {})
    if name not in stores:
        for other in stores.values():
            other.clear()
        stores.clear()
    return stores.setdefault(name, {})


def small_batches(df: DataFrame, size: str = "8m") -> DataFrame:
    """Send at most ``size`` of rows to Python at once, so long texts don't pile up in a batch."""
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", size)
    return df


def releasing(run: Callable) -> Callable:
    """``run`` over batches; what it remembered and Arrow's free buffers go back when its task ends.

    Python workers outlive their tasks, and an idle one should not hold memory that the next stage needs.
    """

    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()

    return wrapped

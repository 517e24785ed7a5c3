"""Mixing sources to target weights by weighted fair queueing.

Every source is a queue. Its documents are shuffled by a hash and put one behind the other, up to
``cap`` rounds of them; a document's virtual finish time is the words of its source up to and with it,
divided by the source's weight. All copies are sorted by finish time and the mix ends at the budget,
which is the number of words of all documents.

Because a queue that has run dry leaves its share to the others in the ratio of their weights, the
order is also the solution of the capped targets that :func:`source_targets` gives in closed form.

Skew: a source is cut into hash buckets of about ``BUCKET_ROWS`` documents before anything is
numbered; bucket sums are added up first, so one hot source is many small windows.

Nulls: a NULL source is a source of its own, the last one; a NULL text has no words. Documents without words
are never taken. Equal ids and repeated rows are documents of their own. An empty table gives an empty mix.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from rowsmith.llm.common import row_copies, row_hash, saved, word_count

WEIGHTS = (5, 2, 1)
CAP = 3
#: Documents of a source and round that are numbered together.
BUCKET_ROWS = 256
#: The first 13 hexadecimal digits of a hash are a whole number below this.
HASH_SPAN = 16**13


def sized_rows(docs: DataFrame, id_col: str, text_col: str, source_col: str) -> DataFrame:
    """id, source, size and content hash of every row, written once; ``row`` numbers the rows."""
    rows = docs.select(
        F.col(id_col).cast("long").alias("id"),
        F.col(source_col).cast("string").alias("source"),
        word_count(F.col(text_col)).alias("size"),
        row_hash(docs).alias("hash"),
    )
    return saved(rows.withColumn("row", F.monotonically_increasing_id()), "mix-sizes")


def source_targets(sized: DataFrame, weights: Sequence[float] = WEIGHTS, cap: int = CAP) -> DataFrame:
    """One row per source: ``source, documents, source_size, weight, target``, and ``budget`` of all.

    Sources are ranked by code point, NULL last, and weigh ``weights`` in turn. Sources are few next to
    documents (one row each here), so one window ranks them and one finds the level at which targets fit:
    with sources in the order of cap * size / weight, the first that isn't capped sets it.
    """
    sums = sized.groupBy("source").agg(F.count("*").alias("documents"), F.sum("size").alias("source_size"))
    ranked = sums.withColumn("place", F.row_number().over(W.orderBy(F.asc_nulls_last("source"))))
    turn = (F.col("place") - 1) % len(weights)
    ranked = ranked.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (turn + 1).cast("int")))
    ranked = ranked.withColumn("budget", F.sum("source_size").over(W.partitionBy()))
    most = F.col("source_size") * cap
    ranked = ranked.withColumn("dry_at", most / F.col("weight"))
    order = W.orderBy("dry_at", "place")
    before = F.coalesce(F.sum(most).over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    left = F.sum("weight").over(order.rowsBetween(0, W.unboundedFollowing))
    ranked = ranked.withColumn("own_level", (F.col("budget") - before).cast("double") / left)
    fits = F.col("own_level") <= F.col("dry_at")
    ranked = ranked.withColumn("level", F.max(F.when(fits, F.col("own_level"))).over(W.partitionBy()))
    target = F.least(most.cast("double"), F.col("level") * F.col("weight"))
    return ranked.select("source", "documents", "source_size", "weight", target.alias("target"), "budget")


def _shuffle_key(row_id: Column, turn: Column) -> Column:
    return F.md5(F.concat_ws(":", F.coalesce(row_id.cast("string"), F.lit("")), turn.cast("string")))


def mix_order(sized: DataFrame, targets: DataFrame, cap: int = CAP) -> DataFrame:
    """The mix: ``row, id, source, size, turn, finish`` of every taken copy, partitions in mix order."""
    join = sized["source"].eqNullSafe(targets["source"])
    rows = sized.filter(F.col("size") > 0).join(targets, join).drop(targets["source"])
    rows = rows.withColumn("turn", F.explode(F.sequence(F.lit(0), F.lit(cap - 1))))
    rows = rows.withColumn("key", _shuffle_key(F.col("id"), F.col("turn")))
    buckets = F.ceil(F.col("documents") / BUCKET_ROWS)
    at = F.conv(F.substring("key", 1, 13), 16, 10).cast("double") / float(HASH_SPAN)
    rows = rows.withColumn("bucket", F.floor(at * buckets).cast("long"))

    place = ["source", "turn", "bucket"]
    sums = rows.groupBy(*place).agg(F.sum("size").alias("bucket_size"))
    earlier = W.partitionBy("source").orderBy("turn", "bucket").rowsBetween(W.unboundedPreceding, -1)
    sums = sums.select(
        F.col("source").alias("b_source"), F.col("turn").alias("b_turn"), F.col("bucket").alias("b_bucket"),
        F.coalesce(F.sum("bucket_size").over(earlier), F.lit(0)).alias("earlier"),
    )
    inside = W.partitionBy(*place).orderBy("key", "hash", "row").rowsBetween(W.unboundedPreceding, 0)
    rows = rows.withColumn("inside", F.sum("size").over(inside))
    same = rows["source"].eqNullSafe(sums["b_source"]) & (rows["turn"] == sums["b_turn"]) & (rows["bucket"] == sums["b_bucket"])
    rows = rows.join(sums, same).drop("b_source", "b_turn", "b_bucket")
    rows = rows.withColumn("finish", (F.col("earlier") + F.col("inside")).cast("double") / F.col("weight"))

    kept = ["row", "id", "hash", "source", "size", "turn", "key", "finish", "budget"]
    order = ["finish", "key", "hash", "row"]
    sorted_rows = rows.select(*kept).repartitionByRange(*order).sortWithinPartitions(*order)
    sorted_rows = saved(sorted_rows.withColumn("part", F.spark_partition_id()), "mix-order")
    return _truncate(sorted_rows, order)


def _truncate(rows: DataFrame, order: list[str]) -> DataFrame:
    """Rows in order up to the budget: whole partitions by their sums, the one on the edge row by row."""
    parts = rows.groupBy("part").agg(F.sum("size").alias("part_size"), F.max("budget").alias("budget"))
    start = F.sum("part_size").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, 0)) - F.col("part_size")
    parts = parts.select("part", "part_size", start.alias("start"), "budget").filter(F.col("start") < F.col("budget"))
    parts = parts.withColumn("whole", F.col("start") + F.col("part_size") <= F.col("budget"))
    rows = rows.drop("budget").join(parts, "part")
    running = F.sum("size").over(W.partitionBy("part").orderBy(*order).rowsBetween(W.unboundedPreceding, 0))
    edge = rows.filter(~F.col("whole")).withColumn("running", running)
    edge = edge.filter(F.col("start") + F.col("running") <= F.col("budget")).drop("running")
    return rows.filter("whole").unionByName(edge).drop("part_size", "start", "whole", "budget")


def mix_sources(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weights: Sequence[float] = WEIGHTS,
    cap: int = CAP,
) -> DataFrame:
    """What the mix takes of every row: id, size, source_size, target, taken (words, repeats counted)."""
    sized = sized_rows(docs, id_col, text_col, source_col)
    targets = saved(source_targets(sized, weights, cap), "mix-targets")
    taken = mix_order(sized, targets, cap).groupBy(F.col("row").alias("t_row")).agg(F.sum("size").alias("taken"))
    rows = sized.join(targets, sized["source"].eqNullSafe(targets["source"])).drop(targets["source"])
    rows = rows.join(taken, rows["row"] == taken["t_row"], "left")
    return rows.select(
        F.col("id").alias(id_col), "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"),
        "source", "weight",
    )


def mixed_documents(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weights: Sequence[float] = WEIGHTS,
    cap: int = CAP,
) -> DataFrame:
    """The documents of the mix, each row as often as the mix takes it, with the columns of ``docs``."""
    sized = sized_rows(docs, id_col, text_col, source_col)
    targets = saved(source_targets(sized, weights, cap), "mix-targets")
    copies = mix_order(sized, targets, cap).groupBy("id", "hash").agg(F.count("*").alias("copies"))
    rows = sized.groupBy(F.col("id").alias("r_id"), F.col("hash").alias("r_hash")).agg(F.count("*").alias("rows"))
    facts = copies.join(rows, copies["id"].eqNullSafe(rows["r_id"]) & (copies["hash"] == rows["r_hash"]))
    return row_copies(docs, id_col, facts.select("id", "hash", "copies", "rows"))

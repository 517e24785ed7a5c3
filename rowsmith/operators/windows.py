"""Window functions that survive a hot partition key.

A plain window sorts all rows of one key in one task. Here rows are also cut by a
``bucket`` that never decreases in the ordering. Without one given, rows are partitioned by range of key
and ordering and the partition is the bucket: their number follows the data, and no task's
work depends on the size of a key. Each function works inside (key, bucket) and adds what the earlier
buckets contribute, which is one small row per (key, bucket). The results equal the plain window functions.

``order`` columns are not NULL and leave no ties that matter. With
``descending`` the whole ordering is reversed. NULL is a key like any other: joins compare
whole structs of keys, in which NULL equals NULL.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from rowsmith.session import checkpointed, kept

BUCKET = "bucket_"
GROUP = "group_"


def join_back(df: DataFrame, keys: Sequence[str], facts: DataFrame) -> DataFrame:
    """Add the columns of ``facts``, one row per key, to every row with that key."""
    values = facts.withColumn(GROUP, F.struct(*keys)).drop(*keys)
    return df.withColumn(GROUP, F.struct(*keys)).join(values, GROUP).drop(GROUP)


@dataclass(frozen=True)
class BucketedWindow:
    df: DataFrame
    keys: Sequence[str]
    order: Sequence[str]
    bucket: Column | None = None
    descending: bool = False

    @cached_property
    def bucketed(self) -> DataFrame:
        if self.bucket is not None:
            return self.df.withColumn(BUCKET, self.bucket)
        ranged = self.df.repartitionByRange(*self.keys, *self.order)
        # Pinned, as offsets and rows must see the same ranges, also after a lost executor.
        return checkpointed(ranged.withColumn(BUCKET, F.spark_partition_id()))

    def rows(self) -> DataFrame:
        """The rows with their bucket, and the struct of keys and bucket."""
        return self.bucketed.withColumn(GROUP, F.struct(*self.keys, BUCKET))

    def _sorted(self, names: Sequence[str]) -> list[Column]:
        return [F.col(n).desc() if self.descending else F.col(n).asc() for n in names]

    def inside(self) -> WindowSpec:
        return Window.partitionBy(GROUP).orderBy(*self._sorted(self.order))

    def over_buckets(self) -> WindowSpec:
        return Window.partitionBy(*self.keys).orderBy(*self._sorted([BUCKET]))

    def earlier_buckets(self) -> WindowSpec:
        return self.over_buckets().rowsBetween(Window.unboundedPreceding, -1)

    def all_buckets(self) -> WindowSpec:
        return Window.partitionBy(*self.keys)

    def per_bucket(self, *aggregates: Column) -> DataFrame:
        """One row per (key, bucket), pre-aggregated on the map side."""
        return self.bucketed.groupBy(*self.keys, BUCKET).agg(*aggregates)

    def attach(self, rows: DataFrame, offsets: DataFrame) -> DataFrame:
        """Join per-bucket facts to the rows, which keep the partitioning of the window."""
        facts = offsets.withColumn(GROUP, F.struct(*self.keys, BUCKET)).drop(*self.keys, BUCKET)
        return rows.join(facts, GROUP).drop(GROUP, BUCKET)

    def first_in(self, value: Column) -> Column:
        pick = F.max_by if self.descending else F.min_by
        return pick(value, F.struct(*self.order))

    def last_in(self, value: Column) -> Column:
        pick = F.min_by if self.descending else F.max_by
        return pick(value, F.struct(*self.order))


def _before(total: Column, spec: WindowSpec) -> Column:
    return F.coalesce(F.sum(total).over(spec), F.lit(0))


def row_number(w: BucketedWindow, name: str) -> DataFrame:
    sizes = w.per_bucket(F.count("*").alias("size_"))
    offsets = sizes.select(
        *w.keys, BUCKET, _before(F.col("size_"), w.earlier_buckets()).alias("before_")
    )
    local = w.rows().withColumn(name, F.row_number().over(w.inside()))
    joined = w.attach(local, offsets)
    return joined.withColumn(name, F.col(name) + F.col("before_")).drop("before_")


def _value_counts(w: BucketedWindow, by: str) -> BucketedWindow:
    counts = w.df.groupBy(*w.keys, by).agg(F.count("*").alias("size_"))
    return BucketedWindow(counts, w.keys, [by], w.bucket, w.descending)


def rank(w: BucketedWindow, by: str, name: str) -> DataFrame:
    """``RANK`` by one column. Only its distinct values are ordered, then joined back."""
    counted = running_sum(_value_counts(w, by), "size_", "upto_")
    ranks = counted.select(*w.keys, by, (F.col("upto_") - F.col("size_") + 1).alias(name))
    return join_back(w.df, [*w.keys, by], ranks)


def dense_rank(w: BucketedWindow, by: str, name: str) -> DataFrame:
    """``DENSE_RANK`` by one column: the row number of its distinct values."""
    ranks = row_number(_value_counts(w, by), name).drop("size_")
    return join_back(w.df, [*w.keys, by], ranks)


def ntile(w: BucketedWindow, tiles: int, name: str) -> DataFrame:
    """``NTILE`` from the row number and the size of the partition."""
    sizes = w.per_bucket(F.count("*").alias("size_"))
    offsets = sizes.select(
        *w.keys,
        BUCKET,
        _before(F.col("size_"), w.earlier_buckets()).alias("before_"),
        F.sum("size_").over(w.all_buckets()).alias("total_"),
    )
    local = w.rows().withColumn("rn_", F.row_number().over(w.inside()))
    rn = F.col("rn_") + F.col("before_") - 1
    small = F.floor(F.col("total_") / tiles)
    larger = F.col("total_") % tiles
    in_larger = larger * (small + 1)
    tile = F.when(rn < in_larger, F.floor(rn / (small + 1))).otherwise(
        larger + F.floor((rn - in_larger) / F.greatest(small, F.lit(1)))
    )
    joined = w.attach(local, offsets).withColumn(name, tile + 1)
    return joined.drop("rn_", "before_", "total_")


def lag_lead(w: BucketedWindow, value: str, lag_name: str, lead_name: str, number: str | None = None) -> DataFrame:
    """``LAG`` and ``LEAD`` by one row; bucket ends meet their neighbours' end rows.

    ``number`` adds the row number of the same window in the same pass.
    """
    edges = w.per_bucket(
        F.count("*").alias("size_"),
        F.struct(w.first_in(F.col(value)).alias("v")).alias("first_"),
        F.struct(w.last_in(F.col(value)).alias("v")).alias("last_"),
    )
    carried = edges.select(
        *w.keys,
        BUCKET,
        F.lag("last_").over(w.over_buckets()).alias("last_before_"),
        F.lead("first_").over(w.over_buckets()).alias("first_after_"),
        _before(F.col("size_"), w.earlier_buckets()).alias("before_"),
    )
    # Structs tell a NULL value from a missing row.
    local = w.rows().withColumns(
        {
            "lag_": F.lag(F.struct(F.col(value).alias("v"))).over(w.inside()),
            "lead_": F.lead(F.struct(F.col(value).alias("v"))).over(w.inside()),
            "rn_": F.row_number().over(w.inside()),
        }
    )
    found = {
        lag_name: F.coalesce("lag_", "last_before_")["v"],
        lead_name: F.coalesce("lead_", "first_after_")["v"],
    }
    if number:
        found[number] = F.col("rn_") + F.col("before_")
    return w.attach(local, carried).withColumns(found).drop(
        "lag_", "lead_", "rn_", "last_before_", "first_after_", "before_"
    )


def first_last(w: BucketedWindow, value: str, first_name: str, last_name: str) -> DataFrame:
    """``FIRST_VALUE`` and ``LAST_VALUE`` over the whole partition: one aggregate, one join."""
    edges = w.df.groupBy(*w.keys).agg(
        w.first_in(F.col(value)).alias(first_name), w.last_in(F.col(value)).alias(last_name)
    )
    return join_back(w.df, w.keys, edges)


def partition_aggregate(
    df: DataFrame, keys: Sequence[str], *aggregates: Column
) -> DataFrame:
    """Aggregates ``OVER (PARTITION BY keys)``: partial aggregates, then a join back."""
    return join_back(df, keys, df.groupBy(*keys).agg(*aggregates))


def running_sum(w: BucketedWindow, value: str, name: str) -> DataFrame:
    """``SUM(value)`` over ``ROWS UNBOUNDED PRECEDING``."""
    sums = w.per_bucket(F.sum(value).alias("sum_"))
    offsets = sums.select(
        *w.keys, BUCKET, F.sum("sum_").over(w.earlier_buckets()).alias("before_")
    )
    spec = w.inside().rowsBetween(Window.unboundedPreceding, Window.currentRow)
    joined = w.attach(w.rows().withColumn(name, F.sum(value).over(spec)), offsets)
    total = F.when(F.col("before_").isNull(), F.col(name)).otherwise(
        F.col("before_") + F.coalesce(F.col(name), F.lit(0))
    )
    return joined.withColumn(name, total).drop("before_")


def rows_frame(
    w: BucketedWindow, aggregates: dict[str, Column], preceding: int, following: int = 0,
    chunk_rows: int = 100_000,
) -> DataFrame:
    """Aggregates over ``ROWS BETWEEN preceding AND following``.

    Rows are numbered, cut into chunks of a fixed number of rows, and each chunk is given
    the rows of other chunks that its frames reach, so no task sees more than a chunk and a frame.
    """
    numbered = row_number(w, "rn_").withColumn("chunk_", F.floor((F.col("rn_") - 1) / chunk_rows))
    # A row stands in the frames of the rows from `following` before it to `preceding` after it.
    first = F.greatest(F.col("rn_") - 1 - following, F.lit(0))
    last = F.col("rn_") - 1 + preceding
    copies = F.sequence(F.floor(first / chunk_rows), F.floor(last / chunk_rows))
    spread = numbered.withColumn("home_", F.col("chunk_")).withColumn("chunk_", F.explode(copies))
    spec = (
        Window.partitionBy(*w.keys, "chunk_").orderBy("rn_").rowsBetween(-preceding, following)
    )
    framed = spread.withColumns({n: a.over(spec) for n, a in aggregates.items()})
    return framed.filter(F.col("chunk_") == F.col("home_")).drop("rn_", "chunk_", "home_")


#: Values of a chunk of ``range_frame``, among which the least of a frame inside one chunk is looked for.
FRAME_CHUNK = 256


def range_frame(
    df: DataFrame, keys: Sequence[str], order: Column, preceding: int, aggregates: dict[str, tuple[str, str]], chunk: int = FRAME_CHUNK
) -> DataFrame:
    """Aggregates over ``RANGE BETWEEN preceding PRECEDING AND CURRENT ROW``, however dense the rows lie.

    ``aggregates`` maps a name to (``count``, ``sum``, ``min`` or ``max``, column); ``*`` counts rows. Rows of one key and
    order value are added up first. Counts and sums are differences of two running totals: up to the value, and below the
    frame, which a probe row finds in the same pass. Minima and maxima come from chunks of a fixed number of values: the end of the
    first chunk, the beginning of the last one, and whole chunks between by a table of spans that double. No step
    depends on how many rows a frame holds. A row whose order value is NULL has a frame of those of its key.
    """
    found = df.withColumn("at_", order)
    facts, totals = [F.count("*").alias("rows_")], {}
    for name, (kind, column) in aggregates.items():
        value = F.lit(1) if column == "*" else F.col(column)
        if kind in ("count", "sum"):
            totals[f"{name}_n"] = F.count(value)
            if kind == "sum":
                totals[f"{name}_s"] = F.sum(value)
        elif kind in ("min", "max"):
            facts.append(getattr(F, kind)(value).alias(f"{name}_v"))
        else:
            raise ValueError(f"an aggregate is count, sum, min or max, not {kind!r}")
    values = found.groupBy(*keys, "at_").agg(*facts, *[total.alias(name) for name, total in totals.items()])
    values = kept(values, "values")
    present = values.filter("at_ IS NOT NULL")
    running = _frame_totals(present, keys, preceding, list(totals))
    picks = {name: kind for name, (kind, _) in aggregates.items() if kind in ("min", "max")}
    if picks:
        running = _frame_extremes(running, keys, picks, chunk)
    framed = values.filter("at_ IS NULL").withColumnsRenamed({f"{n}_v": n for n in picks}).unionByName(running, allowMissingColumns=True)
    results = []
    for name, (kind, _) in aggregates.items():
        if kind == "count":
            results.append(F.coalesce(f"{name}_n", F.lit(0)).alias(name))
        elif kind == "sum":
            results.append(F.when(F.col(f"{name}_n") > 0, F.col(f"{name}_s")).alias(name))
        else:
            results.append(F.col(name))
    return join_back(found, [*keys, "at_"], framed.select(*keys, "at_", *results)).drop("at_")


def _frame_totals(values: DataFrame, keys: Sequence[str], preceding: int, names: Sequence[str]) -> DataFrame:
    """``values`` with the totals of their frames, their place ``hi_`` among the values of the key, and ``lo_``, the first in the frame."""
    none = [F.lit(0).cast(values.schema[n].dataType).alias(n) for n in names]
    data = values.select(*keys, "at_", F.lit(1).alias("kind_"), F.col("at_").alias("home_"), F.lit(1).cast("long").alias("one_"), *names)
    # A probe stands before the values it is equal to, so it meets the total of what is below the frame.
    probes = values.select(*keys, (F.col("at_") - preceding).alias("at_"), F.lit(0).alias("kind_"), F.col("at_").alias("home_"), F.lit(0).cast("long").alias("one_"), *none)
    both = data.unionAll(probes)
    order = ["at_", "kind_", "home_"]
    ranged = both.repartitionByRange(*keys, *order).withColumn(BUCKET, F.spark_partition_id())
    w = BucketedWindow(kept(ranged, "frames"), keys, order, F.col(BUCKET))
    summed = ["one_", *names]
    sums = w.per_bucket(*[F.sum(n).alias(f"{n}_t") for n in summed])
    offsets = sums.select(*keys, BUCKET, *[_before(F.col(f"{n}_t"), w.earlier_buckets()).alias(f"{n}_b") for n in summed])
    spec = w.inside().rowsBetween(Window.unboundedPreceding, Window.currentRow)
    local = w.rows().withColumns({f"{n}_r": F.coalesce(F.sum(n).over(spec), F.lit(0)) for n in summed})
    upto = w.attach(local, offsets).select(*keys, "home_", "kind_", *[(F.col(f"{n}_r") + F.col(f"{n}_b")).alias(n) for n in summed])
    pick = lambda n, kind: F.max(F.when(F.col("kind_") == kind, F.col(n)))
    framed = upto.groupBy(*keys, F.col("home_").alias("at_")).agg(
        *[(pick(n, 1) - pick(n, 0)).alias(n) for n in names], pick("one_", 1).alias("hi_"), (pick("one_", 0) + 1).alias("lo_")
    )
    return join_back(values.drop(*names), [*keys, "at_"], framed)


def _frame_extremes(values: DataFrame, keys: Sequence[str], picks: dict[str, str], chunk: int) -> DataFrame:
    """The least or greatest ``<name>_v`` of the places ``lo_`` to ``hi_`` of each key."""
    in_chunk = lambda place: F.floor((F.col(place) - 1) / chunk)
    placed = values.withColumns({"c_lo_": in_chunk("lo_"), "c_hi_": in_chunk("hi_")})
    merge = lambda kind: F.least if kind == "min" else F.greatest
    chunks = placed.groupBy(*keys, F.col("c_hi_").alias("chunk_")).agg(
        *[getattr(F, kind)(f"{n}_v").alias(f"{n}_c") for n, kind in picks.items()],
        *[F.array_sort(F.collect_list(F.struct("hi_", F.col(f"{n}_v").alias("v"))))["v"].alias(f"{n}_l") for n in picks],
    )
    chunks = kept(chunks, "chunks")
    # Level k of the table has the extreme of 2^k chunks from each one on.
    level = chunks.select(*keys, "chunk_", F.lit(0).alias("level_"), *[F.col(f"{n}_c").alias(f"{n}_t") for n in picks])
    spans, width = level, 1
    longest = chunks.agg(F.max("chunk_")).first()[0] or 0
    while 2 * width <= longest:
        following = level.select(*keys, (F.col("chunk_") - width).alias("chunk_"), *[F.col(f"{n}_t").alias(f"{n}_f") for n in picks])
        both = join_back(level, [*keys, "chunk_"], following)
        level = both.select(*keys, "chunk_", (F.col("level_") + 1).alias("level_"), *[merge(k)(f"{n}_t", f"{n}_f").alias(f"{n}_t") for n, k in picks.items()])
        level, width = kept(level, "spans"), 2 * width
        spans = spans.unionAll(level)
    lists = lambda side: chunks.select(*keys, F.col("chunk_").alias(f"c_{side}_"), *[F.col(f"{n}_l").alias(f"{n}_{side}") for n in picks])
    between = F.col("c_hi_") - F.col("c_lo_") - 1
    steps = F.when(between > 0, F.floor(F.log2(between.cast("double"))).cast("int"))
    first = F.col("c_lo_") * chunk + 1
    tails, heads = {}, {}
    for n, kind in picks.items():
        pick = F.array_min if kind == "min" else F.array_max
        # Up to the end of the frame, where that lies in the same chunk.
        in_first = F.least(F.col("hi_") - F.col("lo_") + 1, F.lit(chunk)).cast("int")
        tails[n] = pick(F.slice(f"{n}_lo", (F.col("lo_") - first + 1).cast("int"), in_first))
        head = pick(F.slice(f"{n}_hi", F.lit(1), (F.col("hi_") - F.col("c_hi_") * chunk).cast("int")))
        heads[n] = F.when(F.col("c_lo_") == F.col("c_hi_"), F.col(n)).otherwise(merge(kind)(n, head))
    # A chunk's values become one before the next shuffle, which would else carry them with every row.
    ends = join_back(placed, [*keys, "c_lo_"], lists("lo")).withColumns(tails).drop(*[f"{n}_lo" for n in picks])
    ends = join_back(ends, [*keys, "c_hi_"], lists("hi")).withColumns(heads).drop(*[f"{n}_hi" for n in picks]).withColumn("steps_", steps)
    near, far = (
        spans.select(*[F.col(k).alias(f"{k}_{side}") for k in keys], F.col("chunk_").alias(f"chunk_{side}"), F.col("level_").alias(f"level_{side}"),
                     *[F.col(f"{n}_t").alias(f"{n}_{side}") for n in picks])
        for side in ("near", "far")
    )
    at_near, at_far = F.col("c_lo_") + 1, F.col("c_hi_") - F.pow(F.lit(2), F.col("steps_")).cast("long")
    for side, spans_of, at in (("near", near, at_near), ("far", far, at_far)):
        match = (F.col(f"level_{side}") == F.col("steps_")) & (F.col(f"chunk_{side}") == at)
        for k in keys:
            match &= F.col(k).eqNullSafe(F.col(f"{k}_{side}"))
        ends = ends.join(spans_of, match, "left")
    results = [merge(kind)(n, f"{n}_near", f"{n}_far").alias(n) for n, kind in picks.items()]
    others = [c for c in values.columns if not c.endswith("_v")]
    return ends.select(*others, *results)

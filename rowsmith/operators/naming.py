"""Distinct names for many rows, as one reader of them all would number them.

Names are given in order: a row gets its cleaned name, or where that is taken the first of ``name_2``, ``name_3``, ... that is
free. A numbered name can be another row's own name, so groups compete: ``x, x, x_2`` are ``x, x_2, x_2_2``, but ``x, x_2, x`` are
``x, x_2, x_3``. Only names that end in a number and whose stem is there too are open to that. Who has them is found in rounds until nothing
changes; each round compares the row of the stem that would take the name with the first row that bears it. Everything else follows from row
numbers within a name, whatever the size of the group.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rowsmith.functions.names import sanitize_column
from rowsmith.operators.windows import BucketedWindow, row_number, running_sum
from rowsmith.session import checkpointed

NUMBERED = r"^(.+)_([2-9]|[1-9][0-9]{1,8})$"


def _contested(groups: DataFrame, numbered: DataFrame) -> DataFrame:
    """``stem_, n_, own_, won_``: numbered names that are rows' own names, and whether the stem's group has them."""
    own = groups.select(
        F.col("base_").alias("own_"), F.col("first_").alias("own_first_"),
        F.regexp_extract("base_", NUMBERED, 1).alias("stem_"), F.regexp_extract("base_", NUMBERED, 2).cast("long").alias("n_"),
    ).filter("stem_ != ''")
    state = checkpointed(own.join(groups.select(F.col("base_").alias("stem_")), "stem_").withColumn("won_", F.lit(False)))
    earlier = Window.partitionBy("stem_").orderBy("n_").rowsBetween(Window.unboundedPreceding, -1)
    items = numbered.select(F.col("base_").alias("i_base"), F.col("idx_").alias("i_idx"), F.col("order_").alias("i_order"))
    while not state.isEmpty():
        taken = state.filter("won_").select(F.col("own_").alias("stem_"), F.lit(0).alias("itself_"))
        joined = state.join(taken, "stem_", "left")
        lost = F.coalesce(F.sum(F.when(F.col("won_"), 0).otherwise(1)).over(earlier), F.lit(0))
        # The row of the stem's group whose turn it would be.
        turn = joined.withColumn("turn_", F.coalesce("itself_", F.lit(1)) + F.col("n_") - 1 - lost)
        met = turn.join(items, (F.col("stem_") == F.col("i_base")) & (F.col("turn_") == F.col("i_idx")), "left")
        won = F.coalesce(F.col("i_order") < F.col("own_first_"), F.lit(False))
        found = checkpointed(met.select("stem_", "n_", "own_", "own_first_", won.alias("won_"), F.col("won_").alias("before_")))
        state = found.drop("before_")
        if found.filter("won_ != before_").isEmpty():
            break
    return state


def distinct_names(df: DataFrame, raw: Column, order: str, name: str = "name", prefix: str = "column") -> DataFrame:
    """Add ``name``: distinct over all rows, given in the order of a unique column."""
    rows = df.withColumns({"base_": sanitize_column(raw, prefix), "order_": F.col(order)})
    numbered = checkpointed(row_number(BucketedWindow(rows, ["base_"], ["order_"]), "idx_"))
    groups = checkpointed(numbered.groupBy("base_").agg(F.min("order_").alias("first_")))
    state = _contested(groups, numbered)
    taken = state.filter("won_").select(F.col("own_").alias("t_base"))
    joined = numbered.join(taken, F.col("base_") == F.col("t_base"), "left")
    # Place among the numbered names; 0 is the name itself.
    placed = joined.withColumn("place_", F.col("idx_") - F.when(F.col("t_base").isNull(), 1).otherwise(0)).drop("t_base")
    by_number = Window.partitionBy("stem_").orderBy("n_")
    lost = state.filter("NOT won_").select(
        F.col("stem_").alias("base_"), (F.col("n_") - F.row_number().over(by_number)).alias("place_"), F.lit(0).alias("kind_"), F.lit(1).cast("long").alias("skip_")
    )
    some = placed.join(lost.select("base_").distinct(), "base_", "left_semi").select("base_", "place_", F.lit(1).alias("kind_"), F.lit(0).cast("long").alias("skip_"))
    skips = running_sum(BucketedWindow(lost.unionAll(some), ["base_"], ["place_", "kind_"]), "skip_", "skipped_")
    skips = skips.filter("kind_ = 1").select(F.col("base_").alias("s_base"), F.col("place_").alias("s_place"), "skipped_")
    found = placed.join(skips, (F.col("base_") == F.col("s_base")) & (F.col("place_") == F.col("s_place")), "left")
    number = F.col("place_") + 1 + F.coalesce("skipped_", F.lit(0))
    given = F.when(F.col("place_") == 0, F.col("base_")).otherwise(F.concat_ws("_", "base_", number.cast("string")))
    return found.withColumn(name, given).select(*df.columns, name)

"""Approximate nearest neighbours: a forest of random-projection trees with one shared priority queue.

*Index.* A tree has one random direction per level and a threshold per node, the median of a bounded sample of
``SAMPLE`` vectors; every vector is put into one leaf of every tree. The number of levels follows the number of
vectors, so leaves stay near ``LEAF`` vectors. *Search.* A query walks all trees at once: nodes wait in one heap by
the smallest margin on their path, and the first ``leaves`` leaves that come out are read. Queries meet the
vectors of a leaf in a grouped block product; leaves with many rows or many queries are cut into chunks on both
sides first. The best of each block, found again in exact left-to-right double sums, go on to the ranking.

*Recall.* ``leaves`` is measured, not guessed: for ``PROBES`` queries the true neighbours are found by brute force over
all vectors, and the smallest number of leaves that reaches ``RECALL`` of them is used for all queries. On clustered vectors that
is a few leaves however many vectors there are; on vectors without any structure it is a fixed share of them.
A query whose leaves hold fewer than ``k`` other points goes on with four times as many, up to all of them, so
it has its ``k`` rows however uneven the leaves are.

Equal vectors are one point of the index with its smallest ids, since nobody can see more than the first ``k`` + 1 of them.

Defined cases: vectors that are NULL, empty, zero, or hold a NULL or non-finite component take no part, nor does
a NULL id or a length other than the most frequent one (ties: the shorter). Rows equal in id and vector count once. Ties
in score go to the smaller id. Fewer candidates than ``k`` are all returned; an empty table gives no rows.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from rowsmith.llm.common import saved, small_batches

TREES = 8
LEAF = 512
SAMPLE = 20_000
PROBES = 96
RECALL = 0.96
#: Rows and queries of one leaf that are multiplied at once.
LEAF_CHUNK, QUERY_CHUNK = 2048, 2048


class Forest:
    """Directions of every level and thresholds of every node; small enough to travel with a task."""

    def __init__(self, sample: np.ndarray, points: int, trees: int = TREES, leaf: int = LEAF, seed: int = 42) -> None:
        self.levels = max(0, int(np.ceil(np.log2(max(points, 1) / leaf))))
        self.trees = trees if self.levels else 1
        rng = np.random.default_rng(seed)
        shape = (self.trees, self.levels, sample.shape[1] if sample.ndim == 2 else 0)
        self.directions = rng.normal(size=shape)
        self.thresholds: list[list[np.ndarray]] = []
        for tree in range(self.trees):
            node, levels = np.zeros(len(sample), dtype=np.int64), []
            for level in range(self.levels):
                along = sample @ self.directions[tree, level]
                cuts = np.full(1 << level, np.median(along))
                order = np.lexsort((along, node))
                names, starts, many = np.unique(node[order], return_index=True, return_counts=True)
                cuts[names] = along[order][starts + many // 2]
                node = node * 2 + (along > cuts[node])
                levels.append(cuts)
            self.thresholds.append(levels)

    def leaf_of(self, vectors: np.ndarray, tree: int) -> np.ndarray:
        node = np.zeros(len(vectors), dtype=np.int64)
        for level, cuts in enumerate(self.thresholds[tree]):
            node = node * 2 + (vectors @ self.directions[tree, level] > cuts[node])
        return node

    def nearest_leaves(self, vector: np.ndarray, many: int) -> list[tuple[int, int]]:
        """(tree, leaf) in the order of a shared priority queue, ``many`` of them at most."""
        along = self.directions @ vector
        queue = [(-np.inf, tree, 0, 0) for tree in range(self.trees)]
        found: list[tuple[int, int]] = []
        while queue and len(found) < many:
            worst, tree, level, node = heapq.heappop(queue)
            if level == self.levels:
                found.append((tree, node))
                continue
            margin = float(along[tree, level] - self.thresholds[tree][level][node])
            heapq.heappush(queue, (max(worst, margin), tree, level + 1, node * 2))
            heapq.heappush(queue, (max(worst, -margin), tree, level + 1, node * 2 + 1))
        return found


def _matrix(column: pa.Array) -> np.ndarray:
    if not len(column):
        return np.zeros((0, 0))
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def usable_rows(rows: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """``id, vec`` of the rows that take part, each pair once."""
    vec = F.col(vector_col).cast("array<double>")
    rows = rows.select(F.col(id_col).cast("long").alias("id"), vec.alias("vec")).filter("id IS NOT NULL AND size(vec) > 0")
    finite = F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = rows.filter(finite & F.exists("vec", lambda x: x != 0))
    sizes = rows.groupBy(F.size("vec").alias("n")).count().orderBy(F.desc("count"), "n").take(1)
    return rows.filter(F.size("vec") == (sizes[0]["n"] if sizes else 0)).dropDuplicates(["id", "vec"])


def index_points(rows: DataFrame, k: int) -> DataFrame:
    """``point, vec, ids`` of every different vector; ids are its smallest ``k`` + 1."""
    first = rows.withColumn("n", F.row_number().over(W.partitionBy("vec").orderBy("id"))).filter(F.col("n") <= k + 1)
    points = first.groupBy("vec").agg(F.sort_array(F.collect_list("id")).alias("ids"))
    return saved(points.withColumn("point", F.monotonically_increasing_id()), "points")


def _best_of_batches(queries: np.ndarray, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors = _matrix(batch.column("vec"))
            for q, scores in enumerate(queries @ vectors.T):
                top = np.argpartition(-scores, k)[:k] if len(scores) > k else np.arange(len(scores))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([q] * len(top), pa.int32()), batch.column("vec").take(pa.array(top)), pa.array(scores[top])],
                    ["q", "vec", "score"],
                )

    return run


def leaves_needed(points: DataFrame, queries: DataFrame, forest: Forest, k: int, probes: int, recall: float) -> int:
    """Leaves to read so that ``recall`` of the true neighbours of some queries is found."""
    total = forest.trees << forest.levels
    if not forest.levels:
        return 1
    probe = queries.select("vec").orderBy(F.xxhash64("vec")).limit(probes).toArrow()
    vectors = _matrix(probe.column("vec").combine_chunks())
    best = small_batches(points.select("vec")).mapInArrow(_best_of_batches(vectors, k + 1), "q int, vec array<double>, score double")
    place = F.row_number().over(W.partitionBy("q").orderBy(F.desc("score")))
    # Place 1 is the query itself.
    true = best.withColumn("n", place).filter((F.col("n") > 1) & (F.col("n") <= k + 1)).select("q", "vec").toArrow()
    near, of = _matrix(true.column("vec").combine_chunks()), true.column("q").to_numpy()
    homes = [forest.leaf_of(near, tree) for tree in range(forest.trees)]
    needed = []
    for q in range(len(vectors)):
        turn = {leaf: n for n, leaf in enumerate(forest.nearest_leaves(vectors[q], total), start=1)}
        needed += [min(turn[tree, int(homes[tree][i])] for tree in range(forest.trees)) for i in np.flatnonzero(of == q)]
    return int(np.quantile(needed, recall, method="higher")) if needed else total


def _index_rows(forest: Forest):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors = _matrix(batch.column("vec"))
            for tree in range(forest.trees):
                leaf = forest.leaf_of(vectors, tree) if len(vectors) else np.zeros(0, dtype=np.int64)
                columns = [pa.array(tree << 40 | leaf), batch.column("point"), batch.column("vec")]
                yield pa.RecordBatch.from_arrays(columns, ["leaf", "point", "vec"])

    return run


def _query_rows(forest: Forest, leaves: int, sample: np.ndarray, k: int):
    """A row for each leaf a query reads, and the least score that can still be among its best found.

    That is the score of the ``k`` + 1st best vector of the sample in those leaves: the sample is part of the index,
    so the query finds these, and nothing below them is among the best of what it finds.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        members: dict[int, np.ndarray] = {}
        for tree in range(forest.trees if len(sample) else 0):
            home = forest.leaf_of(sample, tree)
            order = np.argsort(home, kind="stable")
            names, starts = np.unique(home[order], return_index=True)
            members |= {tree << 40 | int(n): some for n, some in zip(names, np.split(order, starts[1:]), strict=True)}
        none = np.zeros(0, dtype=np.int64)
        for batch in batches:
            for at, vector in enumerate(_matrix(batch.column("vec"))):
                keys = [tree << 40 | leaf for tree, leaf in forest.nearest_leaves(vector, leaves)]
                met = np.unique(np.concatenate([members.get(key, none) for key in keys]))
                floor = -np.inf
                if len(met) > k:
                    floor = float(np.partition(sample[met] @ vector, len(met) - k - 1)[len(met) - k - 1])
                same = pa.array([at] * len(keys), pa.int32())
                columns = [batch.column("point").take(same), batch.column("vec").take(same), pa.array([floor] * len(keys), pa.float64())]
                yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), *columns], ["leaf", "point", "vec", "floor"])

    return run


def _block_scores(k: int):
    def run(queries: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        q, r = np.stack(queries["vec"].to_numpy()), np.stack(rows["vec"].to_numpy())
        scores = q @ r.T
        keep = min(k + 1, scores.shape[1])
        # Rounding differs between block shapes, so a little below the last one is kept too.
        edge = np.partition(scores, scores.shape[1] - keep, axis=1)[:, scores.shape[1] - keep]
        edge = np.maximum(edge, queries["floor"].to_numpy())
        edge[~np.isfinite(edge)] = scores.min()
        a, b = np.nonzero(scores >= (edge - 1e-9 * np.abs(edge) - 1e-12)[:, None])
        exact = np.zeros(len(a))
        for column in range(q.shape[1]):
            exact += q[a, column] * r[b, column]
        return pd.DataFrame({"q": queries["point"].to_numpy()[a], "point": rows["point"].to_numpy()[b], "score": exact})

    return run


def _chunks(count: Column, size: int) -> Column:
    return F.greatest(F.ceil(count / size), F.lit(1)).cast("int")


def _candidates(index: DataFrame, visits: DataFrame, k: int) -> DataFrame:
    """``q, point, score``: the best of every leaf that a query reads."""
    rows_in = index.groupBy("leaf").agg(F.count("*").alias("n_rows"))
    asked = visits.groupBy("leaf").agg(F.count("*").alias("n_asked"))
    sizes = rows_in.join(asked, "leaf").select(
        F.col("leaf").alias("s_leaf"), _chunks(F.col("n_rows"), LEAF_CHUNK).alias("row_chunks"),
        _chunks(F.col("n_asked"), QUERY_CHUNK).alias("query_chunks"),
    )
    own_row = F.pmod(F.xxhash64("point"), F.col("row_chunks")).cast("int")
    own_query = F.pmod(F.xxhash64("point"), F.col("query_chunks")).cast("int")
    rows = index.join(sizes, index["leaf"] == sizes["s_leaf"]).withColumn("rc", own_row)
    rows = rows.withColumn("qc", F.explode(F.sequence(F.lit(0), F.col("query_chunks") - 1)))
    queries = visits.join(sizes, visits["leaf"] == sizes["s_leaf"]).withColumn("qc", own_query)
    queries = queries.withColumn("rc", F.explode(F.sequence(F.lit(0), F.col("row_chunks") - 1)))
    key = ["leaf", "rc", "qc"]
    left, right = queries.select(*key, "point", "vec", "floor").groupBy(*key), rows.select(*key, "point", "vec").groupBy(*key)
    return left.cogroup(right).applyInPandas(_block_scores(k), "q long, point long, score double")


def _found(index: DataFrame, queries: DataFrame, forest: Forest, leaves: int, sample: np.ndarray, k: int) -> DataFrame:
    """``q, point, score`` of every query; one whose leaves hold too few points goes on with four times as many."""
    schema = "leaf long, point long, vec array<double>, floor double"
    total, found = forest.trees << forest.levels, None
    while True:
        visits = queries.mapInArrow(_query_rows(forest, leaves, sample, k), schema)
        now = saved(_candidates(index, visits, k).dropDuplicates(["q", "point"]), "candidates")
        found = now if found is None else found.unionAll(now)
        if leaves >= total:
            return found
        met = now.groupBy(F.col("q").alias("m_q")).agg(F.count("*").alias("met")).filter(F.col("met") > k)
        short = saved(queries.join(met, queries["point"] == met["m_q"], "left_anti"), "short")
        if short.isEmpty():
            return found
        found = found.join(short.select(F.col("point").alias("s_q")), F.col("q") == F.col("s_q"), "left_anti")
        queries, leaves = short, min(total, 4 * leaves)


def nearest(
    table: DataFrame,
    is_query: Column,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    k: int = 20,
    trees: int = TREES,
    leaf: int = LEAF,
    recall: float = RECALL,
) -> DataFrame:
    """``query_id, rank, vec_id, score``: the ``k`` rows of largest inner product found for each query row.

    ``is_query`` is a condition on the column ``id``.
    """
    rows = saved(usable_rows(table, id_col, vector_col), "vectors")
    points = index_points(rows, k)
    asked = rows.filter(is_query).select(F.col("id").alias("query_id"), F.col("vec").alias("q_vec"))
    asked = saved(asked.join(points, asked["q_vec"] == points["vec"]).select("query_id", "point"), "asked")
    queries = points.join(asked.select("point").distinct(), "point", "left_semi").select("point", "vec")
    drawn = points.select("vec").orderBy(F.xxhash64("vec")).limit(SAMPLE).toArrow()
    sample = _matrix(drawn.column("vec").combine_chunks())
    forest = Forest(sample, points.count(), trees, leaf)
    leaves = leaves_needed(points, queries, forest, k, PROBES, recall)
    schema = "leaf long, point long, vec array<double>"
    index = points.select("point", "vec").mapInArrow(_index_rows(forest), schema)
    found = _found(index, queries, forest, leaves, sample, k)
    named = found.join(points.select("point", "ids"), "point")
    order = W.partitionBy("q").orderBy(F.desc("score"), F.element_at("ids", 1))
    named = named.withColumn("n", F.row_number().over(order)).filter(F.col("n") <= k + 1)
    each = named.select("q", F.explode("ids").alias("id"), "score")
    ranked = F.sort_array(F.collect_list(F.struct((-F.col("score")).alias("far"), "id", "score")))
    lists = each.groupBy("q").agg(F.slice(ranked, 1, k + 1).alias("list"))
    own = asked.join(lists, asked["point"] == lists["q"])
    others = F.filter("list", lambda x: x["id"] != F.col("query_id"))
    own = own.select("query_id", F.posexplode(F.slice(others, 1, k)).alias("at", "x"))
    return own.select("query_id", (F.col("at") + 1).alias("rank"), F.col("x.id").alias("vec_id"), F.col("x.score").alias("score"))

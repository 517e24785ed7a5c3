from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from rowsmith.llm import neighbours


def plain_nearest(rows, queries, k):
    found = {}
    for q, v in queries:
        others = sorted((-float(np.dot(v, w)), i) for i, w in rows if i != q)[:k]
        found[q] = [i for _, i in others]
    return found


def test_recall_against_brute_force(spark):
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(12, 24))
    vectors = centres[rng.integers(12, size=3000)] + 0.7 * rng.normal(size=(3000, 24))
    rows = [(i, v.tolist()) for i, v in enumerate(vectors)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    found = neighbours.nearest(table, F.col("id") % 20 == 0, leaf=64).toPandas()
    assert found.groupby("query_id").size().eq(20).all()
    hits = 0
    for q, part in found.groupby("query_id"):
        part = part.sort_values("rank")
        scores = vectors @ vectors[q]
        scores[q] = -np.inf
        assert q not in set(part["vec_id"])
        assert np.allclose(part["score"], scores[part["vec_id"]], rtol=0, atol=1e-11)
        assert list(zip(-part["score"], part["vec_id"], strict=True)) == sorted(zip(-part["score"], part["vec_id"], strict=True))
        hits += len(set(part["vec_id"]) & set(np.argsort(-scores)[:20]))
    assert hits / len(found) >= 0.9


def test_all_candidates_of_a_small_table(spark):
    rng = np.random.default_rng(1)
    rows = [(i, rng.integers(-2, 3, 3).astype(float).tolist()) for i in range(1, 15)] + [(20, [1.0, 0.0, 0.0]), (40, [1.0, 0.0, 0.0])]
    used = [(i, v) for i, v in rows if any(v)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    found = neighbours.nearest(table, F.col("id") % 20 == 0, k=20).orderBy("query_id", "rank").collect()
    expected = plain_nearest(used, [(20, rows[-2][1]), (40, rows[-1][1])], 20)
    assert {q: [r.vec_id for r in found if r.query_id == q] for q in (20, 40)} == expected


def test_many_equal_vectors_and_rows_that_take_no_part(spark):
    nan, inf = float("nan"), float("inf")
    odd = [(101, None), (102, []), (103, [0.0, 0.0]), (104, [1.0, None]), (105, [nan, 1.0]), (106, [inf, 1.0]), (None, [1.0, 1.0]), (107, [1.0, 2.0, 3.0])]
    rows = [(i, [1.0, 1.0]) for i in range(60)] + [(60, [2.0, 2.0])] * 2 + odd
    table = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, embedding array<double>, id string")
    found = neighbours.nearest(table, F.col("id") % 20 == 0, k=5).orderBy("query_id", "rank").collect()
    by = {q: [r.vec_id for r in found if r.query_id == q] for q in (0, 20, 40, 60)}
    assert by == {0: [60, 1, 2, 3, 4], 20: [60, 0, 1, 2, 3], 40: [60, 0, 1, 2, 3], 60: [0, 1, 2, 3, 4]}
    assert neighbours.nearest(table.limit(0), F.col("id") % 20 == 0).count() == 0


def test_shared_queue_reads_the_nearest_leaves_first():
    sample = np.random.default_rng(0).normal(size=(2000, 8))
    forest = neighbours.Forest(sample, 2000, trees=3, leaf=125)
    query = np.random.default_rng(1).normal(size=8)
    found = forest.nearest_leaves(query, forest.trees << forest.levels)

    def worst(tree, leaf):
        margins, node = [], 0
        for level in range(forest.levels):
            side = leaf >> (forest.levels - 1 - level) & 1
            margin = forest.directions[tree, level] @ query - forest.thresholds[tree][level][node]
            margins.append(-margin if side else margin)
            node = node * 2 + side
        return max(margins)

    order = [worst(*f) for f in found]
    assert len(set(found)) == forest.trees << forest.levels
    assert np.allclose(order, sorted(order))


def test_queries_in_small_leaves_get_all_their_rows(spark, monkeypatch):
    rng = np.random.default_rng(3)
    vectors = rng.normal(size=(600, 6))
    table = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)], "vec_id long, embedding array<double>")
    monkeypatch.setattr(neighbours, "leaves_needed", lambda *args: 1)
    monkeypatch.setattr(neighbours, "SAMPLE", 40)
    found = neighbours.nearest(table, F.col("id") % 20 == 0, trees=2, leaf=4).toPandas()
    assert found.groupby("query_id").size().eq(20).all() and found["query_id"].nunique() == 30
    assert not found.duplicated(["query_id", "vec_id"]).any()
    few = neighbours.nearest(table.filter("vec_id < 8"), F.col("id") % 20 == 0, trees=2, leaf=2).toPandas()
    assert sorted(few["vec_id"]) == list(range(1, 8))

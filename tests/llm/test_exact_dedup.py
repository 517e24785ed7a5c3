from __future__ import annotations

import hashlib
import random
from collections import defaultdict

import pytest


from rowsmith.llm.exact_dedup import OpenTable, exact_duplicates, same_carriers, without_exact_duplicates


def plain(rows):
    groups = defaultdict(list)
    for doc_id, text in rows:
        groups[text or ""].append(doc_id)
    return {
        (i, max(ids), len(ids), i == max(ids), hashlib.sha256(text.encode()).hexdigest())
        for text, ids in groups.items() for i in ids
    }


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(2)
    made = [f"text {rng.randrange(120)} " * rng.randrange(1, 4) for _ in range(500)]
    made += ["hot"] * 400 + [None, "", " ", "A", "a", "été", "ete", "x" * 50_000, "x" * 50_000]
    rng.shuffle(made)
    return made


@pytest.mark.parametrize("limits", [{}, {"budget": 4000, "buckets": 3, "task_budget": 2000, "crowd": 20}])
def test_equals_plain_groups_at_any_limit(spark, docs_of, texts, limits):
    found = exact_duplicates(docs_of(texts).repartition(7), **limits).collect()
    assert {tuple(r) for r in found} == plain(enumerate(texts))
    assert len(found) == len(texts)


def test_colliding_hashes_are_told_apart(spark):
    rows = [(i, 7, 10, f"t{i % 3}") for i in range(60)]
    named = same_carriers(spark.createDataFrame(rows, "carrier long, mark long, size long, text string"), budget=1000, crowd=4, buckets=2)
    same = {r.carrier: r.same for r in named.collect()}
    assert len(same) == 60
    assert {frozenset(c for c in same if same[c] == s) for s in set(same.values())} == {
        frozenset(range(k, 60, 3)) for k in range(3)
    }


def test_table_probes_past_other_texts_and_grows():
    table = OpenTable(1 << 30)
    for i in range(3000):
        assert table.find(5, b"%d" % i, i) == i
        if i % 100 == 0:
            assert table.find(5, b"0", -1) == 0
    assert table.find(5, b"2999", -1) == 2999
    full = OpenTable(10)
    assert full.find(1, b"x" * 99, 4) == 4 and full.find(1, b"x" * 99, 5) == 4 and full.find(2, b"y", 6) is None


def test_hard_rows(hard_docs, no_docs):
    found = sorted(tuple(r)[:4] for r in exact_duplicates(hard_docs).collect() if r.doc_id is not None)
    assert found == [
        (1, 2, 2, False), (2, 2, 2, True), (3, 4, 2, False), (4, 4, 2, True), (5, 5, 1, True), (6, 6, 1, True),
        (7, 7, 2, False), (7, 7, 2, True), (9, 9, 1, True),
    ]
    kept = without_exact_duplicates(hard_docs)
    assert kept.columns == hard_docs.columns
    assert sorted(r.doc_id or 0 for r in kept.collect()) == [0, 2, 4, 5, 6, 7, 9]
    assert exact_duplicates(no_docs).count() == 0
    assert without_exact_duplicates(no_docs).count() == 0



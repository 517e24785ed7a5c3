from __future__ import annotations

import random
from collections import Counter

from rowsmith.llm import mixing


def plain_targets(sizes, weights=(5, 2, 1), cap=3):
    names = sorted((s for s in sizes if s is not None)) + [None] * (None in sizes)
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    left, target, open_ = sum(sizes.values()), {}, set(names)
    while True:
        share = {s: left * weight[s] / sum(weight[o] for o in open_) for s in open_}
        over = {s for s in open_ if share[s] > cap * sizes[s]}
        if not over:
            return target | share
        for s in over:
            target[s] = cap * sizes[s]
            left -= cap * sizes[s]
            open_.remove(s)


def mixed_rows(spark):
    random.seed(2)
    rows = [(i, "w " * random.randrange(1, 60), random.choice(["a"] * 30 + ["b"] * 3 + ["c", "d", None])) for i in range(900)]
    return rows, spark.createDataFrame(rows, "doc_id long, text string, source string")


def test_targets_and_taken(spark):
    rows, docs = mixed_rows(spark)
    sizes = Counter()
    for _, text, source in rows:
        sizes[source] += len(text.split())
    expected = plain_targets(sizes)
    found = mixing.mix_sources(docs).collect()
    assert len(found) == len(rows)
    taken = Counter()
    for r in found:
        assert r.source_size == sizes[r.source]
        assert abs(r.target - expected[r.source]) < 1e-6 * max(1, r.target)
        assert r.taken % r.size == 0 and r.taken <= 3 * r.size
        taken[r.source] += r.taken
    assert sum(taken.values()) <= sum(sizes.values())
    for source, target in expected.items():
        assert abs(taken[source] - target) <= 120


def test_reruns_agree(spark):
    _, docs = mixed_rows(spark)
    assert sorted(mixing.mix_sources(docs).collect()) == sorted(mixing.mix_sources(docs.repartition(7)).collect())


def test_documents_come_as_often_as_taken(spark):
    _, docs = mixed_rows(spark)
    taken = {r.doc_id: r.taken // r.size for r in mixing.mix_sources(docs).collect()}
    copies = Counter(r.doc_id for r in mixing.mixed_documents(docs).collect())
    assert copies == Counter({k: v for k, v in taken.items() if v})


def test_hard_rows(hard_docs):
    found = mixing.mix_sources(hard_docs).collect()
    assert len(found) == 10
    assert all(r.taken == 0 for r in found if r.doc_id in (3, 4, 5))
    mixed = mixing.mixed_documents(hard_docs)
    assert mixed.columns == hard_docs.columns
    # The repeated row is two rows for the mix, and as many words come out as were taken.
    assert sum(len((r.text or "").split()) for r in mixed.collect()) == sum(r.taken for r in found)


def test_no_rows_and_no_words(no_docs, docs_of):
    assert mixing.mix_sources(no_docs).count() == 0
    assert mixing.mixed_documents(no_docs).count() == 0
    assert [r.taken for r in mixing.mix_sources(docs_of(["", None])).collect()] == [0, 0]

from __future__ import annotations

import random

import numpy as np
import pytest

from rowsmith.llm import decontamination as dc

COMMON = ["the", "of", "and", "to", "is", "that", "it", "was"]


def plain_lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        before = row[:]
        for j, y in enumerate(b, start=1):
            row[j] = before[j - 1] + 1 if x == y else max(before[j], row[j - 1])
    return row[-1]


def writer(seed):
    rng = random.Random(seed)
    word = lambda: rng.choice(COMMON) if rng.random() < 0.3 else "".join(rng.choices(["ka", "lo", "mi", "ter", "sun", "ver", "os"], k=3))
    return rng, lambda n: [word() for _ in range(n)]


def test_bit_parallel_subsequence_equals_the_plain_form():
    rng = np.random.default_rng(0)
    for _ in range(200):
        a, b = rng.integers(0, 8, rng.integers(1, 70)), rng.integers(0, 8, rng.integers(0, 90))
        item = dc.Item(0, a)
        assert dc.common_subsequence(item.masks, len(a), b.tolist()) == plain_lcs(a.tolist(), b.tolist())


def test_nystroem_finds_the_leading_space():
    rng = np.random.default_rng(1)
    basis = np.linalg.qr(rng.normal(size=(200, 200)))[0]
    values = np.concatenate([np.linspace(10, 5, 8), np.full(192, 1e-3)])
    gram = (basis * values) @ basis.T
    random_matrix = np.linalg.qr(rng.normal(size=(200, 16)))[0]
    vectors, found = dc.nystroem(gram @ random_matrix, random_matrix)
    assert np.allclose(found[:8], values[:8], rtol=1e-2)
    assert np.linalg.norm(basis[:, :8].T @ vectors[:, :8]) == pytest.approx(np.sqrt(8), rel=1e-3)


@pytest.fixture()
def corpus(spark):
    rng, write = writer(2)
    items = [write(rng.randrange(15, 57)) for _ in range(40)]
    texts, truth = [], set()
    for doc in range(300):
        words = write(rng.randrange(1, 700))
        if doc % 6 == 0:
            n = rng.randrange(40)
            leak = list(items[n])
            if doc % 12 == 0:  # a paraphrase: a fifth of the words before the answer is changed
                for at in rng.sample(range(len(leak) - 6), len(leak) // 5):
                    leak[at] = "other"
            at = rng.randrange(len(words) + 1)
            words[at:at] = leak
            truth.add((doc, n))
        texts.append(" ".join(words).capitalize() + ".")
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    benchmark = spark.createDataFrame([(n, " ".join(i).capitalize()) for n, i in enumerate(items)], "item_id long, text string")
    return docs, benchmark, truth


def test_leaks_and_paraphrases_are_found_and_clean_rows_left(corpus):
    docs, benchmark, truth = corpus
    found = {(r.doc_id, r.item_id) for r in dc.leaks(docs, benchmark).collect()}
    verbatim = {(d, i) for d, i in truth if d % 12}
    assert verbatim <= found <= truth
    assert len(found - verbatim) >= 0.9 * len(truth - verbatim)
    kept = {r.doc_id for r in dc.without_leaks(docs, benchmark).collect()}
    assert kept == set(range(300)) - {d for d, _ in found}


def test_items_in_blocks_find_the_same(corpus, monkeypatch):
    docs, benchmark, _ = corpus
    whole = {(r.doc_id, r.item_id) for r in dc.leaks(docs, benchmark).collect()}
    monkeypatch.setattr(dc.retrievers, "__defaults__", ("item_id", "text", 9))
    assert {(r.doc_id, r.item_id) for r in dc.leaks(docs, benchmark).collect()} == whole


def test_hard_rows(hard_docs, no_docs, spark):
    items = [(1, "The CAT sat on the mat, with a hat and a bat today"), (2, None), (3, ""), (None, "a row without an id stays a row"), (1, "x")]
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    found = {(r.doc_id, r.item_id) for r in dc.leaks(hard_docs, benchmark).collect()}
    assert {(1, 1), (2, 1), (None, None)} <= found
    kept = dc.without_leaks(hard_docs, benchmark)
    assert kept.columns == hard_docs.columns
    assert {3, 4, 5, 6, 7, 9} >= {r.doc_id for r in kept.collect()}
    assert dc.leaks(hard_docs, benchmark.limit(0)).count() == 0
    assert dc.without_leaks(hard_docs, benchmark.limit(0)).count() == 10
    assert dc.leaks(no_docs, benchmark).count() == 0


def test_documents_searched_together_find_what_each_finds_alone(corpus):
    docs, benchmark, _ = corpus
    retriever = next(dc.retrievers(dc.encoded_documents(docs, "doc_id", "text"), benchmark))
    words = [dc.word_hashes(r.text) for r in docs.orderBy("doc_id").collect()]
    alone = {(n, f[1]) for n, w in enumerate(words) for f in retriever.search([w])}
    assert {f[:2] for f in retriever.search(words)} == alone


@pytest.mark.parametrize("junk", ["{w} " * 60, "one two three four {w} " * 12, "{w} {w} {w} x " * 20])
def test_verbatim_items_between_repeats_are_found(corpus, spark, junk):
    docs, benchmark, _ = corpus
    items = {r.item_id: r.text for r in benchmark.collect()}
    around = {i: junk.format(w=text.split()[i % 5]) for i, text in items.items()}
    made = [(1000 + i, f"{around[i]}{text} {around[i]}", i) for i, text in items.items()]
    more = docs.unionAll(spark.createDataFrame([m[:2] for m in made], "doc_id long, text string"))
    found = {(r.doc_id, r.item_id) for r in dc.leaks(more, benchmark).collect() if r.doc_id >= 1000}
    assert {(d, i) for d, _, i in made} <= found
    kept = {r.doc_id for r in dc.without_leaks(more, benchmark).collect()}
    assert not kept & {d for d, _, _ in made}


def test_against_all_pairs_of_items_and_windows(corpus):
    docs, benchmark, _ = corpus
    retriever = next(dc.retrievers(dc.encoded_documents(docs, "doc_id", "text"), benchmark))
    words = {r.doc_id: dc.word_hashes(r.text) for r in docs.collect()}
    every, verbatim = set(), set()
    for doc, text in words.items():
        for n in range(len(retriever.items)):
            size = retriever.span_of[n][0] * dc.STEP
            shares = [f[0] for f in (retriever._verify(text, at, size, n) for at in range(0, len(text), dc.STEP)) if f]
            if shares:
                every.add((doc, retriever.items[n].item_id))
            if shares and max(shares) >= dc.VERBATIM:
                verbatim.add((doc, retriever.items[n].item_id))
    found = {(r.doc_id, r.item_id) for r in dc.leaks(docs, benchmark).collect()}
    assert verbatim <= found <= every
    assert len(found) >= 0.95 * len(every)


def test_items_without_rare_words_can_be_paraphrased(spark):
    rng, write = writer(5)
    item = [rng.choice(COMMON) for _ in range(40)]
    texts = [" ".join(rng.choice(COMMON) for _ in range(200)) for _ in range(30)]
    leak = list(item)
    for at in range(0, 30, 3):
        leak[at] = "other"
    texts.append(" ".join([*write(100), *leak, *write(100)]))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    benchmark = spark.createDataFrame([(0, " ".join(item))], "item_id long, text string")
    retriever = next(dc.retrievers(dc.encoded_documents(docs, "doc_id", "text"), benchmark))
    assert not retriever.items[0].rare
    assert 30 in {r.doc_id for r in dc.leaks(docs, benchmark).collect()}

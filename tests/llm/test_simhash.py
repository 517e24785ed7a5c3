from __future__ import annotations

import random
import re

import numpy as np
import xxhash

from rowsmith.llm import golay, simhash
from rowsmith.llm.components import components


def plain_fingerprint(text):
    text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(marks):
    root = {i: i for i in marks}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in sorted(marks):
        for j in sorted(marks):
            if i < j and bin(marks[i] ^ marks[j]).count("1") <= 2:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return {i: find(i) for i in marks}


def signed(value):
    return value - (1 << 64) if value >> 63 else value


def test_golay_is_perfect():
    index = golay.codeword_index(np.arange(1 << 23))
    assert (np.bincount(index, minlength=4096) == 2048).all()


def test_words_two_bits_apart_share_an_index():
    words = np.random.default_rng(0).integers(0, 1 << 21, 3000)
    near = words ^ (1 << np.random.default_rng(1).integers(0, 21, 3000)) ^ (1 << np.random.default_rng(2).integers(0, 21, 3000))
    a, b = golay.nearby_indices(words, 21), golay.nearby_indices(near, 21)
    assert (a >= 0).sum(axis=1).max() <= 6
    assert all(set(x[x >= 0]) & set(y[y >= 0]) for x, y in zip(a, b, strict=True))


def test_fingerprint_equals_plain_form():
    for text in (None, "", "a", "A b", "x\x0by z", "É ß x y", "one two three two one two three", "w " * 70_000):
        assert simhash.fingerprint(text) == plain_fingerprint(text)


def test_links_connect_as_all_pairs_do(spark):
    random.seed(5)
    marks = {random.getrandbits(64) for _ in range(40)}
    for base in list(marks)[:4]:
        at = base
        for _ in range(25):
            at ^= 1 << random.randrange(64) ^ 1 << random.randrange(64)
            marks.add(at)
        # A crowd whose members agree in the first two segments.
        marks |= {base ^ 1 << random.randrange(43, 64) ^ 1 << random.randrange(43, 64) ^ 1 << random.randrange(43, 64) for _ in range(60)}
    rows = spark.createDataFrame([(signed(m),) for m in marks], "fp long")
    found = components(simhash.fingerprint_links(rows, bucket=8), "a", "b").collect()
    mine = {r.node: r.component for r in found}
    expected = plain_components({signed(m): m for m in marks})
    groups = lambda of: {frozenset(k for k in expected if of(k) == v) for v in {of(k) for k in expected}}
    assert groups(lambda k: mine.get(k, k)) == groups(expected.get)


def test_hard_rows(hard_docs):
    found = simhash.near_duplicates(hard_docs).collect()
    assert len(found) == 10
    blank = "0" * 16
    assert {r.doc_id for r in found if r.fingerprint == blank} == {3, 4, 5}
    assert {r.component_id for r in found if r.fingerprint == blank} == {3}
    assert {(r.doc_id, r.component_id) for r in found if r.doc_id in (1, 2)} == {(1, 1), (2, 1)}


def test_one_row_of_each_group_stays(hard_docs):
    kept = simhash.without_near_duplicates(hard_docs)
    assert kept.columns == hard_docs.columns
    ids = sorted((r.doc_id is not None, r.doc_id or 0) for r in kept.collect())
    assert ids == [(False, 0), (True, 1), (True, 3), (True, 6), (True, 7), (True, 9)]


def test_no_rows(no_docs):
    assert simhash.near_duplicates(no_docs).count() == 0
    assert simhash.without_near_duplicates(no_docs).count() == 0

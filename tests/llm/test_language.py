from __future__ import annotations

import random
from collections import Counter

import numpy as np

from rowsmith.llm import language

SYLLABLES = {"en": ["th", "er", "on", "ing", "and"], "de": ["sch", "ung", "ein", "ü", "keit"], "fr": ["eau", "é", "ou", "ai", "que"]}


def sentences(lang, n, rng):
    return [" ".join("".join(rng.choices(SYLLABLES[lang], k=3)) for _ in range(rng.randrange(3, 25))) for _ in range(n)]


def test_grams_equal_plain_hashing():
    text = "Été, 12 ab!c"
    codes = [32, *map(ord, "été ab c"), 32]
    mask = (1 << 64) - 1
    expected = []
    for order in (1, 2, 3):
        for at in range(len(codes) - order + 1):
            value = 0
            for k in range(order):
                value = (value * 0x100000001B3 + codes[at + k] + (k + 1)) & mask
            expected.append((value * 0x9E3779B97F4A7C15 & mask) >> 48)
    assert Counter(language.grams(text).tolist()) == Counter(expected)
    assert language.grams(None) is None and language.grams("12 !") is None


def test_penalties_make_weights_sparse_and_temperature_calibrates():
    rng = np.random.default_rng(0)
    model = language.Ftrl(50, 2)
    for _ in range(400):
        label = int(rng.integers(2))
        at = np.array([label, *rng.integers(2, 50, 4)])
        model.learn(at, np.full(5, 0.4), label)
    weights = model.weights(np.arange(50))
    assert np.abs(weights[:2]).max() > 5 * np.abs(weights[2:]).max()
    logits = rng.normal(size=(4000, 3))
    labels = np.array([rng.choice(3, p=language._softmax(row)) for row in logits])
    assert 2.5 < language.best_temperature(logits * 3, labels) < 3.6


def test_held_out_languages_are_found(spark):
    rng = random.Random(1)
    rows = [(i, t, lang) for lang in SYLLABLES for i, t in enumerate(sentences(lang, 120, rng), start=1000 * len(lang) + ord(lang[0]) * 7)]
    rows = [(n, t, lang) for n, (_, t, lang) in enumerate(rows)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    found = {r.doc_id: r for r in language.predict_languages(docs).collect()}
    held = [(found[i].lang_pred, lang) for i, _, lang in rows if found[i].held_out]
    assert len(found) == len(rows) and held
    assert sum(a == b for a, b in held) >= 0.97 * len(held)
    assert all(0 <= r.score <= 1 for r in found.values())


def test_hard_rows(hard_docs, no_docs, docs_of):
    found = language.predict_languages(hard_docs).collect()
    assert len(found) == 10
    assert {r.lang_pred for r in found if r.doc_id in (3, 4, 5, 9)} == {"und"}
    assert {r.lang_pred for r in found if r.doc_id in (1, 6)} <= {"en", "fr"}
    assert language.predict_languages(no_docs).count() == 0
    unlabelled = language.predict_languages(docs_of(["some text", "more text"], lang=None)).collect()
    assert [(r.lang_pred, r.score) for r in unlabelled] == [("und", 0.0)] * 2

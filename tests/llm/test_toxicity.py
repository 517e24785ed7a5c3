from __future__ import annotations

import itertools
import random

import numpy as np
import pytest

from rowsmith.llm import toxicity as tx
from rowsmith.llm.common import held_out

CLEAN = ["table", "garden", "music", "river", "window", "paper", "yellow", "market", "winter", "letter", "bread", "stone"]
BAD = ["idiot", "stupid", "moron"]


def model_of(words):
    text = "  ".join(words * 50)
    alphabet = "".join(sorted(set(text) - {" "}))
    places, size = tx.letter_places(alphabet), len(alphabet) + 2
    at = places[tx._codes(text)]
    counts = np.bincount((at[:-2] * size + at[1:-1]) * size + at[2:], minlength=size**3)
    return tx.CharacterModel.from_counts(alphabet, counts)


def plain_decode(token, model, spaced):
    best = None
    for reading in itertools.product(*tx.lattice(token, spaced)):
        letters, cost = "".join(r[0] for r in reading), sum(r[1] for r in reading)
        a = b = 0
        for letter in [*letters, " "]:
            c = model.place(letter) if letter != " " or letters else 0
            cost += model.cost[a, b, c]
            a, b = b, c
        if best is None or cost < best[0]:
            best = (cost, letters)
    return best


@pytest.mark.parametrize(("token", "spaced"), [("1d10t", False), ("st*p1d", False), ("moooron", False), ("i d i o t", True), ("m.o.r.o.n", True)])
def test_viterbi_finds_the_cheapest_reading(token, spaced):
    model = model_of(CLEAN + BAD)
    assert tx.decode(token, model, spaced) == plain_decode(token, model, spaced)[1]


def test_disguises_are_undone_and_plain_text_is_kept():
    model = model_of(CLEAN + BAD)
    assert tx.restore("you 1d10t, i d i o t st00pid moooron!", model, {}).split()[1:3] == ["idiot", "idiot"]
    for text in ("table river, window.\nmusic", "paper$$$ stone%%%", "letter"):
        assert tx.restore(text, model, {}) == text
    assert tx.restore(None, model, {}) == tx.restore("", model, {}) == ""


@pytest.mark.parametrize(("token", "word"), [
    ("i d 1 0 t", "idiot"), ("1 d 1 0 t", "idiot"), ("m 0 r 0 n", "moron"), ("m.0.r.0.n", "moron"), ("$ t u p 1 d", "stupid"),
    ("a $ $", "ass"), ("a s s", "ass"), ("a $ $ h o l e", "asshole"), ("m * r o n", "moron"),
])
def test_spaced_leetspeak_alone_in_a_text_is_undone(token, word):
    model = model_of([*CLEAN, *BAD, "ass", "asshole"])
    assert tx.restore(token, model, {}) == word
    assert tx.restore(f"river {token} garden", model, {}) == f"river {word} garden"


def test_spaced_numbers_without_a_letter_stay():
    model = model_of(CLEAN + BAD)
    for text in ("1 2 3 4", "1 + 1 - 2", "* * * *", "1 2 " * 30_000):
        assert tx.restore(text, model, {}) == text


@pytest.fixture()
def corpus(spark):
    rng = random.Random(3)
    rows = []
    for i in range(600):
        words = rng.choices(CLEAN, k=rng.randrange(8, 40))
        toxic = int(i % 5 == 0)
        if toxic:
            words[rng.randrange(len(words))] = rng.choice(BAD)
        rows.append((i, " ".join(words), toxic))
    disguised = ["1d10t", "i d i o t", "stuuuupid", "m0r0n"]
    rows += [(10_000 + i, "garden river " + d + " paper music", 1) for i, d in enumerate(disguised)]
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows if i < 10_000], "doc_id long, toxic int")
    return rows, docs, labels


def test_held_out_and_disguised_texts(corpus):
    rows, docs, labels = corpus
    found = {r.doc_id: r for r in tx.toxicity_scores(docs, labels).collect()}
    held = [(found[i].predicted, y) for i, _, y in rows if found[i].held_out or i >= 10_000]
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in found.values())
    assert sum(p == y for p, y in held) >= 0.97 * len(held)
    assert all(found[i].predicted == 1 for i, _, _ in rows if i >= 10_000)


def test_labels_of_held_out_rows_teach_nothing(corpus, spark):
    from pyspark.sql import functions as F

    _, docs, labels = corpus
    turned = labels.withColumn("toxic", F.when(held_out(F.col("doc_id")), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    a, b = (sorted(tx.toxicity_scores(docs, of).collect()) for of in (labels, turned))
    assert np.allclose([r.score for r in a], [r.score for r in b], rtol=0, atol=1e-12)


def test_stage_removes_what_is_predicted(corpus):
    _, docs, labels = corpus
    wide = docs.selectExpr("doc_id", "text", "'x' AS id", "1.5 AS score", "0 AS toxic")
    kept = tx.without_toxic(wide, labels)
    assert kept.columns == wide.columns
    expected = {r.doc_id for r in tx.toxicity_scores(docs, labels).collect() if not r.predicted}
    assert {r.doc_id for r in kept.collect()} == expected


def test_hard_rows(hard_docs, no_docs, spark):
    labels = spark.createDataFrame([(1, 0), (1, 1), (6, 0), (None, 1), (7, None), (77, 1)], "doc_id long, toxic int")
    found = tx.toxicity_scores(hard_docs, labels).collect()
    assert len(found) == 10 and all(0 <= r.score <= 1 for r in found)
    assert tx.without_toxic(hard_docs, labels.limit(0)).count() == 10
    assert {r.score for r in tx.toxicity_scores(hard_docs, labels.limit(0)).collect()} == {0.0}
    assert tx.toxicity_scores(no_docs, labels).count() == 0


def test_letters_and_weights_come_from_all_training_rows(corpus, spark, monkeypatch):
    from pyspark.sql import functions as F

    _, docs, labels = corpus
    # A letter that no labelled text has, in a training text without a label.
    free = next(i for i in range(20_000, 20_100) if spark.range(i, i + 1).filter(~held_out(F.col("id"))).count())
    more = docs.union(spark.createDataFrame([(free, "ж" * 5_000)], "doc_id long, text string"))
    one = tx.train(*tx._inputs(more, labels, "doc_id", "text", "toxic"), ~held_out(F.col("id")))
    assert "ж" in one.characters.alphabet
    # Parts of 50 rows: every labelled row is in one of them.
    seen = []
    real = tx.fitted
    monkeypatch.setattr(tx, "fitted", lambda model, rows, *rest: (seen.append([r.n for r in rows.groupBy("part").agg(F.count("*").alias("n")).collect()]), real(model, rows, *rest))[1])
    many = tx.train(*tx._inputs(docs, labels, "doc_id", "text", "toxic"), ~held_out(F.col("id")), 50)
    labelled = labels.filter(~held_out(F.col("doc_id"))).count()
    assert len(seen[0]) == -(-labelled // 50) and sum(seen[0]) == labelled
    memory = {}
    assert many.score("garden river idiot paper", memory) > 0.3 > many.score("garden river paper music", memory)


def test_texts_without_a_label_are_left_out_before_the_shuffle(spark, monkeypatch):
    docs = spark.range(6_000).selectExpr("if(id % 1000 = 7, null, id) AS id", "concat('text ', id) AS text")
    docs = docs.union(docs.filter("id = 12"))
    known = spark.range(0, 6_000, 4).selectExpr("id", "cast(id % 8 = 0 AS int) AS toxic")
    let = [r.id for r in tx.sieved(docs, known, 1_500).collect()]
    assert sorted(i for i in let if i is not None and i % 4 == 0) == sorted([*range(0, 6_000, 4), 12])
    assert len(let) < 1_501 + 450
    # Full of labels, it lets everything through and still loses nothing.
    monkeypatch.setattr(tx, "SIEVE_BITS", tx.BITMAP)
    monkeypatch.setattr(tx, "BITMAP", 64)
    monkeypatch.setattr(tx, "SIEVE_SHARE", 0)
    assert {i for i in range(0, 6_000, 4)} <= {r.id for r in tx.sieved(docs, known, 1_500).collect()}
    assert tx.sieved(docs, known.limit(0), 0).count() == 0


def test_labels_are_joined_the_same_way_at_every_size(corpus, spark, monkeypatch):
    rows, docs, labels = corpus
    given = []
    monkeypatch.setattr(tx, "saved", lambda df, name: given.append(df) or df)
    found, share = tx.labelled_rows(docs.withColumnRenamed("doc_id", "id"), labels.withColumnRenamed("doc_id", "id"), model_of(CLEAN))
    assert sorted((r.id, r.toxic) for r in found.collect()) == [(i, y) for i, _, y in rows if i < 10_000]
    assert np.isclose(share, 0.2)
    assert "ShuffledHashJoin" in given[0]._jdf.queryExecution().executedPlan().toString()

from __future__ import annotations

import threading
import uuid
from concurrent.futures import ThreadPoolExecutor

import pytest

from rowsmith.llm.token_counts import TokenCounts, deleted, inserted, revised
from rowsmith.session import scratch_folder

SCHEMA = "source string, lang string, tokenizer string, tokens long, better long"


@pytest.fixture()
def counts(spark):
    return TokenCounts(spark, scratch_folder(spark, "counts"))


def rows(spark, *values):
    return spark.createDataFrame(list(values), SCHEMA)


def state(counts):
    return {(r.source, r.lang, r.tokenizer): (r.documents, r.tokens) for r in counts.totals().collect()}


def test_deltas_add_up(spark, counts):
    first = rows(spark, ("a", "en", "t1", 5, 7), ("a", "en", "t1", 3, 3), (None, None, "t1", None, 2))
    assert counts.totals().count() == 0
    assert counts.apply("1", inserted(first))
    assert state(counts) == {("a", "en", "t1"): (2, 8), (None, None, "t1"): (1, 0)}
    assert counts.apply("2", revised(first, "tokens", "better"))
    assert state(counts) == {("a", "en", "t1"): (2, 10), (None, None, "t1"): (1, 2)}
    assert counts.apply("3", deleted(first.filter("source = 'a'"), "better"))
    assert state(counts) == {(None, None, "t1"): (1, 2)}


def test_a_batch_counts_once(spark, counts):
    batch = inserted(rows(spark, ("a", "en", "t1", 5, 5)))
    assert [counts.apply("b", batch) for _ in range(3)] == [True, False, False]
    assert state(counts) == {("a", "en", "t1"): (1, 5)}


def test_a_batch_cut_off_is_written_anew(spark, counts):
    batch = inserted(rows(spark, ("a", "en", "t1", 5, 5)))
    counts.apply("b", batch)
    # What a job that died before its commit leaves: files, but no mark of success.
    (cut_off,) = counts._names("deltas", "b")
    counts._files.delete(counts._path("deltas", "b", cut_off, "_SUCCESS"), False)
    assert counts.totals().count() == 0
    assert not counts.is_committed("b")
    assert counts.apply("b", batch)
    assert state(counts) == {("a", "en", "t1"): (1, 5)}
    assert cut_off in counts._names("deltas", "b") and cut_off not in counts._complete("deltas", "b")


def test_two_writers_of_one_batch_count_once(spark, counts, monkeypatch):
    """Both see an uncommitted id and write at the same time; neither destroys what the other wrote."""
    batch = inserted(rows(spark, ("a", "en", "t1", 5, 5), ("a", "de", "t1", 2, 2)))
    both_ready = threading.Barrier(2)
    others = [TokenCounts(spark, counts.folder) for _ in range(2)]
    for one in others:
        monkeypatch.setattr(one, "is_committed", lambda batch_id: both_ready.wait(60) < 0)
    with ThreadPoolExecutor(2) as pool:
        assert list(pool.map(lambda one: one.apply("b", batch), others)) == [True, True]
    assert len(counts._complete("deltas", "b")) == 2
    expected = {("a", "en", "t1"): (1, 5), ("a", "de", "t1"): (1, 2)}
    assert state(counts) == expected
    counts.compact()
    assert state(counts) == expected and not counts.apply("b", batch)


def test_a_writer_that_finishes_late_changes_nothing(spark, counts, monkeypatch):
    """Its folder appears after the batch was compacted, even if its name comes first."""
    batch = inserted(rows(spark, ("a", "en", "t1", 5, 5)))
    counts.apply("b", batch)
    counts.compact()
    late = TokenCounts(spark, counts.folder)
    monkeypatch.setattr(late, "is_committed", lambda batch_id: False)
    monkeypatch.setattr(uuid, "uuid4", lambda: uuid.UUID(int=0))
    late.apply("b", batch)
    assert counts._names("deltas", "b")[0] == "0" * 32
    assert state(counts) == {("a", "en", "t1"): (1, 5)}


def test_two_compactions_at_once(spark, counts, monkeypatch):
    for n in range(2):
        counts.apply(f"b{n}", inserted(rows(spark, ("a", "en", "t1", n, 0))))
    counts.compact()
    # One that began before the first was complete takes the same number.
    other = TokenCounts(spark, counts.folder)
    complete = other._complete
    monkeypatch.setattr(other, "_complete", lambda *parts: [] if parts == ("totals",) else complete(*parts))
    other.compact()
    assert len(counts._complete("totals")) == 2
    counts.apply("b2", inserted(rows(spark, ("a", "en", "t1", 4, 0))))
    assert state(counts) == {("a", "en", "t1"): (3, 5)}


def test_compaction_keeps_totals_and_ids(spark, counts):
    for n in range(3):
        counts.apply(f"b{n}", inserted(rows(spark, ("a", "en", "t1", n, 0))))
    counts.compact()
    assert state(counts) == {("a", "en", "t1"): (3, 3)}
    assert not counts.apply("b1", inserted(rows(spark, ("a", "en", "t1", 9, 0))))
    counts.apply("b3", inserted(rows(spark, ("a", "en", "t1", 4, 0))))
    assert state(counts) == {("a", "en", "t1"): (4, 7)}
    counts.compact()
    assert state(counts) == {("a", "en", "t1"): (4, 7)}


def test_empty_batches_and_bad_ids(spark, counts):
    assert counts.apply("none", inserted(rows(spark).limit(0)))
    assert counts.totals().count() == 0
    with pytest.raises(ValueError):
        counts.apply("../x", inserted(rows(spark)))

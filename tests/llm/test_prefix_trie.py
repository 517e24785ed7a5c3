from __future__ import annotations

import hashlib
import random
import zlib
from collections import defaultdict

import pytest

from rowsmith.llm.prefix_trie import SpillingQueue, prefix_trie

SCHEMA = "conv_id long, turn long, role string, text string, depth string, k1 string, own string"


def plain_trie(rows):
    turns = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            turns[conv].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [(r, t) for _, _, r, t in sorted(some, key=lambda x: x[:2])] for c, some in turns.items()}
    made = {}
    for c, some in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        base = c - (c % 5 if c >= 0 else -(-c % 5))
        made[c] = own.get(base, [])[:h] + some[h:]
    members, children = defaultdict(list), defaultdict(set)
    for c, some in made.items():
        for d in range(len(some) + 1):
            members[tuple(some[:d])].append(c)
            if d:
                children[tuple(some[: d - 1])].add(tuple(some[:d]))
    leaves, saved = {}, {}
    for node in sorted(members, key=len, reverse=True):
        leaves[node] = sum(leaves[k] for k in children[node]) or 1
        text = node[-1][1] if node else ""
        saved[node] = sum(saved[k] for k in children[node]) + (len(members[node]) - 1) * len(text.encode())
    return {
        (min(m), len(n), min(members[n[:-1]]) if n else None, len(m), len(children[n]), leaves[n], saved[n],
         hashlib.sha256(",".join(str(c) for c in sorted(m) if len(made[c]) == len(n)).encode()).hexdigest())
        for n, m in members.items()
    }


def trie_of(spark, rows, **limits):
    df = spark.createDataFrame([(*r, "x", "x", "x") for r in rows], SCHEMA).repartition(3)
    found = [tuple(r) for r in prefix_trie(df, **limits).collect()]
    assert len(found) == len(set(found))
    return set(found)


@pytest.fixture(scope="module")
def talks():
    rng = random.Random(8)
    rows = []
    for c in [*range(0, 120), *range(200, 330, 3), -7, -5, -1, 70_000, 70_001, 140_000]:
        for turn in range(rng.choice((1, 2, 3, 9, 14))):
            text = "hello" if rng.random() < 0.7 else rng.choice(("", "é", "bye", None))
            rows.append((c, turn, rng.choice(("user", "user", None)), text))
    rows += [(500, turn, "user", f"t{turn % 7}") for turn in range(300)] + [(501, turn, "user", f"t{turn % 7}") for turn in range(200)]
    return rows


@pytest.mark.parametrize("limits", [{}, {"shard": 20, "held": 2, "chunk": 16}])
def test_equals_plain_trie(spark, talks, limits):
    assert trie_of(spark, talks, **limits) == plain_trie(talks)


def test_hard_rows(spark):
    rows = [(None, 0, "user", "left out"), (5, None, None, None), (5, None, None, None), (5, 3, "user", "x" * 200_000), (9, 0, "a", "b"), (11, 7, "", "")]
    rows += [(12, i, "user", "t") for i in range(12)]
    assert trie_of(spark, rows) == plain_trie(rows)
    assert trie_of(spark, [(1, 0, "u", "only")]) == plain_trie([(1, 0, "u", "only")])
    assert trie_of(spark, []) == set()


def test_equal_turns_have_one_order(spark):
    rows = [(c, 1, "user", t) for c in (10, 11, 12) for t in ("one", "two", "three")]
    first, second = trie_of(spark, rows), trie_of(spark, rows[::-1])
    assert first == second


def test_queue_spills_and_stays_in_order():
    rng = random.Random(1)
    queue, plain = SpillingQueue(5), []
    for step in range(4000):
        if plain and rng.random() < 0.4:
            plain.sort()
            assert queue.first() == plain[0]
            assert queue.pop() == plain.pop(0)
        else:
            item = tuple(rng.randrange(-(1 << 62), 1 << 62) for _ in range(6))
            queue.push(item)
            plain.append(item)
        assert len(queue.heap) <= 5
    assert [queue.pop() for _ in range(len(plain))] == sorted(plain)
    assert queue.first() is None

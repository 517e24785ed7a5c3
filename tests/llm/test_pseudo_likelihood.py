from __future__ import annotations

import random

import numpy as np
import pyarrow as pa

from rowsmith.llm import pseudo_likelihood as pl


BOUNDS = np.array([0, 1, 4, 9, 30])


def random_network(seed=1):
    net = pl.Network.new(BOUNDS)
    net.flat += np.random.default_rng(seed).normal(0, 0.1, len(net.flat)).astype(np.float32)
    return net


def log_softmax(logits, at):
    return logits[at] - np.log(np.exp(logits).sum())


def plain_log_chance(net, ids, at):
    """log P(class | sides), and for words of a bin log P(word | bin, sides)."""
    embedding, w, bias, top, top_shift, out, shift = (p.astype(float) for p in net.parts())
    sides = [ids[at + k] if 0 <= at + k < len(ids) else pl.EDGE for k in (-3, -2, -1, 1, 2, 3)]
    hidden = np.maximum(np.concatenate([embedding[s] for s in sides]) @ w + bias, 0)
    logits = hidden @ top + top_shift
    word = ids[at] - 1 - pl.ENDINGS
    if word < 0:
        return log_softmax(logits, ids[at] - 1)
    k = next(k for k in range(len(net.bounds)) if word < net.bounds[k + 1])
    low, high = net.bounds[k], net.bounds[k + 1]
    return log_softmax(logits, pl.ENDINGS + k) + log_softmax(out[low:high] @ hidden + shift[low:high], word - low)


def plain_log_spelled(speller, word):
    """log P(unlisted word | its ending), byte by byte from the end."""
    signs = b" " + word
    near, far = signs[-2], signs[-1]
    ending = 1 + (near * 256 + far) % pl.ENDINGS
    last = [speller.ends[p] + 0.01 if 1 + p % pl.ENDINGS == ending else 0 for p in range(65536)]
    found = np.log(last[near * 256 + far] / sum(last)) + np.log((speller.unlisted[ending] + 1) / speller.mass[ending])
    counts = speller.pairs.reshape(256, 256)
    for sign in reversed(signs[:-2]):
        slot = ((near * 256 + far) * 40503 % 65536) // 16
        anywhere = (counts[:, sign].sum() + 1) / (counts.sum() + 256)
        one = (counts[near, sign] + pl.BACK_OFF * anywhere) / (counts[near].sum() + pl.BACK_OFF)
        row = speller.slots[slot * 256 : slot * 256 + 256]
        found += np.log((row[sign] + pl.BACK_OFF * one) / (row.sum() + pl.BACK_OFF))
        near, far = sign, near
    return found


def test_scores_equal_the_plain_form(monkeypatch):
    monkeypatch.setattr(pl, "BLOCK", 17)
    net = random_network()
    ids = np.random.default_rng(2).integers(1, 1 + pl.ENDINGS + 30, 60).astype(np.uint16)
    expected = [plain_log_chance(net, ids.tolist(), at) for at in range(len(ids))]
    assert np.allclose(net.log_chances(ids, net.side_tables()), expected, atol=1e-4)


def test_chances_of_all_ids_add_up_to_one():
    net = random_network()
    total = sum(np.exp(plain_log_chance(net, [5, 40, k, 3], 2)) for k in range(1, 1 + pl.ENDINGS + 30))
    assert abs(total - 1) < 1e-9


def test_slopes_are_the_derivative_of_the_loss():
    net = random_network()
    rng = np.random.default_rng(3)
    sides = rng.integers(0, 1 + pl.ENDINGS + 30, (40, 6)).astype(np.uint16)
    targets = rng.integers(1, 1 + pl.ENDINGS + 30, 40).astype(np.uint16)
    grad = net.slopes(sides, targets)

    def loss(flat):
        plain, total = pl.Network(flat, BOUNDS), 0.0
        for around, target in zip(sides.tolist(), targets.tolist(), strict=True):
            total -= plain_log_chance(plain, [*around[:3], target, *around[3:]], 3)
        return total / len(targets)

    flat = net.flat.astype(float)
    for at in np.argsort(-np.abs(grad))[:: len(grad) // 60]:
        step = np.zeros(len(flat))
        step[at] = 1e-5
        assert abs((loss(flat + step) - loss(flat - step)) / 2e-5 - grad[at]) < 1e-4


def test_rounds_predict_every_position_once():
    lengths = [0, 1, 2, 3, 50]
    starts = np.cumsum([3, *[n + 3 for n in lengths]])[:-1]
    found = np.concatenate([pl.targets_of(starts, lengths, turn) for turn in range(pl.ROUNDS)])
    assert sorted(found) == [s + i for s, n in zip(starts, lengths, strict=True) for i in range(n)]


def test_bins_have_equal_mass_and_all_words():
    assert pl.bins_of([]).tolist() == [0]
    assert pl.bins_of([5]).tolist() == [0, 1]
    counts = [1000 // (i + 1) for i in range(500)]
    bounds = pl.bins_of(counts, 8)
    mass = [sum(counts[a:b]) for a, b in zip(bounds, bounds[1:], strict=False)]
    assert bounds[-1] == 500 and sum(mass) == sum(counts) and max(mass[1:]) < 1.3 * sum(counts) / 8


def test_words_without_an_id_are_spelled(spark, monkeypatch):
    """Listed ones by their share of the ending's mass, others byte by byte; all of one ending add up to one."""
    monkeypatch.setattr(pl, "HELD_WORDS", 4)
    rng = random.Random(5)
    rare = ["".join(rng.choice("abcde\u00e9") for _ in range(rng.randint(1, 9))) for _ in range(60)]
    words = ["top"] * 50 + ["mid"] * 20 + ["low"] * 9 + rare
    docs = spark.createDataFrame([(" ".join(words[k::4]),) for k in range(4)], "text string").repartition(2)
    counts = pl.word_counts(docs)
    listed = pl.frequent_words(counts, 3)
    assert listed == [(b"top", 50), (b"mid", 20), (b"low", 9)]
    speller = pl.spell_counts(counts, listed, 1)
    known = pl.Vocabulary(listed, speller, 1)
    ids, spelled = known.numbered(["top", "mid", *rare, "never-seen", None])
    assert np.frombuffer(ids[0], np.uint16).tolist() == [1 + pl.ENDINGS] and spelled[0] == 0
    ending = 1 + (ord("i") * 256 + ord("d")) % pl.ENDINGS
    assert np.frombuffer(ids[1], np.uint16).tolist() == [ending]
    assert np.isclose(spelled[1], np.log(20 / speller.mass[ending]))
    for word, found in zip([*rare, "never-seen"], spelled[2:], strict=False):
        assert np.isclose(found, plain_log_spelled(speller, word.encode()), atol=1e-6), word
    assert (ids[-1], spelled[-1]) == (b"", 0.0)
    again, other = known.numbered([" ".join(rare), "mid top"])
    assert np.isclose(other[0], sum(spelled[2:-2])) and len(again[0]) == 2 * len(rare)


def test_spelling_is_a_distribution():
    rng = np.random.default_rng(6)
    parts = [rng.integers(0, 4, size).astype(float) for size in pl.PART_SIZES]
    speller = pl.Speller(*parts, rng.random(pl.ENDINGS + 1))
    assert np.allclose(speller.after_one.reshape(256, 256).sum(axis=1), 1)
    of_pair = pl.ending_of(np.arange(65536))
    assert np.allclose(np.bincount(of_pair, weights=speller.last_pair)[1:], 1)
    assert np.allclose(speller.listed_mass + speller.unlisted + 1, speller.mass)


def test_whole_scores_equal_the_plain_form(spark, monkeypatch):
    """Numbering, training and scoring as one, against a plain score of each word from the same weights."""
    rng = random.Random(8)
    texts = [" ".join(rng.choice("the a of cat dog runs sits far near by".split()) for _ in range(rng.randint(0, 30))) for _ in range(40)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    trained = []
    train = pl.train
    monkeypatch.setattr(pl, "train", lambda *given: trained.append(train(*given)) or trained[0])
    found = {r.doc_id: r for r in pl.pseudo_likelihood(docs, known=6).collect()}
    counts = pl.word_counts(docs.select("text"))
    listed = pl.frequent_words(counts)
    known = pl.Vocabulary(listed, pl.spell_counts(counts, listed, 6), 6)
    for i, text in enumerate(texts):
        raw, spelled = known.numbered([text])
        ids = np.frombuffer(raw[0], np.uint16).tolist()
        plain = spelled[0] + sum(plain_log_chance(trained[0], ids, at) for at in range(len(ids)))
        assert found[i].n_tokens == len(text.split()) and np.isclose(found[i].log_prob, plain, atol=1e-3)


def test_natural_order_scores_above_shuffled(spark):
    rng = random.Random(7)
    chain = {w: [f"w{(i * 3 + k) % 40}" for k in range(2)] for i, w in enumerate(f"w{i}" for i in range(40))}

    def text():
        words = ["w0"]
        while len(words) < 150:
            words.append(rng.choice(chain[words[-1]]))
        return words

    texts = [text() for _ in range(300)]
    rows = [(i, " ".join(t)) for i, t in enumerate(texts)]
    rows += [(1000 + i, " ".join(rng.sample(t, len(t)))) for i, t in enumerate(texts[:20])]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    found = {r.doc_id: r for r in pl.pseudo_likelihood(docs).collect()}
    assert all(found[i].n_tokens == 150 for i in range(300))
    assert sum(found[i].mean_log_prob > found[1000 + i].mean_log_prob for i in range(20)) >= 19


def test_word_counts_of_all_tasks_are_added(spark, monkeypatch):
    monkeypatch.setattr(pl, "HELD_WORDS", 3)
    docs = spark.createDataFrame([("b A a x",), ("a b c d e f",), (None,), ("",)] * 3, "text string").repartition(3)
    assert pl.frequent_words(pl.word_counts(docs), 3) == [(b"a", 9), (b"b", 6), (b"c", 3)]


def test_hard_rows(hard_docs, no_docs):
    found = pl.pseudo_likelihood(hard_docs).collect()
    assert len(found) == 10
    assert all((r.n_tokens, r.log_prob, r.mean_log_prob) == (0, 0.0, 0.0) for r in found if r.doc_id in (3, 4, 5))
    assert all(r.log_prob < 0 for r in found if r.doc_id in (1, 2, 6, 7))
    assert pl.pseudo_likelihood(no_docs).count() == 0


def test_words_are_cut_at_ascii_white_space_only():
    signs = ["a", "B", "Z", "\u00c9", "\u00df", " ", "\t", "\n", "\x0b", "\x0c", "\r", "\x1c", "\x85", "\u00a0", "\u2028", "\x00", "\U0001f600"]
    rng = random.Random(9)
    texts = [None, "", " ", " a ", "\n\n", *("".join(rng.choices(signs, k=rng.randint(0, 30))) for _ in range(500))]
    plain = [(t or "").encode().lower().split() for t in texts]
    for a, b in ((0, 505), (7, 300), (2, 3), (5, 5)):
        words, lengths = pl.words_of(pa.array(texts, pa.string())[a:b])
        assert words.to_pylist() == [w for of in plain[a:b] for w in of]
        assert lengths.tolist() == [len(of) for of in plain[a:b]]


def test_a_word_is_looked_up_and_spelled_once_a_batch(spark):
    docs = spark.createDataFrame([("top mid low top top rare odd odd",)], "text string")
    counts = pl.word_counts(docs)
    listed = pl.frequent_words(counts, 1)
    known, spelled = pl.Vocabulary(listed, pl.spell_counts(counts, listed, 1), 1), []
    real = known.speller.log_spelled
    known.speller.log_spelled = lambda words: spelled.extend(words.to_pylist()) or real(words)
    ids, chances = known.numbered(["odd rare odd new"] * 50 + ["new odd", ""])
    assert sorted(spelled) == [b"new", b"odd", b"rare"]
    assert len(ids[0]) == 8 and ids[0][:2] == ids[0][4:6] and ids[-1] == b"" and len(set(chances[:50])) == 1


def test_gradients_of_large_and_small_batches_in_turn():
    """Memory is used again; slabs of a batch add up to what one product over all of it gives."""
    net, rng = random_network(), np.random.default_rng(4)
    batches = []
    for size in (5000, 40, pl.SLAB, 5000, 1):
        sides = rng.integers(0, 1 + pl.ENDINGS + 30, (size, 6)).astype(np.uint16)
        batches.append((sides, rng.integers(1, 1 + pl.ENDINGS + 30, size).astype(np.uint16)))
    found = [net.slopes(*batch) for batch in batches]
    rooms = {name: id(room) for name, room in net.rooms.items()}
    for batch, grad in zip(batches, found, strict=True):
        assert np.array_equal(pl.Network(net.flat, BOUNDS).slopes(*batch), grad)
    net.slopes(*batches[0])
    assert rooms == {name: id(room) for name, room in net.rooms.items()}
    sides, targets = batches[0]
    parts = [net.slopes(sides[a : a + 1000], targets[a : a + 1000]) for a in range(0, 5000, 1000)]
    assert np.allclose(found[0], np.mean(parts, axis=0), atol=1e-6)

"""Masked pseudo-likelihood: every token is predicted from the tokens on both sides of it.

*Tokens* are lower-case words. Counts come from all documents. The ``WORDS`` most frequent words have network ids of their own
(two bytes); all others share ``ENDINGS`` ids by their last two bytes.
*Network.* The embeddings of ``SIDE`` tokens to the left and to the right go through one hidden layer to a softmax over classes
(each ending, and ``BINS`` bins of words of about equal mass), then to a softmax over the words of the bin.
*Words that share an ending* get log P(word | ending): the ``LISTED`` most frequent words by their share of all counts, others
by the share of unlisted ones times a character model. That spells backwards, two bytes of context, backing off to one and none,
from the counts of all unlisted words, so each token has a probability of its own.
*Training* in numpy: in each round every task runs mini-batches over every ``ROUNDS``-th position of its documents, the next
ones each round, so that all rounds together take every position once. Tasks start from the same weights; the results are
averaged by the positions seen. What is gathered grows with the corpus: nothing is capped.
*Score* of a document: the sum over all its tokens of log P(token | both sides), and its mean.

The numbered texts (two bytes a token) are written once and read by all rounds and the scoring.

Defined cases: NULL, empty and blank texts have no tokens, sum 0 and mean 0. A text of one token is predicted from edges only.
Equal ids and repeated rows stay rows of their own. Words of more than ``LONGEST`` bytes are never listed, only spelled.
An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rowsmith.llm.common import saved, small_batches

EDGE, ENDINGS, WORDS, BINS = 0, 31, 4096, 64
LISTED, LONGEST = 32_768, 64
SIDE, WIDTH, HIDDEN = 3, 16, 32
ROUNDS, SMALLEST_BATCH, BATCH, RATE = 3, 256, 16_384, 0.1
#: Positions scored as one, and rows of a matrix that are worked on while they lie in the processor's cache.
BLOCK, SLAB = 65_536, 2048
HIGHEST = 80
#: Different words that a task holds before it hands them on, and words spelled at once.
HELD_WORDS, SPELLED = 1_000_000, 100_000
#: Ends a word (it is in none), slots of two-byte contexts, and the weight of the shorter context.
END, SLOTS, BACK_OFF = 0x20, 4096, 4.0


def words_of(texts: pa.Array | list[str | None]) -> tuple[pa.Array, np.ndarray]:
    """The lower-case words of all texts in one row, between ASCII white space, and how many each text has."""
    texts = texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string())
    lists = pc.ascii_split_whitespace(pc.ascii_lower(texts.fill_null("")))
    words, bounds = lists.flatten(), lists.offsets.to_numpy() - lists.offsets[0].as_py()
    # White space at either end leaves empty words.
    real = pc.greater(pc.binary_length(words), 0)
    before = np.concatenate([[0], np.cumsum(real.to_numpy(zero_copy_only=False))])
    return words.filter(real).cast(pa.binary()), np.diff(before[bounds])


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: list[pa.Table] = []

    def merged() -> pa.Table:
        if len(held) < 2:
            return held[0]
        return pa.concat_tables(held).group_by("word", use_threads=False).aggregate([("n", "sum")]).rename_columns({"n_sum": "n"})

    for batch in batches:
        coded = words_of(batch.column("text"))[0].dictionary_encode()
        n = np.bincount(coded.indices.to_numpy(), minlength=len(coded.dictionary))
        held.append(pa.table({"word": coded.dictionary, "n": pa.array(n, pa.int64())}))
        if sum(map(len, held)) > HELD_WORDS:
            held = [merged()]
            # Few words that come again and again are kept, many are handed on.
            if 2 * len(held[0]) > HELD_WORDS:
                yield from held.pop().to_batches()
    if held:
        yield from merged().to_batches()


def word_counts(texts: DataFrame) -> DataFrame:
    """word and n over all texts."""
    counts = small_batches(texts).mapInArrow(_count_words, "word binary, n long")
    return counts.groupBy("word").agg(F.sum("n").alias("n"))


def frequent_words(counts: DataFrame, many: int = LISTED) -> list[tuple[bytes, int]]:
    """The ``many`` most frequent words and their counts, most frequent first, ties by bytes."""
    short = counts.filter(F.length("word") <= LONGEST)
    return [(bytes(r["word"]), r["n"]) for r in short.orderBy(F.desc("n"), "word").limit(many).collect()]


def _places(words: pa.Array):
    """Bytes of all words with END before each and after the last, where three in a row are to be predicted, and last pairs."""
    joined = pc.binary_join(pa.ListArray.from_arrays([0, len(words)], words), b" ")[0].as_py()
    line = np.frombuffer(b" " + joined + b" ", dtype=np.uint8).astype(np.int64)
    own, near, far = line[:-2], line[1:-1], line[2:]
    inside = np.flatnonzero((near != END) & (far != END))
    last = np.flatnonzero((near != END) & (far == END))
    return own, near, far, inside, last


def _slot(near: np.ndarray, far: np.ndarray) -> np.ndarray:
    return ((near * 256 + far) * 40503 & 0xFFFF) // (0x10000 // SLOTS)


def ending_of(pair: np.ndarray | int) -> np.ndarray | int:
    """Network id of words that end in a pair of bytes (the last one counts 1, the one before it 256)."""
    return 1 + pair % ENDINGS


#: Parts of one vector of counts: context slot and byte, next byte and byte, last pair.
PART_SIZES = (SLOTS * 256, 65536, 65536)


def _lengths(words: pa.Array) -> np.ndarray:
    return pc.binary_length(words).to_numpy()


def _count_bytes(listed: list[bytes]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals = np.zeros(sum(PART_SIZES))
        slots, pairs, ends = np.split(totals, np.cumsum(PART_SIZES)[:-1])
        frequent = pa.array(listed, pa.binary())
        for batch in batches:
            rare = batch.filter(pc.invert(pc.is_in(batch.column("word"), value_set=frequent)))
            words = rare.column("word")
            if not len(words):
                continue
            own, near, far, inside, last = _places(words)
            each = np.repeat(rare.column("n").to_numpy().astype(np.float64), _lengths(words) + 1)[: len(own)]
            for onto, place, at in (
                (slots, _slot(near, far) * 256 + own, inside),
                (pairs, near * 256 + own, inside),
                (ends, own * 256 + near, last),
            ):
                onto += np.bincount(place[at], weights=each[at], minlength=len(onto))
        at = np.flatnonzero(totals)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(totals[at])], ["at", "total"])

    return run


@dataclass
class Speller:
    """log P(word | ending) of words without a network id."""

    slots: np.ndarray
    pairs: np.ndarray
    ends: np.ndarray
    listed_mass: np.ndarray

    def __post_init__(self) -> None:
        bytes_seen = self.pairs.reshape(256, 256).sum(axis=0)
        anywhere = (bytes_seen + 1) / (bytes_seen.sum() + 256)
        after_one = self.pairs.reshape(256, 256)
        after_one = (after_one + BACK_OFF * anywhere) / (after_one.sum(axis=1, keepdims=True) + BACK_OFF)
        self.after_one = after_one.ravel()
        self.backed_off = BACK_OFF * self.after_one
        self.slot_total = self.slots.reshape(SLOTS, 256).sum(axis=1) + BACK_OFF
        pair = np.arange(65536)
        self.slot_of_pair = _slot(pair // 256, pair % 256)
        of_pair = ending_of(np.arange(65536))
        self.unlisted = np.bincount(of_pair, weights=self.ends, minlength=ENDINGS + 1)
        smooth = self.ends + 0.01
        self.last_pair = smooth / np.bincount(of_pair, weights=smooth, minlength=ENDINGS + 1)[of_pair]
        self.mass = self.listed_mass + self.unlisted + 1

    def log_share(self, ending: int, count: int) -> float:
        """Of a listed word."""
        return float(np.log(count / self.mass[ending]))

    def log_spelled(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Endings of unlisted words, and log P(word | ending)."""
        own, near, far, inside, last = _places(words)
        chance = np.zeros(len(own))
        sign, before = own[inside], near[inside] * 256
        slot = self.slot_of_pair[before + far[inside]]
        seen = self.slots[slot * 256 + sign] + self.backed_off[before + sign]
        chance[inside] = np.log(seen / self.slot_total[slot])
        pair = own[last] * 256 + near[last]
        ending = ending_of(pair)
        chance[last] = np.log(self.last_pair[pair]) + np.log((self.unlisted[ending] + 1) / self.mass[ending])
        ends = np.cumsum(_lengths(words) + 1)
        return ending, np.add.reduceat(chance, np.append(0, ends[:-1]))


def spell_counts(counts: DataFrame, listed: list[tuple[bytes, int]], known: int = WORDS) -> Speller:
    """The character model of all unlisted words, and the mass of listed words without a network id."""
    sums = counts.mapInArrow(_count_bytes([w for w, _ in listed]), "at int, total double")
    found = sums.groupBy("at").agg(F.sum("total").alias("total")).toArrow()
    totals = np.zeros(sum(PART_SIZES))
    totals[found.column("at").to_numpy()] = found.column("total").to_numpy()
    mass = np.zeros(ENDINGS + 1)
    for word, n in listed[known:]:
        mass[word_ending(word)] += n
    return Speller(*np.split(totals, np.cumsum(PART_SIZES)[:-1]), mass)


def word_ending(word: bytes) -> int:
    before, last = (b" " + word)[-2:]
    return ending_of(before * 256 + last)


class Vocabulary:
    """Network ids of words and log P(word | id): listed words are looked up, others are spelled."""

    def __init__(self, listed: list[tuple[bytes, int]], speller: Speller, known: int = WORDS) -> None:
        self.listed, self.speller = pa.array([w for w, _ in listed], pa.binary()), speller
        ids = [1 + ENDINGS + i for i in range(len(listed[:known]))]
        rest = [(word_ending(w), n) for w, n in listed[known:]]
        self.ids = np.array(ids + [e for e, _ in rest], dtype=np.uint16)
        self.chances = np.array([0.0] * len(ids) + [speller.log_share(e, n) for e, n in rest])

    def of_words(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Id and log P(word | id) of each word."""
        place = pc.index_in(words, value_set=self.listed).fill_null(-1).to_numpy()
        ids, chances = np.zeros(len(place), np.uint16), np.zeros(len(place))
        found, unlisted = np.flatnonzero(place >= 0), np.flatnonzero(place < 0)
        ids[found], chances[found] = self.ids[place[found]], self.chances[place[found]]
        for start in range(0, len(unlisted), SPELLED):
            some = unlisted[start : start + SPELLED]
            ids[some], chances[some] = self.speller.log_spelled(words.take(pa.array(some)))
        return ids, chances

    def numbered(self, texts: pa.Array | list[str | None]) -> tuple[list[bytes], list[float]]:
        """Ids of each text, and the sum of log P(word | id) over its words."""
        words, lengths = words_of(texts)
        # Each word is looked up once, however often the texts have it.
        coded = words.dictionary_encode()
        at = coded.indices.to_numpy()
        ids, chances = (of_word[at] for of_word in self.of_words(coded.dictionary))
        ends = np.cumsum(lengths)
        cuts = list(zip(ends - lengths, ends, strict=True))
        return [ids[a:b].tobytes() for a, b in cuts], [float(chances[a:b].sum()) for a, b in cuts]


def _numbered(listed: list[tuple[bytes, int]], speller: Speller, known: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = Vocabulary(listed, speller, known)
        for batch in batches:
            ids, spelled = vocabulary.numbered(batch.column("text"))
            columns = [batch.column("id"), pa.array(ids, pa.binary()), pa.array(spelled, pa.float64())]
            yield pa.RecordBatch.from_arrays(columns, ["id", "ids", "spelled"])

    return run


def bins_of(counts: list[int], bins: int = BINS) -> np.ndarray:
    """Bounds of bins of words by rank, of about equal mass; a bin has a word at least."""
    if not counts:
        return np.zeros(1, dtype=np.int64)
    mass = np.cumsum(np.asarray(counts, dtype=np.float64))
    cuts = np.searchsorted(mass, mass[-1] * np.arange(1, bins) / bins) + 1
    return np.unique(np.concatenate([[0], cuts, [len(counts)]]))


@dataclass
class Network:
    """Weights, all in one flat vector so that they can be averaged, and the bounds of the bins of words."""

    flat: np.ndarray
    bounds: np.ndarray
    rooms: dict[str, np.ndarray] = field(default_factory=dict, repr=False)

    def room(self, name: str, rows: int, columns: int) -> np.ndarray:
        """A matrix to be written over, whose memory is used again by the next call."""
        size = rows * columns
        if name not in self.rooms or len(self.rooms[name]) < size:
            self.rooms[name] = np.empty(size, np.float32)
        return self.rooms[name][:size].reshape(rows, columns)

    @classmethod
    def shapes(cls, bounds: np.ndarray) -> tuple[tuple[int, ...], ...]:
        words, classes = int(bounds[-1]), ENDINGS + len(bounds) - 1
        first = ((1 + ENDINGS + words, WIDTH), (2 * SIDE * WIDTH, HIDDEN), (HIDDEN,))
        return (*first, (HIDDEN, classes), (classes,), (words, HIDDEN), (words,))

    @classmethod
    def new(cls, bounds: np.ndarray, seed: int = 42) -> Network:
        rng = np.random.default_rng(seed)
        parts = []
        for shape in cls.shapes(bounds):
            spread = 1 / np.sqrt(max(shape)) if len(shape) > 1 else 1e-6
            parts.append(rng.normal(0, spread, shape).ravel())
        return cls(np.concatenate(parts).astype(np.float32), bounds)

    def parts(self, flat: np.ndarray | None = None) -> list[np.ndarray]:
        found, at = [], 0
        for shape in self.shapes(self.bounds):
            size = int(np.prod(shape))
            found.append((self.flat if flat is None else flat)[at : at + size].reshape(shape))
            at += size
        return found

    def classes_of(self, ids: np.ndarray) -> np.ndarray:
        """Class of each token: its ending, or the bin of its word. Edges have none and are given the first."""
        of_word = np.repeat(np.arange(len(self.bounds) - 1), np.diff(self.bounds)) + ENDINGS
        return np.concatenate([[0], np.arange(ENDINGS), of_word]).astype(np.int64)[ids]

    def segments(self, ids: np.ndarray) -> Iterator[tuple[int, int, int, int]]:
        """Of sorted ids: where the words of each bin begin and end, and the bounds of the bin."""
        cuts = np.searchsorted(ids, self.bounds + 1 + ENDINGS)
        for a, b, low, high in zip(cuts[:-1], cuts[1:], self.bounds[:-1], self.bounds[1:], strict=True):
            if a < b and high - low > 1:
                yield a, b, low, high

    def side_tables(self) -> list[np.ndarray]:
        """What each id adds to the hidden layer at each of the places around a token."""
        embedding, hidden, *_ = self.parts()
        return [embedding @ hidden[k * WIDTH : (k + 1) * WIDTH] for k in range(2 * SIDE)]

    def log_chances(self, ids: np.ndarray, tables: list[np.ndarray]) -> np.ndarray:
        """log P(token | sides) of every token of a document; edges among the tokens get 0."""
        _, _, bias, top, top_shift, out, shift = self.parts()
        padded = np.zeros(len(ids) + 2 * SIDE, dtype=np.uint16)
        padded[SIDE : SIDE + len(ids)] = ids
        found = np.zeros(len(ids), dtype=np.float32)
        for start in range(0, len(ids), BLOCK):
            at = start + np.argsort(ids[start : start + BLOCK], kind="stable")
            at = at[np.searchsorted(ids[at], 1) :]
            own = ids[at]
            hidden = np.repeat(bias[None, :], len(at), axis=0)
            chance, classes = np.empty(len(at), dtype=np.float32), self.classes_of(own)
            for a in range(0, len(at), SLAB):
                some, part = slice(a, a + SLAB), hidden[a : a + SLAB]
                for table, offset in zip(tables, OFFSETS, strict=True):
                    part += table.take(padded[at[some] + offset], axis=0, out=self.room("side", len(part), HIDDEN), mode="clip")
                np.maximum(part, 0, out=part)
                chance[some] = _log_softmax_at(_logits(part, top, top_shift), classes[some])
            for a, b, low, high in self.segments(own):
                logits = _logits(hidden[a:b], out[low:high].T, shift[low:high])
                chance[a:b] += _log_softmax_at(logits, own[a:b].astype(np.int64) - (1 + ENDINGS + low))
            found[at] = chance
        return found

    def slopes(self, sides: np.ndarray, targets: np.ndarray) -> np.ndarray:
        """Gradient of the mean loss over one mini-batch."""
        if (targets[1:] < targets[:-1]).any():
            order = np.argsort(targets, kind="stable")
            sides, targets = sides[order], targets[order]
        embedding, w, bias, top, top_shift, out, shift = self.parts()
        grad = np.zeros_like(self.flat)
        g = self.parts(grad)
        many, classes = len(targets), self.classes_of(targets)
        slabs = [slice(a, a + SLAB) for a in range(0, many, SLAB)]
        seen, error = self.room("seen", many, 2 * SIDE * WIDTH), self.room("error", many, len(top_shift))
        hidden, back = self.room("hidden", many, HIDDEN), self.room("back", many, HIDDEN)
        for some in slabs:
            part = seen[some]
            np.take(embedding, sides[some], axis=0, out=part.reshape(-1, 2 * SIDE, WIDTH), mode="clip")
            part = np.matmul(part, w, out=hidden[some])
            part += bias
            np.maximum(part, 0, out=part)
            logits = np.matmul(part, top, out=error[some])
            logits += top_shift
            np.matmul(_softmax_error(logits, classes[some]), top.T, out=back[some])
        g[3][:], g[4][:] = hidden.T @ error, _column_sums(error)
        for a, b, low, high in self.segments(targets):
            logits = _logits(hidden[a:b], out[low:high].T, shift[low:high])
            error = _softmax_error(logits, targets[a:b].astype(np.int64) - (1 + ENDINGS + low))
            back[a:b] += error @ out[low:high]
            g[5][low:high], g[6][low:high] = error.T @ hidden[a:b], _column_sums(error)
        back *= hidden > 0
        g[1][:], g[2][:] = seen.T @ back, _column_sums(back)
        # What reaches the embeddings: a row for each of their WIDTH places, neighbours by side and position in it.
        by_place = w.reshape(2 * SIDE, WIDTH, HIDDEN).transpose(1, 0, 2).reshape(-1, HIDDEN)
        onto = np.matmul(by_place, back.T, out=self.room("onto", 2 * SIDE * WIDTH, many))
        place = sides.T.ravel().astype(np.intp)
        for k, weights in enumerate(onto.reshape(WIDTH, -1)):
            g[0][:, k] = np.bincount(place, weights=weights, minlength=len(embedding))
        grad /= len(targets)
        return grad


def _powers(logits: np.ndarray) -> np.ndarray:
    """exp in place; logits stay far below ``HIGHEST``, which only keeps the sums finite."""
    np.clip(logits, -HIGHEST, HIGHEST, out=logits)
    return np.exp(logits, out=logits)


def _logits(rows: np.ndarray, weights: np.ndarray, shift: np.ndarray) -> np.ndarray:
    found = rows @ weights
    found += shift
    return found


def _row_sums(values: np.ndarray) -> np.ndarray:
    return values @ np.ones(values.shape[1], dtype=values.dtype)


def _column_sums(values: np.ndarray) -> np.ndarray:
    return np.ones(len(values), dtype=values.dtype) @ values


def _log_softmax_at(logits: np.ndarray, at: np.ndarray) -> np.ndarray:
    powers = _powers(logits)
    return np.log(powers[np.arange(len(at)), at] / _row_sums(powers))


def _softmax_error(logits: np.ndarray, at: np.ndarray) -> np.ndarray:
    powers = _powers(logits)
    powers *= (1 / _row_sums(powers))[:, None]
    powers[np.arange(len(at)), at] -= 1
    return powers


#: Places of the 2 * SIDE neighbours, counted from the one farthest to the left.
OFFSETS = np.array([k for k in range(2 * SIDE + 1) if k != SIDE])


def joined_ids(column: pa.Array) -> tuple[np.ndarray, np.ndarray, list[int]]:
    """Documents in one row, with edges before each and after the last so that none sees another; starts and lengths."""
    ids = [np.frombuffer(raw.as_buffer(), dtype=np.uint16) for raw in column]
    gap = np.zeros(SIDE, dtype=np.uint16)
    line = np.concatenate([gap, *[x for one in ids for x in (one, gap)]])
    lengths = [len(x) for x in ids]
    return line, SIDE + np.cumsum([0, *[n + SIDE for n in lengths]])[: len(ids)], lengths


def targets_of(starts: np.ndarray, lengths: list[int], turn: int) -> np.ndarray:
    """Positions that a round predicts; the rounds together take each position once."""
    at = [np.arange(s + turn % ROUNDS, s + n, ROUNDS) for s, n in zip(starts, lengths, strict=True)]
    found = np.concatenate(at) if at else np.zeros(0, dtype=np.int64)
    return np.random.default_rng(42 + turn).permutation(found)


def _train_round(weights: np.ndarray, bounds: np.ndarray, turn: int):
    """One task's weights after its documents, times the positions it saw; its last entry counts those."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net, squares = Network(weights.copy(), bounds), np.full(len(weights), 1e-6, dtype=np.float32)
        steps, positions = 0, 0
        for batch in batches:
            line, starts, lengths = joined_ids(batch.column("ids"))
            at = targets_of(starts, lengths, turn)
            positions += len(at)
            while len(at):
                size = min(BATCH, SMALLEST_BATCH << min(steps // 8, 16))
                some, at = at[:size], at[size:]
                some = some[np.argsort(line[some], kind="stable")]
                grad = net.slopes(line[some[:, None] - SIDE + OFFSETS], line[some])
                squares += grad * grad
                grad /= np.sqrt(squares)
                grad *= RATE
                net.flat -= grad
                steps += 1
        if positions:
            sums = np.append(net.flat.astype(np.float64) * positions, positions)
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(sums))), pa.array(sums)], ["at", "total"])

    return run


def train(numbered: DataFrame, bounds: np.ndarray, rounds: int = ROUNDS) -> Network:
    net = Network.new(bounds)
    for turn in range(rounds):
        sums = small_batches(numbered.select("ids")).mapInArrow(_train_round(net.flat, bounds, turn), "at long, total double")
        found = sums.groupBy("at").agg(F.sum("total").alias("total")).toArrow()
        total = np.zeros(len(net.flat) + 1)
        total[found.column("at").to_numpy()] = found.column("total").to_numpy()
        if total[-1]:
            net = Network((total[:-1] / total[-1]).astype(np.float32), bounds)
    return net


def _scores(net: Network):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = net.side_tables()
        for batch in batches:
            line, starts, lengths = joined_ids(batch.column("ids"))
            chances = net.log_chances(line, tables).astype(np.float64)
            sums = [float(chances[a : a + n].sum()) for a, n in zip(starts, lengths, strict=True)]
            sums = pa.array(np.array(sums) + batch.column("spelled").to_numpy())
            columns = [batch.column("id"), pa.array(lengths, pa.int64()), sums]
            yield pa.RecordBatch.from_arrays(columns, ["id", "n_tokens", "log_prob"])

    return run


def number_documents(docs: DataFrame, id_col: str, text_col: str, known: int = WORDS) -> tuple[DataFrame, np.ndarray]:
    """id, token ids (two bytes each) and the sum of log P(word | id) of every row, written once; bounds of the bins."""
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    counts = saved(word_counts(texts.select("text")), "words")
    listed = frequent_words(counts)
    run = _numbered(listed, spell_counts(counts, listed, known), known)
    rows = small_batches(texts).mapInArrow(run, "id long, ids binary, spelled double")
    return saved(rows, "numbered"), bins_of([n for _, n in listed[:known]])


def pseudo_likelihood(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", known: int = WORDS) -> DataFrame:
    """id, n_tokens, log_prob (sum over tokens) and mean_log_prob of every row; ``known`` words have network ids."""
    numbered, bounds = number_documents(docs, id_col, text_col, known)
    net = train(numbered, bounds)
    rows = small_batches(numbered).mapInArrow(_scores(net), "id long, n_tokens long, log_prob double")
    mean = F.when(F.col("n_tokens") > 0, F.col("log_prob") / F.col("n_tokens")).otherwise(0.0)
    return rows.select(F.col("id").alias(id_col), "n_tokens", "log_prob", mean.alias("mean_log_prob"))

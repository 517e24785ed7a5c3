"""Toxicity behind a noisy channel: decode disguised words, then score the restored text.

*Channel.* Writers swap letters for look-alikes (``1d10t``), stretch them (``idiooot``) or space them out
(``i d i o t``). A disguised stretch is a lattice: every character may stand for itself or for a letter it looks like, a run
of three or more equal letters for one or two of them, a separator between single letters for nothing. Viterbi search
under a character trigram model picks the reading of least cost. Text without such marks is its own only reading.

*Character model.* Letter and trigram counts over all training documents, added up per task and then over tasks.

*Score.* Five-character grams of the restored text (lower case, other characters than letters as one space). Grams are counted
over all labelled training rows, and those are kept that speak for the label. Logistic regression by
follow-the-regularised-leader weighs them: labelled rows are dealt by hash to parts of about ``PART_ROWS``, each part is fitted in a
task of its own, and a gram's weight is the mean over the parts, each counting as many times as it has rows with the gram. The share
of toxic labels among all labelled training rows sets the intercept.

Labels teach only where the id is not held out; labels, language, source and id are never inputs of a score. Several labels of one id
count as toxic if one is. NULL and empty texts have no grams and score the intercept. With no usable label every
score is 0. Equal ids and repeated rows stay rows of their own.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rowsmith.llm.common import held_out, releasing, saved, small_batches, worker_store
from rowsmith.llm.language import Ftrl

#: Labelled rows of one part; what a task holds to fit weights, not how many rows are used.
PART_ROWS = 16_000
FEATURES = 20_000
MIN_ROWS, MIN_RATIO = 4, 4.0
EPOCHS = 6
THRESHOLD = 0.3
ORDER = 5
#: Letters of the character model: the most frequent ones; the rest share one place.
LETTERS = 62
MEMORY = 50_000

#: The letters that a character is used for.
LOOKALIKES = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "€": "e", "£": "l", "(": "c", "<": "c", "*": "aeiou",
}
SWAP_COST, SQUEEZE_COST, JOIN_COST, KEEP_COST = 1.0, 0.5, 0.2, 6.0

_EDGES = ".,;:?!\"'()[]{}<>#$%&*+-_/\\|~`^=@€£"
_STRETCHED = re.compile(r"([^\W\d_])\1{2,}")
#: Letters, digits and look-alikes; ``*`` is a separator too, and the lattice reads it either way.
_MARK = r"(?:[^\W_]|[" + re.escape("".join(c for c in LOOKALIKES if not c.isalnum())) + r"])"
#: Three single marks or more with one separator between each; one of them has to be a real letter.
_SPACED = re.compile(rf"(?<![^\W_]){_MARK}(?:[ ._*-]{_MARK}){{2,}}(?![^\W_])")
_MULTIPLIER, _SPREAD = np.uint64(0x100000001B3), np.uint64(0x9E3779B97F4A7C15)
MASK_BITS = 22
#: Bits of the sieve of labelled ids: so many a label, and at most (16 MB), in bitmaps of Spark's size.
SIEVE_SHARE, SIEVE_BITS, BITMAP = 16, 1 << 27, 1 << 15


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    return np.array([chr(c).isalpha() for c in range(0x110000)])


@lru_cache(maxsize=1)
def _marks() -> np.ndarray:
    """What ``_SPACED`` takes as one mark."""
    return np.array([chr(c).isalnum() or chr(c) in LOOKALIKES for c in range(0x110000)])


@lru_cache(maxsize=1)
def _separators() -> np.ndarray:
    found = np.zeros(0x110000, dtype=bool)
    found[[ord(c) for c in " ._*-"]] = True
    return found


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4")


@dataclass(frozen=True)
class CharacterModel:
    """Costs (negative log chances) of a letter after two others; place 0 is a word edge, 1 any other letter."""

    alphabet: str
    cost: np.ndarray

    @staticmethod
    def from_counts(alphabet: str, counts: np.ndarray) -> CharacterModel:
        size = len(alphabet) + 2
        three = counts.reshape(size, size, size).astype(float)
        two, one = three.sum(axis=0), three.sum(axis=(0, 1))
        single = (one + 1) / (one.sum() + size)
        double = (two + 2 * single) / (two.sum(axis=1, keepdims=True) + 2)
        triple = (three + 2 * double[None]) / (three.sum(axis=2, keepdims=True) + 2)
        return CharacterModel(alphabet, -np.log(triple))

    def place(self, letter: str) -> int:
        return self.alphabet.find(letter) + 2 if letter in self.alphabet else int(letter.isalpha())


def letter_places(alphabet: str) -> np.ndarray:
    """Place of every code point in the character model."""
    places = _letters().astype(np.int64)
    for at, letter in enumerate(alphabet):
        places[ord(letter)] = at + 2
    return places


def lattice(token: str, spaced: bool) -> list[list[tuple[str, float]]]:
    """Readings (letters, cost) of each stretch of a disguised token, in order."""
    nodes, at = [], 0
    while at < len(token):
        letter, run = token[at], 1
        while at + run < len(token) and token[at + run] == letter:
            run += 1
        if letter.isalpha():
            if run > 2:
                nodes.append([(letter, SQUEEZE_COST), (letter * 2, SQUEEZE_COST), (letter * run, KEEP_COST)])
            else:
                nodes += [[(letter, 0.0)]] * run
        else:
            likely = [(other, SWAP_COST) for other in LOOKALIKES.get(letter, "")]
            drop = [("", JOIN_COST)] if spaced and letter in " ._*-" else []
            nodes += [[(letter, KEEP_COST if likely or drop else 1.0), *likely, *drop]] * (1 if drop else run)
        at += run
    return nodes


def decode(token: str, model: CharacterModel, spaced: bool = False) -> str:
    """The reading of least cost: Viterbi over the lattice, the state being the last two letters' places."""
    states: dict[tuple[int, int], tuple[float, object]] = {(0, 0): (0.0, None)}
    for node in lattice(token, spaced):
        after: dict[tuple[int, int], tuple[float, object]] = {}
        for (first, second), (cost, path) in states.items():
            for letters, own in node:
                a, b, total = first, second, cost + own
                for letter in letters:
                    c = model.place(letter)
                    total += model.cost[a, b, c]
                    a, b = b, c
                if (a, b) not in after or total < after[a, b][0]:
                    after[a, b] = (total, (path, letters))
        states = after
    best = min(((cost + model.cost[a, b, 0], path) for (a, b), (cost, path) in states.items()), key=lambda s: s[0])[1]
    parts = []
    while best:
        best, letters = best
        parts.append(letters)
    return "".join(reversed(parts))


def _disguised(word: str) -> bool:
    """True for a word (no white space) with a look-alike among letters, or a stretched letter."""
    if not word.isalpha():
        core = word.strip(_EDGES)
        if not core.isalpha():
            # A look-alike may also be the first or the last character: @ss, idi0t$.
            letters = sum(map(str.isalpha, word))
            swaps = sum(c in LOOKALIKES for c in core)
            if swaps and letters and swaps + letters >= len(core) - 1:
                return True
    return bool(_STRETCHED.search(word))


def _joined(stretch: str, model: CharacterModel) -> str:
    """A stretch of spaced marks decoded; numbers and signs alone are no word."""
    return decode(stretch, model, True) if any(map(str.isalpha, stretch)) else stretch


def restore(text: str | None, model: CharacterModel, memory: dict[str, str]) -> str:
    """Lower-case text with every disguised stretch decoded."""
    if not text:
        return ""
    text = text.lower()
    codes = _codes(text)
    mark, gap = _marks()[codes], _separators()[codes]
    # Mark, separator, mark, separator, mark: only then can letters be spaced out.
    step = mark[:-1] & gap[1:]
    if len(mark) > 4 and (step[:-3] & step[2:-1] & mark[4:]).any():
        text = _SPACED.sub(lambda found: _joined(found.group(), model), text)
    words = text.split()
    strange = {w for w in set(words) if not w.isalpha() or _STRETCHED.search(w)}
    strange = {w for w in strange if _disguised(w)}
    if not strange:
        return text
    for word in strange:
        if word not in memory:
            if len(memory) >= MEMORY:
                memory.clear()
            memory[word] = decode(word.strip(".,;:?\"'()[]{}#%&"), model)
    return " ".join([memory[w] if w in strange else w for w in words])


def gram_ids(text: str) -> np.ndarray:
    """A 64-bit id of every gram of restored text; words are divided by one space, as are the ends."""
    codes = _codes(text)
    letter = _letters()[codes] if len(codes) else np.zeros(0, dtype=bool)
    if not letter.any():
        return np.zeros(0, dtype=np.uint64)
    first_gap = ~letter
    first_gap[1:] &= letter[:-1]
    codes = np.where(letter, codes, 32)[letter | first_gap]
    codes = np.concatenate([[32], codes, [32]]).astype(np.uint64)
    if len(codes) < ORDER:
        codes = np.concatenate([codes, np.full(ORDER - len(codes), 32, dtype=np.uint64)])
    value = codes[: len(codes) - ORDER + 1].copy()
    for at in range(1, ORDER):
        value = value * _MULTIPLIER + codes[at : len(codes) - ORDER + 1 + at]
    return value * _SPREAD


def _frequent_letters(training: DataFrame) -> str:
    """The ``LETTERS`` most frequent letters of the training texts, most frequent first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(0x110000, dtype=np.int64)
        for batch in batches:
            joined = "".join(t.lower() for t in batch.column("text").to_pylist() if t)
            for at in range(0, len(joined), 1 << 20):
                found = np.bincount(_codes(joined[at : at + (1 << 20)]))
                seen[: len(found)] += found
        some = np.flatnonzero(seen * _letters())
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(seen[some])], ["code", "n"])

    rows = small_batches(training).mapInArrow(run, "code long, n long").groupBy("code").agg(F.sum("n").alias("n"))
    return "".join(chr(r["code"]) for r in rows.orderBy(F.desc("n"), "code").limit(LETTERS).collect())


def character_model(training: DataFrame) -> CharacterModel:
    """Trigram counts over all ``training`` texts, whose most frequent letters have places of their own."""
    alphabet = _frequent_letters(training.select("text"))
    size = len(alphabet) + 2
    places = letter_places(alphabet).astype(np.int32)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(size**3, dtype=np.int64)
        for batch in batches:
            # Two word edges between texts, so none runs into the next.
            joined = "  ".join(t.lower() for t in batch.column("text").to_pylist() if t)
            for at in range(0, len(joined), 1 << 20):
                found = places[_codes(joined[max(0, at - 2) : at + (1 << 20)])]
                if len(found) > 2:
                    seen += np.bincount((found[:-2] * size + found[1:-1]) * size + found[2:], minlength=size**3)
        some = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(seen[some])], ["cell", "n"])

    rows = small_batches(training.select("text")).mapInArrow(run, "cell long, n long")
    found = rows.groupBy("cell").agg(F.sum("n").alias("n")).toArrow()
    counts = np.zeros(size**3, dtype=np.int64)
    counts[found.column("cell").to_numpy()] = found.column("n").to_numpy()
    return CharacterModel.from_counts(alphabet, counts)


@dataclass(frozen=True)
class ToxicityModel:
    characters: CharacterModel
    ids: np.ndarray  # sorted
    weights: np.ndarray
    intercept: float
    learned: bool = True

    def features(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """Positions in ``ids`` of the kept grams of restored text, and log(1 + how often) each."""
        found = gram_ids(text)
        if not len(self.ids) or not len(found):
            return np.zeros(0, dtype=np.int64), np.zeros(0)
        found, n = np.unique(found[self.mask()[found >> np.uint64(64 - MASK_BITS)]], return_counts=True)
        at = np.minimum(np.searchsorted(self.ids, found), len(self.ids) - 1)
        kept = self.ids[at] == found
        return at[kept], np.log1p(n[kept])

    def mask(self) -> np.ndarray:
        """Which leading bits any kept gram has; made once per task."""
        made = self.__dict__.get("_mask")
        if made is None:
            made = np.zeros(1 << MASK_BITS, dtype=bool)
            made[self.ids >> np.uint64(64 - MASK_BITS)] = True
            self.__dict__["_mask"] = made
        return made

    def score(self, text: str | None, memory: dict[str, str]) -> float:
        if not self.learned:
            return 0.0
        at, value = self.features(restore(text, self.characters, memory))
        return float(1 / (1 + np.exp(-(self.intercept + value @ self.weights[at]))))


def _restored(characters: CharacterModel):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memory = worker_store("restored")
        memory.clear()
        for batch in batches:
            texts = pa.array([restore(t.as_py(), characters, memory) for t in batch.column("text")], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column("id"), texts, batch.column("toxic")], ["id", "text", "toxic"])

    return run


def sieved(docs: DataFrame, known: DataFrame, n: int) -> DataFrame:
    """Rows of ``docs`` (id, text) without most of those whose id is none of the ``n`` in ``known``; no other row is lost.

    Ids are hashed to bits, those of ``known`` are set. Texts that no label belongs to are so left out before a shuffle.
    """
    slot = F.pmod(F.xxhash64("id"), F.lit(min(SIEVE_BITS, max(BITMAP, SIEVE_SHARE * n))))
    slots = known.select(slot.alias("slot"))
    place = F.col("slot") % BITMAP
    bitmaps = slots.groupBy(F.expr(f"slot div {BITMAP}").alias("bucket")).agg(F.bitmap_construct_agg(place).alias("bitmap"))
    rows = docs.withColumn("slot", slot).join(F.broadcast(bitmaps), F.expr(f"slot div {BITMAP}") == F.col("bucket"))
    byte = F.expr(f"conv(hex(substring(bitmap, cast(slot % {BITMAP} div 8 AS int) + 1, 1)), 16, 10)").cast("int")
    return rows.filter(F.getbit(byte, (place % 8).cast("int")) == 1).select("id", "text")


def labelled_rows(docs: DataFrame, labels: DataFrame, characters: CharacterModel) -> tuple[DataFrame, float]:
    """``id, text, toxic`` of all labelled rows, their texts restored, and the share of toxic ones among all labels."""
    known = labels.groupBy("id").agg(F.max("toxic").alias("toxic"))
    counts = {r["toxic"]: r["count"] for r in known.groupBy("toxic").count().collect()}
    share = counts.get(1, 0) / max(1, counts.get(0, 0) + counts.get(1, 0))
    rows = sieved(docs, known, sum(counts.values()))
    # One way to join at every size: few labels would be broadcast, more would have every text shuffled.
    marks = known.withColumnRenamed("id", "l_id").hint("shuffle_hash")
    rows = rows.join(marks, F.col("id") == F.col("l_id")).select("id", "text", "toxic")
    return saved(small_batches(rows).mapInArrow(_restored(characters), "id long, text string, toxic int"), "labelled"), share


def _gram_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (gram, label, n) of a batch of restored texts: in how many of each label a gram stands."""
    for batch in batches:
        for label in (0, 1):
            texts = [t for t, y in zip(batch.column("text"), batch.column("toxic").to_pylist(), strict=True) if y == label]
            found = [np.unique(gram_ids(t.as_py())) for t in texts]
            ids, n = np.unique(np.concatenate([np.zeros(0, dtype=np.uint64), *found]), return_counts=True)
            columns = [pa.array(ids.view(np.int64)), pa.array([label] * len(ids), pa.int32()), pa.array(n)]
            yield pa.RecordBatch.from_arrays(columns, ["gram", "label", "n"])


def _feature_rows(model: ToxicityModel):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [model.features(t.as_py()) for t in batch.column("text")]
            lists = [pa.array([r[0] for r in rows], pa.list_(pa.int64())), pa.array([r[1] for r in rows], pa.list_(pa.float64()))]
            yield pa.RecordBatch.from_arrays(
                [batch.column("part"), batch.column("id"), batch.column("mark"), batch.column("toxic"), *lists],
                ["part", "id", "mark", "toxic", "at", "value"],
            )

    return run


def train(docs: DataFrame, labels: DataFrame, is_training: Column, part_rows: int = PART_ROWS) -> ToxicityModel:
    """``docs``: id, text. ``labels``: id, toxic (0 or 1)."""
    labels = labels.filter(is_training & F.col("toxic").isin(0, 1) & F.col("id").isNotNull())
    training = docs.filter(is_training)
    characters = character_model(training)
    known, share = labelled_rows(training, labels, characters)
    totals = {r["toxic"]: r["count"] for r in known.groupBy("toxic").count().collect()}
    good, bad = totals.get(0, 0), totals.get(1, 0)
    none = ToxicityModel(characters, np.zeros(0, dtype=np.uint64), np.zeros(0), 0.0, False)
    if not good + bad:
        return none
    counted = small_batches(known.select("text", "toxic")).mapInArrow(_gram_counts, "gram long, label int, n long")
    by_label = [F.sum(F.when(F.col("label") == y, F.col("n")).otherwise(0)) for y in (0, 1)]
    grams = counted.groupBy("gram").agg(by_label[0].alias("clean"), by_label[1].alias("toxic"))
    ratio = ((F.col("toxic") + 0.1) / (bad + 1)) / ((F.col("clean") + 0.5) / (good + 1))
    kept = grams.filter((F.col("toxic") >= MIN_ROWS) & (ratio >= MIN_RATIO))
    kept = kept.orderBy(F.desc("toxic"), "gram").limit(FEATURES).select("gram").toArrow()
    ids = np.sort(kept.column("gram").to_numpy().view(np.uint64))
    model = ToxicityModel(characters, ids, np.zeros(len(ids)), 0.0)
    mark = F.xxhash64("id", "text")
    parts = max(1, -(-(good + bad) // part_rows))
    dealt = known.select(F.pmod(mark, F.lit(parts)).cast("int").alias("part"), "id", mark.alias("mark"), "toxic", "text")
    schema = "part int, id long, mark long, toxic int, at array<long>, value array<double>"
    return fitted(model, small_batches(dealt).mapInArrow(_feature_rows(model), schema), share, bad / (good + bad))


def _part_weights(bias: int):
    """Rows (at, weight, n) of a part's own regression: the weight of a gram, and in how many rows it stands."""

    def run(part: pa.Table) -> pa.Table:
        part = part.sort_by([("id", "ascending"), ("mark", "ascending"), ("toxic", "ascending")]).combine_chunks()
        ftrl, order, held = Ftrl(bias + 1, 2), np.random.default_rng(42), np.zeros(bias + 1, dtype=np.int64)
        labels = part.column("toxic").to_numpy()
        points = []
        for at, value in zip(part.column("at"), part.column("value"), strict=True):
            points.append((np.append(at.values.to_numpy(), bias), np.append(value.values.to_numpy(), 1.0)))
            held[points[-1][0]] += 1
        for _ in range(EPOCHS):
            for i in order.permutation(len(points)):
                ftrl.learn(*points[i], int(labels[i]))
        two = ftrl.weights(np.arange(bias + 1))
        some = np.flatnonzero(held)
        return pa.table({"at": some, "weight": (two[:, 1] - two[:, 0])[some], "n": held[some]})

    return run


def fitted(model: ToxicityModel, rows: DataFrame, share: float, drawn: float) -> ToxicityModel:
    """Weights of the kept grams; the intercept is moved from the rows' share of toxic ones, ``drawn``, to ``share``."""
    bias = len(model.ids)
    parts = rows.groupBy("part").applyInArrow(_part_weights(bias), "at long, weight double, n long")
    mean = (F.sum(F.col("weight") * F.col("n")) / F.sum("n")).alias("weight")
    found = parts.groupBy("at").agg(mean).toArrow()
    weights = np.zeros(bias + 1)
    weights[found.column("at").to_numpy()] = found.column("weight").to_numpy()
    drawn, share = (min(max(v, 1e-6), 1 - 1e-6) for v in (drawn, share))
    moved = np.log(share / (1 - share)) - np.log(drawn / (1 - drawn))
    return ToxicityModel(model.characters, model.ids, weights[:-1], float(weights[-1] + moved))


def _scores(model: ToxicityModel):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memory = worker_store("restored")
        memory.clear()
        for batch in batches:
            scores = [model.score(t.as_py(), memory) for t in batch.column("text")]
            rest = [batch.column(n) for n in batch.schema.names]
            yield pa.RecordBatch.from_arrays([*rest, pa.array(scores, pa.float64())], [*batch.schema.names, "score"])
        memory.clear()

    return releasing(run)


def _inputs(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str) -> tuple[DataFrame, DataFrame]:
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return texts, labels.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("int").alias("toxic"))


def toxicity_scores(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic"
) -> DataFrame:
    """id, held_out, score and predicted of every row."""
    texts, marks = _inputs(docs, labels, id_col, text_col, label_col)
    model = train(texts, marks, ~held_out(F.col("id")))
    scored = small_batches(texts).mapInArrow(_scores(model), "id long, text string, score double")
    return scored.select(
        F.col("id").alias(id_col), held_out(F.col("id")).alias("held_out"), "score",
        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"),
    )


def without_toxic(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic"
) -> DataFrame:
    """The rows of ``docs`` whose score is below the threshold; decided where the rows are read, without a shuffle."""
    texts, marks = _inputs(docs, labels, id_col, text_col, label_col)
    model = train(texts, marks, ~held_out(F.col("id")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memory = worker_store("restored")
        memory.clear()
        for batch in batches:
            column = batch.column(batch.schema.names.index(text_col)).cast(pa.string())
            keep = [model.score(t.as_py(), memory) < THRESHOLD for t in column]
            yield batch.filter(pa.array(keep, pa.bool_()))
        memory.clear()

    return small_batches(docs).mapInArrow(releasing(run), docs.schema)

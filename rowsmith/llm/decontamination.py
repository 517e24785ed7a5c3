"""Benchmark decontamination by latent semantic retrieval.

1. Texts become words (lower case, without ASCII punctuation), kept as 32-bit hashes. Passages of ``PASSAGE`` words are
   weighed by TF-IDF over ``FEATURES`` hashed words; document frequencies come from all passages.
2. A distributed randomised SVD finds the latent space: every task adds up A'(A R) over its passages for a fixed random
   matrix R, and a single-pass Nystroem step turns that sum into the leading right singular vectors.
3. Blocks of ``STEP`` words are projected, a word that repeats in its block once; windows of 1, 2, 4 ... blocks are sums of
   blocks. Each item is compared by cosine with all windows of the length that holds it. Places that have ``GRAM`` words of an item in a row
   are candidates whatever their cosine, so no verbatim copy is lost beside what fills its window. The items are a stated query
   set of checked size, in blocks beyond it.
4. Candidates are checked on words: the longest common subsequence with the item, next to the window. ``VERBATIM`` of the item is a
   leak; from ``PARAPHRASE`` on it is one if the item's answer (its last words) and half of its rare words, if it has any, are there too.

Every word of every text is searched. Defined cases: NULL or empty texts hold no leak; items without a word find nothing; a NULL
item id is a valid id; equal item ids report their best. Equal document ids and repeated rows are searched as rows. Empty
tables find nothing.
"""

from __future__ import annotations

import string
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rowsmith.llm.common import releasing, saved, small_batches

FEATURES, RANK, OVERSAMPLE = 1024, 96, 8
PASSAGE, STEP = 64, 8
COSINE = 0.35
VERBATIM, PARAPHRASE, ANSWER_WORDS, ANSWER = 0.75, 0.5, 6, 0.8
#: A word that fewer than one passage in 20 has says something; of those half must be there too.
RARE, RARE_SHARE = 3.0, 0.5
#: Words in a row of an item (all, if it has fewer) that make a place a candidate, and the bits that tell most other places.
GRAM, GRAM_BITS = 5, 22
#: Items searched for at once; a longer list is searched in blocks.
ITEMS = 10_000
#: Words that are projected at once.
GROUP_WORDS = 1 << 16

_PUNCTUATION = string.punctuation.encode()


def word_hashes(text: str | None) -> np.ndarray:
    words = (text or "").lower().encode("utf-8", "surrogatepass").translate(None, _PUNCTUATION).split()
    return np.fromiter(map(zlib.crc32, words), dtype="<u4", count=len(words))


def _encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        raw = [word_hashes(t.as_py()).tobytes() for t in batch.column("text")]
        yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(raw, pa.binary())], ["id", "words"])


def encoded_documents(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id and word hashes of every row, written once for the passes to come."""
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return saved(small_batches(texts).mapInArrow(releasing(_encoded), "id long, words binary"), "words")


def _passages(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
    """Feature and passage number of each word, and how many passages, for some hundred passages at a time."""
    features, numbers, many = [], [], 0
    for batch in batches:
        for raw in batch.column("words"):
            words = np.frombuffer(raw.as_buffer(), dtype="<u4")
            for at in range(0, len(words), 512 * PASSAGE):
                part = words[at : at + 512 * PASSAGE] % FEATURES
                features.append(part.astype(np.int64))
                numbers.append(np.arange(len(part)) // PASSAGE + many)
                many += -(-len(part) // PASSAGE)
                if many >= 512:
                    yield np.concatenate(features), np.concatenate(numbers), many
                    features, numbers, many = [], [], 0
    if many:
        yield np.concatenate(features), np.concatenate(numbers), many


def _frequency_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    frequency = np.zeros(FEATURES + 1, dtype=np.int64)
    for features, numbers, many in _passages(batches):
        seen = np.zeros((many, FEATURES), dtype=bool)
        seen[numbers, features] = True
        frequency[:FEATURES] += seen.sum(axis=0)
        frequency[FEATURES] += many
    yield pa.RecordBatch.from_arrays([pa.array(np.arange(FEATURES + 1)), pa.array(frequency)], ["feature", "n"])


def inverse_frequencies(encoded: DataFrame) -> np.ndarray:
    rows = small_batches(encoded.select("words")).mapInArrow(_frequency_rows, "feature long, n long")
    found = rows.groupBy("feature").agg(F.sum("n").alias("n")).toArrow()
    n = np.zeros(FEATURES + 1)
    n[found.column("feature").to_numpy()] = found.column("n").to_numpy()
    return np.log((1 + n[FEATURES]) / (1 + n[:FEATURES])) + 0.05


def _random_matrix() -> np.ndarray:
    return np.linalg.qr(np.random.default_rng(42).normal(size=(FEATURES, RANK + OVERSAMPLE)))[0]


def _sketch_rows(idf: np.ndarray):
    """One task's share of A'(A R), a row per feature."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        random = _random_matrix().astype(np.float32)
        total = np.zeros((FEATURES, RANK + OVERSAMPLE))
        for features, numbers, many in _passages(batches):
            cells = np.bincount(numbers * FEATURES + features, weights=idf[features], minlength=many * FEATURES)
            passages = cells.astype(np.float32).reshape(many, FEATURES)
            # Every passage counts the same, however long.
            lengths = np.sqrt(np.einsum("ij,ij->i", passages, passages))
            passages /= np.maximum(lengths, 1e-9)[:, None]
            total += passages.T @ (passages @ random)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.arange(FEATURES)), pa.array(list(total), pa.list_(pa.float64()))], ["feature", "sums"]
        )

    return run


def latent_basis(encoded: DataFrame, idf: np.ndarray) -> np.ndarray:
    """Leading right singular vectors (FEATURES x RANK) of the TF-IDF passages, over their singular values."""
    rows = small_batches(encoded.select("words")).mapInArrow(_sketch_rows(idf), "feature long, sums array<double>")
    cells = rows.select("feature", F.posexplode("sums").alias("at", "value"))
    found = cells.groupBy("feature", "at").agg(F.sum("value").alias("value")).toArrow()
    sketch = np.zeros((FEATURES, RANK + OVERSAMPLE))
    sketch[found.column("feature").to_numpy(), found.column("at").to_numpy()] = found.column("value").to_numpy()
    vectors, spread = nystroem(sketch, _random_matrix())
    # Equal spread in every direction, so the few directions of common words don't decide the cosine.
    return vectors[:, :RANK] / np.sqrt(np.maximum(spread[:RANK], 1e-6 * max(float(spread[0]), 1e-30)))


def nystroem(sketch: np.ndarray, random: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvectors and eigenvalues of G, largest first, from ``sketch`` = G R of a positive semidefinite G."""
    core = random.T @ sketch
    spread, turn = np.linalg.eigh((core + core.T) / 2)
    # Directions that a small or uniform corpus doesn't fill are left out; they would only hold rounding.
    kept = spread > 1e-6 * max(float(spread[-1]), 1e-30)
    vectors, values, _ = np.linalg.svd(sketch @ (turn[:, kept] / np.sqrt(spread[kept])), full_matrices=False)
    found = np.zeros_like(sketch)
    found[:, : vectors.shape[1]] = vectors
    return found, np.append(values**2, np.zeros(sketch.shape[1] - len(values)))


@dataclass
class Item:
    item_id: object
    words: np.ndarray
    rare: frozenset[int] = frozenset()
    masks: dict[int, int] = field(default_factory=dict)
    answer_masks: dict[int, int] = field(default_factory=dict)
    answer_size: int = 0

    def __post_init__(self) -> None:
        words = self.words.tolist()
        answer = words[-min(ANSWER_WORDS, -(-len(words) // 3)) :]
        self.answer_size = len(answer)
        for target, some in ((self.masks, words), (self.answer_masks, answer)):
            for place, word in enumerate(some):
                target[word] = target.get(word, 0) | 1 << place


def common_subsequence(masks: dict[int, int], size: int, words: list[int]) -> int:
    """Length of the longest common subsequence, a bit per word of the item (Hyyrö's bit-parallel form)."""
    full = left = (1 << size) - 1
    for word in words:
        if word in masks:
            matched = left & masks[word]
            left = (left + matched | left - matched) & full
    return size - left.bit_count()


def gram_hashes(words: np.ndarray, size: int) -> np.ndarray:
    """64-bit hashes of ``size`` words in a row at each place."""
    many = max(0, len(words) - size + 1)
    mixed = words[:many].astype(np.uint64)
    for k in range(1, size):
        mixed = (mixed ^ (mixed >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15) + words[k : k + many]
    return (mixed ^ (mixed >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)


def block_features(words: np.ndarray, blocks: int) -> np.ndarray:
    """Features of words in ``blocks`` rows of ``STEP``; what repeats in a row is padding from the second time on."""
    padded = np.full(blocks * STEP, FEATURES, dtype=np.int64)
    padded[: len(words)] = words % FEATURES
    rows = np.sort(padded.reshape(-1, STEP), axis=1)
    rows[:, 1:][rows[:, 1:] == rows[:, :-1]] = FEATURES
    return rows


@dataclass
class Retriever:
    """The latent space and a block of items; small enough to travel with a task."""

    table: np.ndarray  # what each feature adds to a latent vector; the last row, for padding, is zero
    items: list[Item]

    def __post_init__(self) -> None:
        self.by_span: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        spans: dict[int, list[int]] = {}
        for n, item in enumerate(self.items):
            span = 1
            while span * STEP < len(item.words):
                span *= 2
            spans.setdefault(span, []).append(n)
        for span, some in sorted(spans.items()):
            features = [block_features(w, -(-len(w) // STEP)) for w in (self.items[n].words for n in some)]
            vectors = np.stack([self.table[f].sum(axis=(0, 1)) for f in features])
            vectors /= np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-9)
            self.by_span[span] = np.array(some), np.ascontiguousarray(vectors.T.astype(np.float32))
        self.widest = max(self.by_span, default=1)
        self.span_of = {n: (span, k) for span, (some, _) in self.by_span.items() for k, n in enumerate(some.tolist())}
        self.by_gram: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = {}
        for size in sorted({min(GRAM, len(item.words)) for item in self.items}):
            some = [(n, gram_hashes(i.words, size)) for n, i in enumerate(self.items) if min(GRAM, len(i.words)) == size]
            hashes = np.concatenate([h for _, h in some])
            owners = np.concatenate([np.full(len(h), n) for n, h in some])
            order = np.argsort(hashes, kind="stable")
            marks = np.zeros(1 << GRAM_BITS, dtype=bool)
            marks[hashes >> np.uint64(64 - GRAM_BITS)] = True
            places = np.concatenate([np.arange(len(h)) for _, h in some])
            self.by_gram[size] = hashes[order], owners[order], places[order], marks

    def search(self, documents: list[np.ndarray]) -> Iterator[tuple[int, int, float, float, bool]]:
        """(document, item, share of the item found, cosine, answer found) of every leak in some documents."""
        starts, sizes, parts, at = [], [], [], 0
        for words in documents:
            # Behind each document is room for the widest window, so no window sees two of them.
            blocks = -(-len(words) // STEP) + self.widest
            starts.append(at)
            sizes.append(-(-len(words) // STEP))
            parts.append(block_features(words, blocks))
            at += blocks
        if not parts or not self.by_span:
            return
        blocks = self.table[np.concatenate(parts)].sum(axis=1)
        firsts, lengths = np.array(starts), np.array(sizes)
        windows, width = blocks, 1
        best: dict[tuple[int, int], tuple[float, float, bool]] = {}

        def note(found: Iterator[tuple[int, int, float, float, bool]]) -> None:
            for doc, item, share, cosine, answer in found:
                if (doc, item) not in best or share > best[doc, item][0]:
                    best[doc, item] = share, cosine, answer

        while True:
            if width in self.by_span:
                note(self._of_width(documents, firsts, lengths, windows, width))
            if width >= self.widest:
                break
            windows = windows[:-width] + windows[width:]
            width *= 2
        note(self._of_grams(documents))
        for (doc, item), found in sorted(best.items()):
            yield doc, item, *found

    def _of_width(self, documents, firsts, lengths, windows, width):
        numbers, vectors = self.by_span[width]
        for at in range(0, len(windows), 8192):
            part = windows[at : at + 8192]
            edge = COSINE * np.sqrt(np.einsum("ij,ij->i", part, part))
            alike = part @ vectors
            rows, columns = np.nonzero((alike >= edge[:, None]) & (edge[:, None] > 0))
            # A window that starts in the room behind a document would see the next one.
            owner = np.searchsorted(firsts, at + rows, side="right") - 1
            inside = at + rows - firsts[owner] < lengths[owner]
            rows, columns = rows[inside], columns[inside]
            order = np.lexsort((rows, columns))
            checked: tuple[int, int] | None = None  # item and block up to which its window was checked
            for row, column in zip(rows[order].tolist(), columns[order].tolist(), strict=True):
                # Windows that overlap the last checked one by more than half say nothing new.
                if checked and checked[0] == column and row < checked[1] + max(1, width // 2):
                    continue
                checked = column, row
                doc = int(np.searchsorted(firsts, at + row, side="right")) - 1
                cosine = float(alike[row, column] * COSINE / edge[row])
                found = self._verify(documents[doc], (at + row - firsts[doc]) * STEP, width * STEP, int(numbers[column]))
                if found:
                    yield doc, int(numbers[column]), found[0], cosine, found[1]

    def _of_grams(self, documents: list[np.ndarray]) -> Iterator[tuple[int, int, float, float, bool]]:
        """Leaks at places that have some words of an item in a row; a place near a checked one is not checked again."""
        words = np.concatenate(documents)
        ends = np.cumsum([len(d) for d in documents])
        for size, (hashes, owners, places, marks) in self.by_gram.items():
            grams = gram_hashes(words, size)
            likely = np.flatnonzero(marks[grams >> np.uint64(64 - GRAM_BITS)])
            left, right = (np.searchsorted(hashes, grams[likely], side) for side in ("left", "right"))
            checked: set[tuple[int, int, int]] = set()
            for at, i, j in zip(likely.tolist(), left.tolist(), right.tolist(), strict=True):
                doc = int(np.searchsorted(ends, at, side="right")) if i < j else 0
                if i == j or at + size > ends[doc]:
                    continue
                for n, place in zip(owners[i:j].tolist(), places[i:j].tolist(), strict=True):
                    start = at - int(ends[doc] - len(documents[doc])) - place
                    span, column = self.span_of[n]
                    spot = doc, n, start // max(STEP, span * STEP // 2)
                    if spot in checked:
                        continue
                    checked.add(spot)
                    found = self._verify(documents[doc], start, span * STEP, n)
                    if found:
                        near = documents[doc][max(0, start) : max(0, start) + span * STEP]
                        vector = self.table[block_features(near, span)].sum(axis=(0, 1))
                        length = max(float(np.linalg.norm(vector)), 1e-9)
                        yield doc, n, found[0], float(vector @ self.by_span[span][1][:, column]) / length, found[1]

    def _verify(self, words: np.ndarray, start: int, size: int, number: int) -> tuple[float, bool] | None:
        item = self.items[number]
        near = words[max(0, start - size // 2) : max(0, start + size + size // 2)].tolist()
        if sum(map(item.masks.__contains__, near)) < PARAPHRASE * len(item.words):
            return None
        share = common_subsequence(item.masks, len(item.words), near) / len(item.words)
        if share < PARAPHRASE:
            return None
        answer = common_subsequence(item.answer_masks, item.answer_size, near) >= ANSWER * item.answer_size
        rare = len(item.rare.intersection(near)) >= RARE_SHARE * len(item.rare)
        return (share, answer) if share >= VERBATIM or (answer and rare) else None


def retrievers(
    encoded: DataFrame, benchmark: DataFrame, item_col: str = "item_id", text_col: str = "text", block: int = ITEMS
) -> Iterator[Retriever]:
    """One retriever for each block of items; the latent space is the same for all.

    The number of items is counted first; what is collected at once has about ``block`` items.
    """
    idf = inverse_frequencies(encoded)
    basis = latent_basis(encoded, idf)
    table = np.vstack([idf[:, None] * basis, np.zeros((1, basis.shape[1]))]).astype(np.float32)
    questions = benchmark.select(F.col(item_col).alias("item_id"), F.col(text_col).cast("string").alias("text"))
    many = max(1, -(-questions.count() // block))
    for turn in range(many):
        some = questions.filter(F.pmod(F.xxhash64("item_id"), F.lit(many)) == turn).collect()
        found = [(r["item_id"], word_hashes(r["text"])) for r in some]
        items = [Item(i, words, frozenset(words[idf[words % FEATURES] >= RARE].tolist())) for i, words in found if len(words)]
        yield Retriever(table, items)


def _groups(rows: Iterator[tuple[object, np.ndarray]]) -> Iterator[list[tuple[object, np.ndarray]]]:
    """Rows put together up to about ``GROUP_WORDS`` words."""
    group, size = [], 0
    for row in rows:
        group.append(row)
        size += len(row[1]) + STEP
        if size >= GROUP_WORDS:
            yield group
            group, size = [], 0
    if group:
        yield group


def _leak_rows(retriever: Retriever):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = (np.frombuffer(raw.as_buffer(), dtype="<u4") for raw in batch.column("words"))
            for group in _groups(zip(batch.column("id").to_pylist(), words, strict=True)):
                found = list(retriever.search([w for _, w in group]))
                columns = [
                    pa.array([group[f[0]][0] for f in found], pa.int64()), pa.array([f[1] for f in found], pa.int32()),
                    pa.array([f[2] for f in found], pa.float64()), pa.array([f[3] for f in found], pa.float64()),
                    pa.array([f[4] for f in found], pa.bool_()),
                ]
                yield pa.RecordBatch.from_arrays(columns, ["id", "item", "share", "cosine", "answer"])

    return run


def leaks(
    docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id"
) -> DataFrame:
    """id, item id, lcs_share, cosine, has_answer: a row for each document and benchmark item that it leaks."""
    encoded = encoded_documents(docs, id_col, text_col)
    schema = "id long, item int, share double, cosine double, answer boolean"
    kind = benchmark.schema[item_col].dataType.simpleString()
    found = None
    for retriever in retrievers(encoded, benchmark, item_col):
        names = encoded.sparkSession.createDataFrame(
            [(n, i.item_id) for n, i in enumerate(retriever.items)], f"n int, item_id {kind}"
        )
        part = small_batches(encoded).mapInArrow(_leak_rows(retriever), schema).join(names, F.col("item") == F.col("n"))
        found = part if found is None else found.unionAll(part)
    best = found.groupBy("id", "item_id").agg(F.max(F.struct("share", "cosine", "answer")).alias("b"))
    return best.select(
        F.col("id").alias(id_col), F.col("item_id").alias(item_col), F.col("b.share").alias("lcs_share"),
        F.col("b.cosine").alias("cosine"), F.col("b.answer").alias("has_answer"),
    )


def without_leaks(
    docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id"
) -> DataFrame:
    """The rows of ``docs`` that leak no item; decided where the rows are read, without a shuffle."""
    encoded = encoded_documents(docs, id_col, text_col)
    for retriever in retrievers(encoded, benchmark, item_col):
        docs = small_batches(docs).mapInArrow(releasing(_clean_rows(retriever, text_col)), docs.schema)
    return docs


def _clean_rows(retriever: Retriever, text_col: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(batch.schema.names.index(text_col)).cast(pa.string())
            keep = np.ones(batch.num_rows, dtype=bool)
            rows = ((n, word_hashes(t.as_py())) for n, t in enumerate(texts))
            for group in _groups(rows):
                keep[[group[f[0]][0] for f in retriever.search([w for _, w in group])]] = False
            yield batch.filter(pa.array(keep))

    return run

"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams.

Text is lower-cased, every run of other characters than letters becomes one space, and all n-grams of one to
three characters are hashed into ``BUCKETS`` features. Document frequencies come from all training rows. The
weights are trained by follow-the-regularised-leader with elastic-net penalties (L1 makes them sparse) on a
sample of at most ``FIT_ROWS`` labelled rows, drawn evenly over languages by hash; a fifth of it, unseen in training, sets the
temperature that calibrates the probabilities. Every whole text is scored.

Only the text is an input of a prediction. Rows with a NULL language teach nothing. A NULL text, or one without a letter,
is ``und`` with score 0; so is every text if nothing was learned. Ties go to the first language by code point.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from rowsmith.llm.common import held_out, small_batches

BUCKETS = 1 << 16
FIT_ROWS = 3_000
EPOCHS = 4
ALPHA, BETA, L1, L2 = 0.5, 1.0, 0.02, 0.1
UNKNOWN = "und"

_SPREAD, _STEP = np.uint64(0x9E3779B97F4A7C15), np.uint64(0x100000001B3)
_SHIFT = np.uint64(64 - 16)


@lru_cache(maxsize=1)
def _letter_table() -> np.ndarray:
    return np.array([chr(c).isalpha() for c in range(0x110000)])


def grams(text: str | None) -> np.ndarray | None:
    """Feature of every n-gram of the text, or None where it has no letter."""
    if not text:
        return None
    codes = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), dtype="<u4")
    letter = _letter_table()[codes]
    if not letter.any():
        return None
    first_gap = ~letter
    first_gap[1:] &= letter[:-1]
    codes = np.where(letter, codes, 32)[letter | first_gap]
    codes = np.concatenate([[32], codes, [32]]).astype(np.uint64)
    found, value = [], np.zeros(len(codes), dtype=np.uint64)
    for order in range(1, 4):
        value = (value[: len(codes) - order + 1] * _STEP + codes[order - 1 :]) + np.uint64(order)
        found.append((value * _SPREAD) >> _SHIFT)
    return np.concatenate(found).astype(np.int64)


def counts(text: str | None) -> np.ndarray | None:
    features = grams(text)
    return None if features is None else np.bincount(features, minlength=BUCKETS)


def _frequency_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per feature and task; feature -1 counts the documents."""
    frequency, documents = np.zeros(BUCKETS, dtype=np.int64), 0
    for batch in batches:
        for text in batch.column("text"):
            found = grams(text.as_py())
            if found is not None:
                seen = np.zeros(BUCKETS, dtype=bool)
                seen[found] = True
                frequency += seen
                documents += 1
    some = np.flatnonzero(frequency)
    if documents:
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.append(some, -1)), pa.array(np.append(frequency[some], documents))], ["feature", "n"]
        )


def inverse_frequencies(training: DataFrame) -> np.ndarray:
    """log((1 + documents) / (1 + documents with the feature)) + 1 of every feature."""
    rows = small_batches(training.select("text")).mapInArrow(_frequency_rows, "feature long, n long")
    found = rows.groupBy("feature").agg(F.sum("n").alias("n")).toArrow()
    feature, n = found.column("feature").to_numpy(), found.column("n").to_numpy()
    frequency, documents = np.zeros(BUCKETS), int(n[feature < 0].sum())
    frequency[feature[feature >= 0]] = n[feature >= 0]
    return np.log((1 + documents) / (1 + frequency)) + 1


def tf_idf(count: np.ndarray, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Features and unit-length weights; the last feature is the constant 1."""
    at = np.flatnonzero(count)
    value = (1 + np.log(count[at])) * idf[at]
    value /= np.sqrt(value @ value)
    return np.append(at, BUCKETS), np.append(value, 1.0)


def _softmax(logits: np.ndarray) -> np.ndarray:
    shifted = np.exp(logits - logits.max(axis=-1, keepdims=True))
    return shifted / shifted.sum(axis=-1, keepdims=True)


class Ftrl:
    """Follow-the-regularised-leader, proximal form, for several classes."""

    def __init__(self, features: int, classes: int) -> None:
        self.z = np.zeros((features, classes))
        self.n = np.zeros((features, classes))

    def weights(self, at: np.ndarray) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        strength = (BETA + np.sqrt(n)) / ALPHA + L2
        return np.where(np.abs(z) <= L1, 0.0, (np.sign(z) * L1 - z) / strength)

    def learn(self, at: np.ndarray, value: np.ndarray, label: int) -> None:
        weights = self.weights(at)
        error = _softmax(value @ weights)
        error[label] -= 1
        slope = value[:, None] * error[None, :]
        n = self.n[at]
        change = (np.sqrt(n + slope * slope) - np.sqrt(n)) / ALPHA
        self.z[at] += slope - change * weights
        self.n[at] = n + slope * slope


@dataclass(frozen=True)
class LanguageModel:
    languages: list[str]
    idf: np.ndarray
    weights: np.ndarray
    temperature: float

    def predict(self, text: str | None) -> tuple[str, float]:
        found = counts(text) if self.languages else None
        if found is None:
            return UNKNOWN, 0.0
        at, value = tf_idf(found, self.idf)
        chance = _softmax((value @ self.weights[at]) / self.temperature)
        best = int(chance.argmax())
        return self.languages[best], float(chance[best])


def best_temperature(logits: np.ndarray, labels: np.ndarray) -> float:
    """The temperature of least log loss, on a logarithmic grid refined once."""
    if not len(labels):
        return 1.0

    def loss(t: float) -> float:
        chance = _softmax(logits / t)[np.arange(len(labels)), labels]
        return float(-np.log(np.maximum(chance, 1e-12)).mean())

    grid = np.geomspace(0.05, 20, 49)
    best = min(grid, key=loss)
    return float(min(np.geomspace(best / 1.14, best * 1.14, 25), key=loss))


def _sample_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for mark, lang, text in zip(*map(batch.column, ("mark", "lang", "text")), strict=True):
            found = counts(text.as_py())
            if found is not None:
                at = np.flatnonzero(found).astype(np.int32)
                n = found[at].astype(np.int32)
                columns = [pa.array([lang.as_py()]), pa.array([at], pa.list_(pa.int32())), pa.array([n], pa.list_(pa.int32()))]
                yield pa.RecordBatch.from_arrays([pa.array([mark.as_py()]), *columns], ["mark", "lang", "at", "n"])


def fit_sample(training: DataFrame, languages: int, rows: int = FIT_ROWS) -> DataFrame:
    """``mark, lang, at, n``: features of at most ``rows`` rows in all, as evenly over languages as there are rows.

    ``languages`` is at most half of ``rows``, which bounds the broadcast of one edge for each.
    """
    share = max(2, rows // max(languages, 1))
    marked = training.select("lang", F.xxhash64("id", "lang").alias("mark"))
    place = F.row_number().over(W.partitionBy("lang").orderBy("mark"))
    edges = marked.withColumn("n", place).filter(F.col("n") <= share).groupBy("lang").agg(F.max("mark").alias("edge"))
    edges = F.broadcast(edges.withColumnRenamed("lang", "e_lang").orderBy("e_lang").limit(max(languages, 1)))
    inside = training.withColumn("mark", F.xxhash64("id", "lang")).join(edges, F.col("lang") == F.col("e_lang"))
    inside = small_batches(inside.filter(F.col("mark") <= F.col("edge")).select("mark", "lang", "text"))
    return inside.mapInArrow(_sample_rows, "mark long, lang string, at array<int>, n array<int>").orderBy("mark", "lang").limit(rows)


def train(docs: DataFrame, is_training: Column, id_col: str, text_col: str, lang_col: str) -> LanguageModel:
    training = docs.filter(is_training & F.col(lang_col).isNotNull()).select(
        F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang")
    )
    idf = inverse_frequencies(training)
    known = training.groupBy("lang").count().orderBy("lang").limit(FIT_ROWS // 2).collect()
    sample = fit_sample(training, len(known)).toArrow()
    names = sorted({str(v) for v in sample.column("lang").to_pylist()})
    labels = np.array([names.index(v) for v in sample.column("lang").to_pylist()], dtype=np.int64)
    rows = []
    for at, n in zip(sample.column("at"), sample.column("n"), strict=True):
        count = np.zeros(BUCKETS, dtype=np.int64)
        count[at.values.to_numpy()] = n.values.to_numpy()
        rows.append(tf_idf(count, idf))
    model = Ftrl(BUCKETS + 1, max(1, len(names)))
    order = np.random.default_rng(42)
    teach = np.array([i for i in range(len(rows)) if i % 5], dtype=np.int64)
    for _ in range(EPOCHS):
        for i in order.permutation(teach):
            model.learn(*rows[i], int(labels[i]))
    weights = model.weights(np.arange(BUCKETS + 1))
    unseen = [i for i in range(0, len(rows), 5)]
    logits = np.array([rows[i][1] @ weights[rows[i][0]] for i in unseen]).reshape(len(unseen), weights.shape[1])
    return LanguageModel(names, idf, weights, best_temperature(logits, labels[unseen]))


def _predictions(model: LanguageModel):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [model.predict(t.as_py()) for t in batch.column("text")]
            columns = [pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())]
            yield pa.RecordBatch.from_arrays([batch.column("id"), *columns], ["id", "lang_pred", "score"])

    return run


def predict_languages(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang"
) -> DataFrame:
    """id, held_out, lang_pred and score of every row; rows that are held out teach nothing."""
    model = train(docs, ~held_out(F.col(id_col)), id_col, text_col, lang_col)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    found = small_batches(rows).mapInArrow(_predictions(model), "id long, lang_pred string, score double")
    return found.select(F.col("id").alias(id_col), held_out(F.col("id")).alias("held_out"), "lang_pred", "score")

"""Alignment of two tokenizers over the same text, by lockstep vectorised merging.

A is a byte-level tokenizer that sees a space and the text, B a piece tokenizer that adds the space itself. Both write the same bytes,
so every token ends at a byte offset. Offsets where tokens of both end are *cuts*; the tokens between two cuts are a *group*, and the
two tokens that end at a cut are *linked*. No token is empty (a vocabulary with an empty entry is refused), so
each cut links exactly one pair.

*Lockstep.* All documents of a batch move at once: one NumPy vector holds each document's pointer into A, another into B.
A step compares the offsets under all pointers, emits a cut where they are equal, moves the pointer that is behind (both at a cut),
and drops finished documents. Long documents are cut into lanes of about ``LANE`` tokens at offsets where both end, so
a step is wide and the number of steps doesn't follow the longest document.

*Counts.* Two linked tokens end together, so the bytes of one end with the bytes of the other: the pairs that can occur at all are known
from the vocabularies alone (a token has no more ends than bytes). Their corpus-wide counts are one vector of that fixed length.

Nulls: a NULL or empty text has no tokens; neither has a text that a tokenizer doesn't give back byte by byte (B writes U+2581 as a
space). Special tokens' strings are plain text. Equal ids and repeated rows are documents of their own.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import cached_property
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from sentencepiece import SentencePieceProcessor
from tiktoken import Encoding
from tokenizers import Tokenizer

from rowsmith.llm.common import releasing, saved, small_batches, worker_store
from rowsmith.llm.token_files import PIECES, _byte_letters

#: A tokens of a lane.
LANE = 256
#: A tokens after a lane's end at which it may be cut instead.
REACH = 16
#: Characters of the documents that move in lockstep; a longer document moves alone, in its lanes.
TOGETHER = 1 << 20
#: White space that is too long for the fast encoder of A.
LONG_SPACE = re.compile(r"\s{1000}")
#: Fixed value: how a piece shows a space.
PIECE_SPACE = "▁"

ALIGNED = "doc_id long, a_ids array<int>, b_ids array<int>, a_cuts array<int>, b_cuts array<int>"
DIGESTS = "doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs array<int>"


@dataclass(frozen=True)
class Vocabularies:
    """Both tokenizers and the bytes of their entries."""

    path_a: str
    path_b: str

    @cached_property
    def a(self) -> Tokenizer:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        tokenizer = Tokenizer.from_file(self.path_a)
        tokenizer.encode_special_tokens = True
        return tokenizer

    @cached_property
    def fast_a(self) -> Encoding:
        """A's vocabulary in an encoder that is several times faster; merges must be numbered in their order."""
        model = json.loads(Path(self.path_a).read_text(encoding="utf-8"))
        pairs = (m if isinstance(m, str) else " ".join(m) for m in model["model"]["merges"])
        made = [model["model"]["vocab"][m.replace(" ", "")] for m in pairs]
        if made != sorted(made) or model["normalizer"] or model["pre_tokenizer"]["type"] != "ByteLevel":
            raise ValueError(f"{self.path_a} is not a byte-level tokenizer with merges in order of their ids")
        special = set(self.a.get_added_tokens_decoder())
        ranks = {entry: i for i, entry in enumerate(self.bytes_a) if i not in special}
        return Encoding("a", pat_str=PIECES, mergeable_ranks=ranks, special_tokens={})

    @cached_property
    def b(self) -> SentencePieceProcessor:
        return SentencePieceProcessor(model_file=self.path_b)

    @cached_property
    def bytes_a(self) -> list[bytes]:
        shown = _byte_letters()
        letters = {shown.get(b, chr(b)): b for b in range(256)}
        entries = [b""] * self.a.get_vocab_size()
        for entry, token in self.a.get_vocab().items():
            known = all(c in letters for c in entry)
            entries[token] = bytes(letters[c] for c in entry) if known else entry.encode()
        return _checked(entries)

    @cached_property
    def bytes_b(self) -> list[bytes]:
        model = self.b
        pieces = [model.id_to_piece(i) for i in range(model.get_piece_size())]
        return _checked([
            bytes([int(p[3:5], 16)]) if model.is_byte(i) else p.replace(PIECE_SPACE, " ").encode() for i, p in enumerate(pieces)
        ])

    @cached_property
    def pairs(self) -> np.ndarray:
        """Sorted keys ``a << 32 | b`` of all pairs of which one's bytes end with the other's."""
        found = set()
        ids_a, ids_b = _ids_of(self.bytes_a), _ids_of(self.bytes_b)
        for long, short, flip in ((ids_a, ids_b, False), (ids_b, ids_a, True)):
            for token, ids in long.items():
                for at in range(len(token)):
                    for other in short.get(token[at:], ()):
                        found.update((other << 32 | i) if flip else (i << 32 | other) for i in ids)
        return np.sort(np.fromiter(found, np.int64, len(found)))

    def _ids_a(self, text: str) -> list[int]:
        # Its pattern takes a long run of white space on the stack.
        if LONG_SPACE.search(text):
            return self.a.encode(text, add_special_tokens=False).ids
        return self.fast_a.encode_ordinary(text)

    def encoded(self, texts: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
        """Ids of each text in both, empty where one doesn't give back the text's bytes."""
        none = np.zeros(0, dtype=np.int32)
        found = []
        for text, ids_b in zip(texts, self.b.encode(texts, num_threads=1), strict=True):
            spaced = " " + text
            ids_a, raw = self._ids_a(spaced), spaced.encode()
            same = text and all(
                b"".join(map(entries.__getitem__, ids)) == raw for entries, ids in ((self.bytes_a, ids_a), (self.bytes_b, ids_b))
            )
            found.append((np.array(ids_a, np.int32), np.array(ids_b, np.int32)) if same else (none, none))
        return found


def _checked(entries: list[bytes]) -> list[bytes]:
    if not all(entries):
        raise ValueError("a vocabulary has an entry without bytes")
    return entries


def _ids_of(entries: list[bytes]) -> dict[bytes, list[int]]:
    ids: dict[bytes, list[int]] = {}
    for token, entry in enumerate(entries):
        ids.setdefault(entry, []).append(token)
    return ids


def _vocabularies(path_a: str, path_b: str) -> Vocabularies:
    """One pair of vocabularies for the life of a worker."""
    store = worker_store(f"alignment {path_a} {path_b}")
    if not store:
        store["both"] = Vocabularies(path_a, path_b)
    return store["both"]


def _lanes(ends_a: np.ndarray, ends_b: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First tokens of the lanes in A and in B, and one past the last.

    ``ends`` grow over all documents, so an offset names a place in one of them; ``bounds`` are where documents end in A.
    """
    aims = np.arange(LANE, len(ends_a), LANE)
    near = np.minimum(aims[:, None] + np.arange(REACH), len(ends_a) - 1)
    offsets = ends_a[near]
    meets = ends_b[np.minimum(np.searchsorted(ends_b, offsets), len(ends_b) - 1)] == offsets
    cut = near[np.arange(len(aims)), meets.argmax(axis=1)][meets.any(axis=1)] + 1
    starts_a = np.unique(np.concatenate([[0], cut, bounds]))
    starts_b = np.concatenate([[0], np.searchsorted(ends_b, ends_a[starts_a[1:] - 1]) + 1])
    return starts_a, starts_b


def lockstep(ends_a: np.ndarray, ends_b: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places in A and in B of the tokens that end together, in order."""
    if not len(ends_a):
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    starts_a, starts_b = _lanes(ends_a, ends_b, bounds)
    at_a, at_b, last_a = starts_a[:-1].copy(), starts_b[:-1].copy(), starts_a[1:] - 1
    cuts_a, cuts_b = [], []
    while len(at_a):
        off_a, off_b = ends_a[at_a], ends_b[at_b]
        equal = off_a == off_b
        cuts_a.append(at_a[equal])
        cuts_b.append(at_b[equal])
        # Both ends of a lane are a cut, so a lane is finished when A's last token is one.
        going = ~(equal & (at_a == last_a))
        at_a += off_a <= off_b
        at_b += off_b <= off_a
        if not going.all():
            at_a, at_b, last_a = at_a[going], at_b[going], last_a[going]
    cuts_a, cuts_b = np.concatenate(cuts_a), np.concatenate(cuts_b)
    order = np.argsort(cuts_a)
    return cuts_a[order], cuts_b[order]


def align_texts(texts: list[str], both: Vocabularies) -> list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Per text: ids in A and B, and for each group the place behind its last token in A and in B."""
    found = both.encoded(texts)
    sizes_a, sizes_b = (np.array([len(f[k]) for f in found], dtype=np.int64) for k in (0, 1))
    ids_a, ids_b = (np.concatenate([np.zeros(0, np.int32), *[f[k] for f in found]]) for k in (0, 1))
    lengths_a, lengths_b = (np.fromiter(map(len, e), np.int64, len(e)) for e in (both.bytes_a, both.bytes_b))
    bounds_a, bounds_b = np.cumsum(sizes_a), np.cumsum(sizes_b)
    cuts_a, cuts_b = lockstep(np.cumsum(lengths_a[ids_a]), np.cumsum(lengths_b[ids_b]), np.unique(bounds_a[sizes_a > 0]))
    first = np.searchsorted(cuts_a, bounds_a - sizes_a)
    last = np.searchsorted(cuts_a, bounds_a)
    return [
        (*ids, cuts_a[i:j] + 1 - (end_a - n_a), cuts_b[i:j] + 1 - (end_b - n_b))
        for ids, i, j, end_a, n_a, end_b, n_b in zip(found, first, last, bounds_a, sizes_a, bounds_b, sizes_b, strict=True)
    ]


def _together(texts: list[str]) -> Iterator[tuple[int, int]]:
    """Spans of texts that move in lockstep."""
    start, size = 0, 0
    for at, text in enumerate(texts):
        if size and size + len(text) > TOGETHER:
            yield start, at
            start, size = at, 0
        size += len(text)
    yield start, len(texts)


def _aligned(batches: Iterator[pa.RecordBatch], both: Vocabularies) -> Iterator[tuple[pa.Array, list[tuple[np.ndarray, ...]]]]:
    """Ids of documents that move together, and what ``align_texts`` says of them."""
    for batch in batches:
        texts = [t or "" for t in batch.column("text").to_pylist()]
        for start, stop in _together(texts):
            yield batch.column("doc_id").slice(start, stop - start), align_texts(texts[start:stop], both)


def _align(path_a: str, path_b: str) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, rows in _aligned(batches, _vocabularies(path_a, path_b)):
            lists = [pa.array([r[k] for r in rows], pa.list_(pa.int32())) for k in range(4)]
            yield pa.RecordBatch.from_arrays([ids, *lists], ["doc_id", "a_ids", "b_ids", "a_cuts", "b_cuts"])

    return releasing(run)


def _texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    own = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    return small_batches(own, "4m")


def alignments(docs: DataFrame, path_a: str, path_b: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row ``a_ids, b_ids`` and, for each group, the place behind its last token in both (``a_cuts, b_cuts``).

    Group ``g`` is ``a_ids[a_cuts[g-1]:a_cuts[g]]`` beside ``b_ids[b_cuts[g-1]:b_cuts[g]]``; its last two tokens are linked.
    """
    rows = _texts(docs, id_col, text_col).mapInArrow(_align(path_a, path_b), ALIGNED)
    return rows.withColumnRenamed("doc_id", id_col)


def _written(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Decimal digits of 0 to n - 1 in rows with room for a mark, and how many each has."""
    width = len(str(n)) + 1
    shown = np.arange(n).astype(f"S{width}")
    return shown.view(np.uint8).reshape(n, width), np.char.str_len(shown)


def group_texts(rows: list[tuple[np.ndarray, ...]], written: tuple[np.ndarray, np.ndarray]) -> list[bytes]:
    """``a1,a2|b1;a3|b2,b3`` for each row of ids and cuts: the groups in order."""
    digits, lengths = written
    ids, marks, ends = [], [], []
    for a_ids, b_ids, a_cuts, b_cuts in rows:
        # A's tokens of a group come behind all earlier groups of B, B's behind A's tokens of the same group.
        a_sizes, b_sizes = np.diff(a_cuts, prepend=0), np.diff(b_cuts, prepend=0)
        a_at = np.arange(len(a_ids)) + np.repeat(b_cuts - b_sizes, a_sizes)
        b_at = np.arange(len(b_ids)) + np.repeat(a_cuts, b_sizes)
        both = np.empty(len(a_ids) + len(b_ids), dtype=np.int32)
        both[a_at], both[b_at] = a_ids, b_ids
        mark = np.full(len(both), ord(","), dtype=np.uint8)
        mark[a_cuts + (b_cuts - b_sizes) - 1] = ord("|")
        mark[b_cuts + a_cuts - 1] = ord(";")
        ids.append(both)
        marks.append(mark)
        ends.append(len(both))
    tokens = np.concatenate([np.zeros(0, np.int32), *ids])
    letters, sizes = digits[tokens], lengths[tokens]
    letters[np.arange(len(tokens)), sizes] = np.concatenate([np.zeros(0, np.uint8), *marks])
    flat = letters[letters > 0].tobytes()
    stops = np.concatenate([[0], np.cumsum(sizes + 1)])[np.cumsum([0, *ends])].tolist()
    # The last mark closes a group that nothing follows.
    return [flat[i : max(i, j - 1)] for i, j in zip(stops, stops[1:], strict=False)]


def _digest(path_a: str, path_b: str, keys) -> Callable:
    """Counts, digest and linked pairs of each alignment, in the task that makes it: ids and cuts need not travel."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both, pairs = _vocabularies(path_a, path_b), keys.value
        written = _written(max(len(both.bytes_a), len(both.bytes_b)))
        for ids, aligned in _aligned(batches, both):
            for at in range(0, len(aligned), 64):
                rows = aligned[at : at + 64]
                linked = [(a[i - 1].astype(np.int64) << 32) | b[j - 1] for a, b, i, j in rows]
                shas = [hashlib.sha256(t).hexdigest() if t else "" for t in group_texts(rows, written)]
                counts = [[len(r[0]) for r in rows], [len(r[1]) for r in rows], *[[len(r[2]) for r in rows]] * 2]
                places = pa.array([np.searchsorted(pairs, k).astype(np.int32) for k in linked], pa.list_(pa.int32()))
                kept = [ids.slice(at, 64), *[pa.array(c, pa.int64()) for c in counts], pa.array(shas), places]
                yield pa.RecordBatch.from_arrays(kept, ["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "pairs"])

    return releasing(run)


def _pair_counts(size: int) -> Callable:
    """How often each pair is linked in a task: one row per pair that is."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(size, dtype=np.int64)
        for batch in batches:
            counts += np.bincount(batch.column("pairs").flatten().to_numpy(), minlength=size)
        some = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(counts[some])], ["pair", "n"])

    return releasing(run)


def _scored(shared) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, best = shared.value
        for batch in batches:
            lists = batch.column("pairs")
            # Running totals at the ends of the lists, so that empty lists are no special case.
            ends = np.cumsum(np.concatenate([[0], lists.value_lengths().to_numpy()]))
            pairs = lists.flatten().to_numpy()
            sums = [np.diff(np.concatenate([[0], np.cumsum(v[pairs], dtype=np.int64)])[ends]) for v in (best, counts)]
            kept = [c for c in batch.schema.names if c != "pairs"]
            columns = [*[batch.column(c) for c in kept], *map(pa.array, sums)]
            yield pa.RecordBatch.from_arrays(columns, [*kept, "n_best", "count_sum"])

    return releasing(run)


def alignment_digests(docs: DataFrame, path_a: str, path_b: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row counts and a digest of its alignment, with the corpus-wide counts of its linked pairs."""
    context = docs.sparkSession.sparkContext
    keys = Vocabularies(path_a, path_b).pairs
    rows = _texts(docs, id_col, text_col).mapInArrow(_digest(path_a, path_b, context.broadcast(keys)), DIGESTS)
    rows = saved(rows, "digests")
    found = rows.select("pairs").mapInArrow(_pair_counts(len(keys)), "pair int, n long").groupBy("pair").agg(F.sum("n").alias("n"))
    # No more rows than pairs that the vocabularies allow.
    found = found.toArrow()
    counts = np.zeros(len(keys), dtype=np.int64)
    counts[found.column("pair").to_numpy()] = found.column("n").to_numpy()
    b_ids = keys & 0xFFFFFFFF
    highest = np.zeros(int(b_ids.max()) + 1, dtype=np.int64)
    np.maximum.at(highest, b_ids, counts)
    shared = context.broadcast((counts, counts == highest[b_ids]))
    schema = DIGESTS.replace("pairs array<int>", "n_best long, count_sum long")
    return rows.mapInArrow(_scored(shared), schema).withColumnRenamed("doc_id", id_col)

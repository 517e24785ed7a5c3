"""Token ids of documents in bit-plane files.

Documents are sorted by id over all partitions; the ids of each, followed by the end id, stand one behind
the other. Blocks of a fixed number of ids are turned into planes: plane ``k`` holds byte (or bit) ``k`` of every
id of the block, so each plane is far more even than the ids. Every plane is its own zstandard frame.

Layout of a folder: ``chunks`` has one row per block (part, chunk, n_ids, planes, and for each document in it its id,
where its ids start and how many) and ``index`` one row per block (part, chunk, first id of all, n_ids, bytes). They are Parquet so that Spark's commit protocol makes them whole or absent when an executor
is lost, on any file system Spark can write to; the planes themselves are not compressed again.

Nulls: a NULL text is empty, so it has the end id only; a NULL id sorts first. Rows of equal id follow each other
by text and stay documents of their own. An empty table gives no files but their schemas.
"""

from __future__ import annotations

import os
import string
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from rowsmith.llm.common import small_batches, worker_store
from rowsmith.session import scratch_folder

BLOCK = 1 << 16
LEVEL = 3
#: Words whose ids a worker keeps, and those that wait to be seen again.
KEPT_WORDS, YOUNG_WORDS = 350_000, 200_000

#: Fixed value: how byte-level tokenizers cut text before merging.
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def _byte_letters() -> dict[int, str]:
    """The letter that stands for each byte: itself where it prints, else the next one from 256 on."""
    prints = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in prints]
    return {b: chr(256 + k) for k, b in enumerate(rest)}


class WordIds(dict):
    """Ids of words behind a ``lead`` (a space or nothing), encoded when first asked for.

    A new word waits among the young ones; only if it is seen again before those are dropped is it kept, so memory
    holds the words that come back.
    """

    def __init__(self, tokenizer: Tokenizer, lead: str, bare: WordIds | None = None) -> None:
        super().__init__()
        self.tokenize, self.lead, self.young = tokenizer.model.tokenize, lead, {}
        self.bare = self if bare is None else bare
        self.letters, self.cut = _byte_letters(), regex.compile(PIECES).findall

    def __missing__(self, word: str) -> bytes:
        ids = self.young.pop(word, None)
        if ids is not None:
            if len(self) >= KEPT_WORDS:
                self.clear()
            self[word] = ids
            return ids
        stem = word.rstrip(string.punctuation)
        if not stem.isalpha():
            parts = self.cut(self.lead + word)
        elif stem is word:
            parts = [self.lead + word]
        else:
            parts = [self.lead + stem, word[len(stem) :]]
        if len(parts) == 1:
            ids = self._encoded(parts[0])
        else:
            ids = self[parts[0][len(self.lead) :]] + b"".join([self.bare[p] for p in parts[1:]])
        if len(self.young) >= YOUNG_WORDS:
            self.young.clear()
        self.young[word] = ids
        return ids

    def _encoded(self, piece: str) -> bytes:
        if piece.isascii() and piece[1:].isalpha():
            shown = piece.replace(" ", self.letters[32])
        else:
            shown = piece.encode().decode("latin-1").translate(self.letters)
        ids = [t.id for t in self.tokenize(shown)]
        return struct.pack(f"<{len(ids)}I", *ids)


#: White space that plain text doesn't have: all but the space and the line end.
OTHER_SPACES = [c for c in map(chr, range(0x3001)) if c.isspace() and c not in " \n"]
ASCII_SPACES = [c for c in OTHER_SPACES if c.isascii()]
RUNS = ("  ", " \n", "\n ", "\n\n")


class ByteTokenizer:
    """Ids of whole texts by a byte-level tokenizer, with a memory for words.

    Such a tokenizer merges inside pieces only, and no piece goes on over white space that follows something
    else. So a text is cut at each space and line end, ids of words known already are looked up, and the
    pieces of new words go to the tokenizer's model. Texts with other white space, with runs of it or with it at an end, or
    with special tokens are encoded in one go.
    """

    def __init__(self, path: str) -> None:
        store = worker_store(f"tokenizer {path}")
        if not store:
            os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
            tokenizer = Tokenizer.from_file(path)
            bare = WordIds(tokenizer, "")
            special = [t.content for t in tokenizer.get_added_tokens_decoder().values()]
            store.update(tokenizer=tokenizer, special=special, bare=bare, spaced=WordIds(tokenizer, " ", bare))
        self.tokenizer, self.special = store["tokenizer"], store["special"]
        self.bare, self.spaced = store["bare"], store["spaced"]
        self.line = self._whole("\n")

    def _whole(self, text: str) -> bytes:
        ids = self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids
        return np.array(ids, dtype="<u4").tobytes()

    def _is_plain(self, text: str) -> bool:
        if not text or text[0].isspace() or text[-1].isspace():
            return False
        others = ASCII_SPACES if text.isascii() else OTHER_SPACES
        return not any(c in text for group in (RUNS, others, self.special) for c in group)

    def encode(self, text: str) -> bytes:
        """The ids as little-endian unsigned 32-bit integers."""
        if not self._is_plain(text):
            return self._whole(text)
        look, done = self.spaced.__getitem__, []
        for line in text.split("\n"):
            first, *rest = line.split(" ")
            done.append(self.bare[first] + b"".join(map(look, rest)))
        return self.line.join(done)


def to_planes(ids: np.ndarray, bits: bool = False, level: int = LEVEL) -> list[bytes]:
    """Byte planes (4) or bit planes (32) of unsigned 32-bit ids, each compressed; zero planes stay tiny."""
    rows = ids.astype("<u4").view(np.uint8).reshape(-1, 4)
    if bits:
        rows = np.unpackbits(rows, axis=1, bitorder="little")
        planes = [np.packbits(rows[:, k], bitorder="little") for k in range(32)]
    else:
        planes = [np.ascontiguousarray(rows[:, k]) for k in range(4)]
    packer = zstandard.ZstdCompressor(level=level)
    return [packer.compress(p.tobytes()) for p in planes]


def from_planes(planes: list[bytes], n_ids: int) -> np.ndarray:
    opener = zstandard.ZstdDecompressor()
    raw = [np.frombuffer(opener.decompress(p), dtype=np.uint8) for p in planes]
    if len(raw) == 4:
        return np.ascontiguousarray(np.stack(raw, axis=1)).view("<u4").ravel()
    rows = np.stack([np.unpackbits(r, count=n_ids, bitorder="little") for r in raw], axis=1)
    return np.packbits(rows, axis=1, bitorder="little").view("<u4").ravel()


CHUNK_SCHEMA = (
    "part int, chunk int, n_ids int, planes array<binary>, "
    "pieces array<struct<seq:long, doc_id:long, at:int, n:int, piece:int>>"
)
INDEX_SCHEMA = "part int, chunk int, first long, n_ids int, bytes long"
_PIECE = pa.list_(pa.struct([("seq", pa.int64()), ("doc_id", pa.int64()), ("at", pa.int32()), ("n", pa.int32()), ("piece", pa.int32())]))


def _write_chunks(path: str, end_id: int, block: int, bits: bool, level: int):
    end = np.array([end_id], dtype="<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = ByteTokenizer(path)
        part = TaskContext.get().partitionId()
        held, size, pieces, chunk, seq = [], 0, [], 0, 0

        def flush() -> pa.RecordBatch:
            ids = np.frombuffer(b"".join(held), dtype="<u4")
            columns = [[part], [chunk], [len(ids)], [to_planes(ids, bits, level)], [list(pieces)]]
            kinds = [pa.int32(), pa.int32(), pa.int32(), pa.list_(pa.binary()), _PIECE]
            names = ["part", "chunk", "n_ids", "planes", "pieces"]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)

        rows = (row for batch in batches for row in zip(batch.column("id").to_pylist(), batch.column("text"), strict=True))
        for doc_id, text in rows:
            raw, piece = tokenizer.encode(text.as_py() or "") + end, 0
            while raw:
                now = raw[: 4 * (block - size)]
                pieces.append({"seq": seq, "doc_id": doc_id, "at": size, "n": len(now) // 4, "piece": piece})
                held.append(now)
                size += len(now) // 4
                raw, piece = raw[len(now) :], piece + 1
                if size == block:
                    yield flush()
                    held, size, pieces, chunk = [], 0, [], chunk + 1
            seq += 1
        if size:
            yield flush()

    return run


def write_token_files(
    docs: DataFrame,
    folder: str,
    tokenizer_path: str,
    end_id: int = 0,
    id_col: str = "doc_id",
    text_col: str = "text",
    block: int = BLOCK,
    bits: bool = False,
    level: int = LEVEL,
) -> None:
    """Write the ids of ``docs`` in ascending id order under ``folder``."""
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    # Sorted before encoding: sampling for the ranges reads ids, never tokenizes.
    ordered = rows.repartitionByRange("id").sortWithinPartitions("id", "text")
    chunks = small_batches(ordered).mapInArrow(_write_chunks(tokenizer_path, end_id, block, bits, level), CHUNK_SCHEMA)
    chunks.write.option("compression", "uncompressed").parquet(f"{folder}/chunks")
    spark = docs.sparkSession
    facts = spark.read.schema(CHUNK_SCHEMA).parquet(f"{folder}/chunks")
    sizes = F.aggregate("planes", F.lit(0).cast("long"), lambda total, p: total + F.octet_length(p))
    parts = facts.groupBy("part").agg(F.sum("n_ids").alias("ids"))
    before = F.coalesce(F.sum("ids").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    parts = parts.select("part", before.alias("part_first"))
    inside = W.partitionBy("part").orderBy("chunk").rowsBetween(W.unboundedPreceding, -1)
    index = facts.select("part", "chunk", "n_ids", sizes.alias("bytes"))
    index = index.withColumn("inside", F.coalesce(F.sum("n_ids").over(inside), F.lit(0))).join(parts, "part")
    index = index.select("part", "chunk", (F.col("part_first") + F.col("inside")).alias("first"), "n_ids", "bytes")
    index.write.parquet(f"{folder}/index")


def _read_pieces(of_ids, kind: pa.DataType):
    """Rows of document pieces; what ``of_ids`` makes of a piece's bytes is the last column."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = {"seq": pa.int64(), "doc_id": pa.int64(), "piece": pa.int32(), "at": pa.int32(), "n": pa.int32()}
        for batch in batches:
            for row in range(batch.num_rows):
                part, chunk, n_ids, planes, pieces = (batch.column(k)[row].as_py() for k in ("part", "chunk", "n_ids", "planes", "pieces"))
                raw = memoryview(from_planes(planes, n_ids).astype("<u4")).cast("B")
                for start in range(0, len(pieces), 4096):
                    some = pieces[start : start + 4096]
                    where = [pa.array([value] * len(some), pa.int32()) for value in (part, chunk)]
                    facts = [pa.array([p[name] for p in some], t) for name, t in kinds.items()]
                    made = pa.array([of_ids(raw[4 * p["at"] : 4 * (p["at"] + p["n"])]) for p in some], kind)
                    yield pa.RecordBatch.from_arrays([*where, *facts, made], ["part", "chunk", *kinds, "made"])

    return run


PIECE_SCHEMA = "part int, chunk int, seq long, doc_id long, piece int, at int, n int"


def _pieces(spark: SparkSession, folder: str, of_ids, kind: pa.DataType, made: str) -> DataFrame:
    chunks = small_batches(spark.read.schema(CHUNK_SCHEMA).parquet(f"{folder}/chunks"))
    return chunks.mapInArrow(_read_pieces(of_ids, kind), f"{PIECE_SCHEMA}, made {made}")


def read_pieces(spark: SparkSession, folder: str) -> DataFrame:
    """Every document's ids as they lie in the blocks: one row per document and block, ids as bytes."""
    return _pieces(spark, folder, bytes, pa.binary(), "binary").withColumnRenamed("made", "ids")


def read_token_files(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, start and ids (little-endian unsigned 32-bit) of every document."""
    first = spark.read.schema(INDEX_SCHEMA).parquet(f"{folder}/index").select("part", "chunk", "first")
    pieces = read_pieces(spark, folder).join(first, ["part", "chunk"])
    ordered = F.array_sort(F.collect_list(F.struct("piece", "ids")))
    docs = pieces.groupBy("part", "seq", "doc_id").agg(F.min(F.col("first") + F.col("at")).alias("start"), ordered.alias("p"))
    joined = F.aggregate("p", F.lit(b""), lambda done, p: F.concat(done, p["ids"]))
    return docs.select("doc_id", "start", joined.alias("ids"))


def _zero_operator(bit_count: int) -> list[int]:
    """The matrix over GF(2) that moves a CRC-32 past ``bit_count`` zero bits, by repeated squaring."""
    step = [0xEDB88320, *[1 << k for k in range(31)]]
    done = [1 << k for k in range(32)]
    while bit_count:
        if bit_count & 1:
            done = [_apply(step, column) for column in done]
        step = [_apply(step, column) for column in step]
        bit_count >>= 1
    return done


def _apply(matrix: list[int], value: int) -> int:
    total = 0
    for k in range(32):
        if value >> k & 1:
            total ^= matrix[k]
    return total


def crc_of_parts(parts: list[tuple[int, int]]) -> int:
    """CRC-32 of parts put together, from each part's own (crc, bytes)."""
    total = 0
    for crc, size in parts:
        total = _apply(_zero_operator(8 * size), total) ^ crc if total else crc
    return total


def _join_crcs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        done = [crc_of_parts([(p["crc"], 4 * p["n"]) for p in parts]) for parts in batch.column("p").to_pylist()]
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), batch.column("start"), batch.column("n_tokens"), pa.array(done, pa.int64())],
            ["doc_id", "start", "n_tokens", "ids_crc32"],
        )


def token_digests(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of every document, from the files.

    Blocks are opened where they are read; only a checksum and a length of each piece are shuffled, and the
    checksums of documents that lie in several blocks are put together from those.
    """
    first = spark.read.schema(INDEX_SCHEMA).parquet(f"{folder}/index").select("part", "chunk", "first")
    pieces = _pieces(spark, folder, zlib.crc32, pa.int64(), "long").withColumnRenamed("made", "crc")
    pieces = pieces.join(first, ["part", "chunk"])
    docs = pieces.groupBy("part", "seq", "doc_id").agg(
        F.min(F.col("first") + F.col("at")).alias("start"),
        F.sum(F.col("n").cast("long")).alias("n_tokens"),
        F.array_sort(F.collect_list(F.struct("piece", "crc", "n"))).alias("p"),
    )
    one = docs.filter(F.size("p") == 1).select("doc_id", "start", "n_tokens", F.col("p")[0]["crc"].alias("ids_crc32"))
    more = docs.filter(F.size("p") > 1).select("doc_id", "start", "n_tokens", "p")
    return one.unionByName(more.mapInArrow(_join_crcs, "doc_id long, start long, n_tokens long, ids_crc32 long"))


def encode_and_read(docs: DataFrame, tokenizer_path: str, end_id: int = 0, **options) -> DataFrame:
    """Write ``docs`` to a new folder of token files and return the digests read back from it."""
    spark = docs.sparkSession
    folder = scratch_folder(spark, "token-files")
    write_token_files(docs, folder, tokenizer_path, end_id, **options)
    return token_digests(spark, folder)

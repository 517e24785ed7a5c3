"""SimHash near-duplicates found by Golay-code fuzzy hashing.

Fingerprints of 64 bits are cut into three segments of 22, 21 and 21 bits. Two fingerprints that differ in
at most two bits have one segment without an error, and of the two others one with at most one. So every ordered
pair of segments gives keys: the whole first segment (its codeword index and syndrome together) and
each nearby Golay codeword index of the second. Fingerprints that share a key are compared.

Exact copies share a fingerprint and are one node. A key that more than ``BUCKET`` different
fingerprints share is not paired out; those fingerprints go the exact way for crowded places: each gives itself and its 64
one-bit neighbours as keys. All that share such a key are within two bits of each other, so each is linked
with the smallest of them. A key has 65 fingerprints at most. Both ways lose no link, and neither grows
with the square of a group.

Nulls and ties: a NULL or blank text has fingerprint zero and links like any other; fewer words than a shingle
are one shingle of all of them. Equal ids and repeated rows are kept as rows. A component is named by its smallest id.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rowsmith.llm import golay
from rowsmith.llm.common import releasing, row_copies, row_hash, saved, small_batches
from rowsmith.llm.components import components

SHINGLE = 3
SEED = 42
BITS = 64
DISTANCE = 2
#: (lowest bit, bits) of each segment.
SEGMENTS = ((0, 22), (22, 21), (43, 21))
#: Different fingerprints that are compared with each other under one key.
BUCKET = 64

_BIT_OF_BYTE = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.int64)
_PLACE = (np.arange(8, dtype=np.int64) * 256)[None, :]


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """Unsigned 64-bit SimHash of the shingles of words, ASCII letters in lower case."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    many = max(1, len(words) - shingle + 1)
    line = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = [0, *ends[: many - 1].tolist()]
    stops = (ends[min(shingle, len(words)) - 1 :] - 1).tolist()
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(line[a:b], SEED) for a, b in zip(starts, stops, strict=True)], dtype="<u8")
    # How often each byte stands at each of 8 places says how often each of 64 bits is set.
    seen = np.zeros(8 * 256, dtype=np.int64)
    for at in range(0, many, 1 << 16):
        part = hashes[at : at + (1 << 16)].view(np.uint8).reshape(-1, 8)
        seen += np.bincount((part + _PLACE).ravel(), minlength=8 * 256)
    counts = (seen.reshape(8, 256) @ _BIT_OF_BYTE).ravel()
    return int(np.packbits(2 * counts > many, bitorder="little").view("<u8")[0])


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        marks = np.array([fingerprint(t.as_py()) for t in batch.column("text")], dtype=np.uint64).view(np.int64)
        yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("hash"), pa.array(marks)], ["id", "hash", "fp"])


def fingerprint_rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id, content hash and fingerprint (as a signed long) of every row, written once."""
    rows = docs.select(
        F.col(id_col).cast("long").alias("id"), row_hash(docs).alias("hash"), F.col(text_col).cast("string").alias("text")
    )
    return saved(small_batches(rows).mapInArrow(releasing(_fingerprints), "id long, hash long, fp long"), "fingerprints")


def _segment_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, fp) for every ordered pair of segments and nearby index of the second."""
    for batch in batches:
        for at in range(0, batch.num_rows, 4096):
            signed = batch.column("fp").slice(at, 4096).to_numpy(zero_copy_only=False).astype(np.int64)
            word = signed.view(np.uint64)
            parts = [(word >> np.uint64(low) & np.uint64((1 << n) - 1)).astype(np.int64) for low, n in SEGMENTS]
            for second, (_, bits) in enumerate(SEGMENTS):
                near = golay.nearby_indices(parts[second], bits)
                row, column = np.nonzero(near >= 0)
                for first in range(len(SEGMENTS)):
                    if first == second:
                        continue
                    key = (first * 3 + second) << 34 | parts[first][row] << 12 | near[row, column]
                    yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(signed[row])], ["key", "fp"])


def fingerprint_links(marks: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """Links ``a, b`` that connect all different fingerprints (column ``fp``) within two bits of each other.

    The links have the components of all such pairs; in crowded places they are a star instead of all pairs.
    """
    keyed = saved(marks.select("fp").distinct().mapInArrow(releasing(_segment_keys), "key long, fp long"), "golay-keys")
    shared = keyed.groupBy("key").agg(F.count("*").alias("many")).filter("many > 1")
    hits = keyed.join(shared, "key")
    listed = hits.filter(F.col("many") <= bucket).groupBy("key").agg(F.sort_array(F.collect_list("fp")).alias("fps"))
    firsts = listed.select(F.posexplode("fps").alias("at", "a"), "fps")
    pairs = firsts.select("a", F.explode(F.slice("fps", F.col("at") + 2, F.size("fps"))).alias("b"))
    pairs = pairs.filter(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= DISTANCE)
    crowd = hits.filter(F.col("many") > bucket).select("fp").distinct()
    flips = F.array(F.lit(0).cast("long"), *[F.lit(1 << i if i < 63 else -(1 << 63)).cast("long") for i in range(BITS)])
    near = crowd.select("fp", F.explode(F.transform(flips, lambda bit: F.col("fp").bitwiseXOR(bit))).alias("near"))
    stars = near.groupBy("near").agg(F.collect_list("fp").alias("fps")).filter(F.size("fps") > 1)
    stars = stars.select(F.array_min("fps").alias("a"), F.explode("fps").alias("b")).filter("a != b")
    return pairs.unionAll(stars)


def _classes(rows: DataFrame) -> DataFrame:
    """``c_fp, component, keep_hash`` of every different fingerprint."""
    least = F.min(F.struct("id", "hash"))
    marks = saved(rows.groupBy("fp").agg(least.alias("least")), "marks")
    linked = components(fingerprint_links(marks), "a", "b")
    named = marks.join(linked, marks["fp"] == linked["node"], "left")
    named = saved(named.select("fp", F.coalesce("component", "fp").alias("root"), "least"), "classes")
    roots = named.groupBy(F.col("root").alias("r_root")).agg(F.min("least").alias("first"))
    return named.join(roots, named["root"] == roots["r_root"]).select(
        F.col("fp").alias("c_fp"), F.col("first.id").alias("component"), F.col("first.hash").alias("keep_hash")
    )


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, fingerprint (16 hexadecimal digits) and component_id of every row."""
    rows = fingerprint_rows(docs, id_col, text_col)
    classes = _classes(rows)
    joined = rows.join(classes, rows["fp"] == classes["c_fp"])
    return joined.select(
        F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("component").alias("component_id")
    )


def without_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` with one row of each component: that of the smallest id."""
    rows = fingerprint_rows(docs, id_col, text_col)
    keep = _classes(rows).select("component", "keep_hash").distinct()
    many = rows.groupBy("id", "hash").agg(F.count("*").alias("rows"))
    facts = many.join(keep, many["id"].eqNullSafe(keep["component"]) & (many["hash"] == keep["keep_hash"]))
    return row_copies(docs, id_col, facts.select("id", "hash", F.lit(1).cast("long").alias("copies"), "rows"))

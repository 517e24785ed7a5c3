"""Prefix trie of conversations by time-forward processing.

Conversations are rebuilt (``rebuilt``), and every different sequence of first turns is a node. A node's key is the XOR over its turns of a
128-bit hash of (place, role, text); keys of a conversation are running XORs, cut into chunks of turns, so a conversation that
holds a third of all rows is many tasks' work. Occurrences of a node are added up before they are shuffled.

*Shards.* The weight of a node is the number of turns its members have from it on: a bound on the nodes below it that needs no walk of
the trie. Nodes of more weight than a shard may have are the top; the largest subtrees without such a node are the shards.
*Time-forward processing.* The nodes of a shard are sorted by reverse level order (Spark's external sort), and each sends
its subtree totals forward to its parent through a priority queue in that order; the queue keeps ``held`` messages in memory and
spills sorted runs. Then the totals of the shard roots go to the top, where the same is done across them. At most
``TOP`` nodes of a level are in the top, at any size of the input.

Rows and ties: turns are ordered by ``turn``, NULL first, equal turns by a digest of role and text; NULL role or text is empty.
Rows without a ``conv_id`` belong to no conversation and are left out. Repeated rows are turns of their own. An empty table has no nodes, not even a root.
"""

from __future__ import annotations

import hashlib
import heapq
import tempfile
from collections.abc import Callable, Iterator
from typing import BinaryIO

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rowsmith.llm.common import releasing, saved
from rowsmith.operators.windows import BucketedWindow, row_number

#: Turns of a shard, while there are no more than ``TOP`` shards of that size.
SHARD = 50_000
TOP = 20_000
#: Messages a queue keeps in memory, and spilled runs before they are merged into one.
HELD = 200_000
RUNS = 64
#: Turns of a conversation whose keys are one task's work, and the bits of conv_id that share one string of ids.
CHUNK = 4096
ID_BITS = 16
#: How conversations share turns: blocks of ids begin with the first of them, fewer than ``SHARED`` turns of which are taken over.
BLOCK, SHARED = 5, 9

KEY = ("depth", "k1", "k2")
NODE = "s1 long, s2 long, depth long, k1 long, k2 long, q1 long, q2 long, conv_id long, n_convs long, own long"
TOTALS = f"{NODE}, n_children long, n_leaves long, saved_tokens long"


def _numbered(conversations: DataFrame) -> DataFrame:
    """``conv, at, digest, bytes``: the turns of each conversation, numbered from 1."""
    role, text = (F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")) for c in ("role", "text"))
    digest = F.md5(F.concat(F.char_length(role).cast("string"), F.lit(":"), role, text))
    turn = F.col("`turn`").cast("long")
    turns = conversations.filter("conv_id IS NOT NULL").select(
        F.col("`conv_id`").cast("long").alias("conv"), turn.isNotNull().alias("placed"), F.coalesce(turn, F.lit(0)).alias("place"),
        digest.alias("digest"), F.octet_length(text).cast("long").alias("bytes"),
    )
    numbered = row_number(BucketedWindow(turns, ["conv"], ["placed", "place", "digest"]), "at")
    return saved(numbered.select("conv", F.col("at").cast("long").alias("at"), "digest", "bytes"), "turns")


def rebuilt(conversations: DataFrame) -> DataFrame:
    """``conv, depth, digest, bytes, left`` of every rebuilt turn and, at depth 0, of every conversation.

    Conversation ``c`` gets the first ``h`` turns of ``c - c % 5`` before its own turns after its first ``h``, where ``h`` is
    crc32 of the decimal ``c`` modulo 9. ``left`` is the number of turns that follow.
    """
    turns = _numbered(conversations)
    shared = F.crc32(F.col("conv").cast("string").cast("binary")) % SHARED
    convs = turns.groupBy("conv").agg(F.count("*").alias("n")).withColumn("h", shared)
    convs = saved(convs.withColumn("base", F.col("conv") - F.col("conv") % BLOCK), "conversations")
    sizes = convs.select(F.col("conv").alias("b_conv"), F.col("n").alias("b_n"))
    taken = F.least("h", F.coalesce("b_n", F.lit(0))).alias("taken")
    convs = convs.join(sizes, F.col("base") == F.col("b_conv"), "left").select("conv", "n", "h", "base", taken)
    length = F.col("taken") + F.greatest(F.col("n") - F.col("h"), F.lit(0))
    convs = saved(convs.withColumn("length", length), "lengths")
    firsts = turns.filter(F.col("at") < SHARED).withColumnRenamed("conv", "t_conv")
    lent = convs.join(firsts, (F.col("base") == F.col("t_conv")) & (F.col("at") <= F.col("h"))).withColumn("depth", F.col("at"))
    own = turns.withColumnRenamed("conv", "t_conv").join(convs, (F.col("conv") == F.col("t_conv")) & (F.col("at") > F.col("h")))
    own = own.withColumn("depth", F.col("taken") + F.col("at") - F.col("h"))
    roots = convs.withColumns({"depth": F.lit(0).cast("long"), "digest": F.lit(""), "bytes": F.lit(0).cast("long")})
    left = (F.col("length") - F.col("depth")).alias("left")
    parts = [rows.select("conv", "depth", "digest", "bytes", left) for rows in (roots, lent, own)]
    return parts[0].unionAll(parts[1]).unionAll(parts[2])


def _occurrences(turns: DataFrame, chunk: int) -> DataFrame:
    """Each rebuilt turn with the key of its node (k1, k2) and of the parent (q1, q2); the root's is 0, 0."""
    marks = {f"x{i}": F.when(F.col("depth") == 0, F.lit(0).cast("long")).otherwise(F.xxhash64(F.lit(i), "depth", "digest")) for i in (1, 2)}
    cut = turns.withColumns(marks).withColumn("chunk", F.floor(F.col("depth") / chunk))
    inside = Window.partitionBy("conv", "chunk").orderBy("depth").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    local = cut.withColumns({f"l{i}": F.bit_xor(f"x{i}").over(inside) for i in (1, 2)})
    sums = cut.groupBy("conv", "chunk").agg(F.bit_xor("x1").alias("x1"), F.bit_xor("x2").alias("x2"))
    earlier = Window.partitionBy("conv").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    before = sums.select(
        F.col("conv").alias("b_conv"), F.col("chunk").alias("b_chunk"), *[F.bit_xor(f"x{i}").over(earlier).alias(f"b{i}") for i in (1, 2)]
    ).filter("b_chunk > 0")
    rows = local.join(before, (F.col("conv") == F.col("b_conv")) & (F.col("chunk") == F.col("b_chunk")), "left")
    key = {i: F.col(f"l{i}").bitwiseXOR(F.coalesce(f"b{i}", F.lit(0).cast("long"))) for i in (1, 2)}
    keys = [key[i].alias(f"k{i}") for i in (1, 2)] + [key[i].bitwiseXOR(F.col(f"x{i}")).alias(f"q{i}") for i in (1, 2)]
    return saved(rows.select("conv", "depth", *keys, "bytes", "left"), "occurrences")


class SpillingQueue:
    """Priority queue of tuples of six 64-bit integers; ``held`` of them stay in memory.

    A spilled run is an anonymous file of this task alone: nothing else reads it, it is gone with the task, and a
    repeated task writes its own, as with the runs of Spark's own sort.
    """

    WIDTH = 6

    def __init__(self, held: int) -> None:
        self.held, self.heap, self.heads, self.runs = held, [], [], []

    def push(self, item: tuple[int, ...]) -> None:
        heapq.heappush(self.heap, item)
        if len(self.heap) > self.held:
            self._spill(iter(sorted(self.heap)))
            self.heap = []
            if len(self.runs) > RUNS:
                rest, self.heads, self.runs = [heapq.merge([head], self.runs[at]) for head, at in self.heads], [], []
                self._spill(heapq.merge(*rest))

    def _spill(self, items: Iterator[tuple[int, ...]]) -> None:
        run = tempfile.TemporaryFile()  # noqa: SIM115 - closed with the last reference to it
        while part := [item for _, item in zip(range(4096), items, strict=False)]:
            run.write(np.array(part, dtype=np.int64).tobytes())
        run.seek(0)
        reader = self._read(run)
        heapq.heappush(self.heads, (next(reader), len(self.runs)))
        self.runs.append(reader)

    def _read(self, run: BinaryIO) -> Iterator[tuple[int, ...]]:
        with run:
            while raw := run.read(4096 * self.WIDTH * 8):
                yield from map(tuple, np.frombuffer(raw, dtype=np.int64).reshape(-1, self.WIDTH).tolist())

    def first(self) -> tuple[int, ...] | None:
        tops = [q[0] if q is self.heap else q[0][0] for q in (self.heap, self.heads) if q]
        return min(tops) if tops else None

    def pop(self) -> tuple[int, ...]:
        if not self.heads or (self.heap and self.heap[0] <= self.heads[0][0]):
            return heapq.heappop(self.heap)
        item, at = self.heads[0]
        following = next(self.runs[at], None)
        if following is None:
            heapq.heappop(self.heads)
        else:
            heapq.heapreplace(self.heads, (following, at))
        return item


def _forward(held: int) -> Callable:
    """Totals of each node's subtree; rows come shard by shard in reverse level order, their totals hold what came from elsewhere."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queue = SpillingQueue(held)
        names = ("s1", "s2", "depth", "k1", "k2", "q1", "q2", "own", "n_children", "n_leaves", "saved_tokens")
        for batch in batches:
            totals = []
            for s1, s2, depth, k1, k2, q1, q2, own, children, leaves, tokens in zip(
                *(batch.column(n).to_pylist() for n in names), strict=True
            ):
                here = (-depth, k1, k2)
                while (message := queue.first()) is not None and message[:3] == here:
                    _, _, _, more, some, many = queue.pop()
                    children, leaves, tokens = children + more, leaves + some, tokens + many
                leaves, tokens = leaves + (children == 0), tokens + own
                totals.append((children, leaves, tokens))
                if (k1, k2) != (s1, s2):
                    queue.push((1 - depth, q1, q2, 1, leaves, tokens))
            sums = [pa.array(c, pa.int64()) for c in zip(*totals, strict=True)] if totals else [pa.array([], pa.int64())] * 3
            kept = [n for n in batch.schema.names if n not in names[-3:]]
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in kept), *sums], [*kept, *names[-3:]])

    return releasing(run)


def _time_forward(nodes: DataFrame, held: int) -> DataFrame:
    """``nodes`` lie shard by shard in partitions."""
    ordered = nodes.sortWithinPartitions("s1", "s2", F.desc("depth"), "k1", "k2")
    names = [f.split()[0] for f in TOTALS.split(", ")]
    return ordered.select(*names).mapInArrow(_forward(held), TOTALS)


def _subtree_totals(occurrences: DataFrame, shard: int, held: int) -> DataFrame:
    """Every node with its totals."""
    same = [F.min(c).alias(c) for c in ("q1", "q2")]
    nodes = occurrences.groupBy(*KEY).agg(
        *same, F.min("conv").alias("conv_id"), F.count("*").alias("n_convs"), F.max("bytes").alias("bytes"), F.sum(F.col("left") + 1).alias("weight")
    )
    own = ((F.col("n_convs") - 1) * F.col("bytes")).alias("own")
    nodes = saved(nodes.select(*KEY, "q1", "q2", "conv_id", "n_convs", own, "weight"), "nodes")
    limit = max(shard, occurrences.count() // TOP)
    heavy = nodes.filter(F.col("weight") > limit)
    keys = heavy.select(*[F.col(c).alias(f"h_{c}") for c in KEY])
    on_path = occurrences.join(keys, [F.col(c) == F.col(f"h_{c}") for c in KEY], "left_semi")
    cuts = on_path.groupBy(F.col("conv").alias("c_conv")).agg((F.max("depth") + 1).alias("cut"))
    # The shard of a light node is the first light node on the way of any of its members.
    found = occurrences.join(cuts, F.col("conv") == F.col("c_conv"), "left").filter(F.col("depth") == F.coalesce("cut", F.lit(0)))
    found = found.select(F.col("conv").alias("c_conv"), F.col("k1").alias("s1"), F.col("k2").alias("s2"))
    none = {c: F.lit(0).cast("long") for c in ("n_children", "n_leaves", "saved_tokens")}
    light = nodes.filter(F.col("weight") <= limit).join(found, F.col("conv_id") == F.col("c_conv")).withColumns(none)
    light = saved(_time_forward(light.repartition("s1", "s2"), held), "light-nodes")
    sent = light.filter("k1 = s1 AND k2 = s2").groupBy((F.col("depth") - 1).alias("p_depth"), F.col("q1").alias("p1"), F.col("q2").alias("p2"))
    sent = sent.agg(F.count("*").alias("n_children"), F.sum("n_leaves").alias("n_leaves"), F.sum("saved_tokens").alias("saved_tokens"))
    match = (F.col("depth") == F.col("p_depth")) & (F.col("k1") == F.col("p1")) & (F.col("k2") == F.col("p2"))
    top = heavy.join(sent, match, "left").fillna(0, list(none)).withColumns({"s1": F.lit(0).cast("long"), "s2": F.lit(0).cast("long")})
    top = _time_forward(top.repartition(1), held)
    return saved(light.unionAll(top), "totals")


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One SHA-256 for each node, over strings of ids that come in order."""
    node, state = None, None

    def row() -> pa.RecordBatch:
        columns = [*[pa.array([v], pa.int64()) for v in node], pa.array([state.hexdigest()])]
        return pa.RecordBatch.from_arrays(columns, ["e_depth", "e_k1", "e_k2", "sha"])

    for batch in batches:
        for *key, ids in zip(*(batch.column(c).to_pylist() for c in (*KEY, "ids")), strict=True):
            if key != node:
                if node:
                    yield row()
                node, state = key, hashlib.sha256()
            else:
                state.update(b",")
            state.update(ids.encode())
    if node:
        yield row()


def _ends(occurrences: DataFrame) -> DataFrame:
    """For each node at which conversations end, the hash of their ids. A string holds ids that share their upper bits only."""
    ended = occurrences.filter("left = 0").groupBy(*KEY, F.shiftright("conv", ID_BITS).alias("span"))
    ids = F.array_join(F.transform(F.sort_array(F.collect_list("conv")), lambda c: c.cast("string")), ",")
    strings = ended.agg(ids.alias("ids")).repartition(*KEY).sortWithinPartitions(*KEY, "span")
    return strings.mapInArrow(releasing(_digest), "e_depth long, e_k1 long, e_k2 long, sha string")


def _equal(left: tuple[str, ...], right: tuple[str, ...]) -> Column:
    both = [F.col(a) == F.col(b) for a, b in zip(left, right, strict=True)]
    return both[0] & both[1] & both[2]


def prefix_trie(conversations: DataFrame, shard: int = SHARD, held: int = HELD, chunk: int = CHUNK) -> DataFrame:
    """One row per node of the trie of rebuilt conversations; no result depends on the limits.

    ``conv_id`` is the smallest member, ``n_leaves`` counts childless nodes and ``saved_tokens`` bytes of turns that other members repeat,
    both over the node's subtree; ``ends_sha256`` names the conversations that end here.
    """
    occurrences = _occurrences(rebuilt(conversations), chunk)
    totals = _subtree_totals(occurrences, shard, held)
    parents = totals.select((F.col("depth") + 1).alias("p_depth"), F.col("k1").alias("p1"), F.col("k2").alias("p2"), F.col("conv_id").alias("parent_conv_id"))
    rows = totals.join(parents, _equal(("depth", "q1", "q2"), ("p_depth", "p1", "p2")), "left")
    rows = rows.join(_ends(occurrences), _equal(KEY, ("e_depth", "e_k1", "e_k2")), "left")
    none = hashlib.sha256(b"").hexdigest()
    columns = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens")
    return rows.select(*columns, F.coalesce("sha", F.lit(none)).alias("ends_sha256"))

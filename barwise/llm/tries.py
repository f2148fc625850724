"""Operator 12: prefix trie of conversations, as double-array tries of prefix shards.

A conversation is a path of turns; equal paths are put together first.  The distinct paths are dealt
out in lexicographic ranges, so a shard holds a contiguous part of the trie: only the prefixes of its
first and last path can be nodes of other shards too.  A shard numbers its own turns densely and packs
its nodes into two arrays: the child of state s by turn c is ``t = BASE[s] + c`` if ``CHECK[t] = s``.  Walking all
paths through the arrays gives every node's sums.  The few nodes on shard borders are merged over all
shards; what shards counted twice below them is taken off by pointer doubling, in a number of rounds
that grows with the logarithm of their depth.

A shared first turn, a hot prefix or thousands of equal conversations load no task more than others.
The turns of *one* conversation (16 bytes of digest and a word count each) pass one task.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barwise.llm.common import prepare, table, written

#: Turns of one shard's paths (a longer path is a shard of its own).
SHARD_TURNS = 1 << 17
#: conv_ids joined into one text before they are hashed.
IDS_TOGETHER = 1_000
#: Hex digits of a turn's digest.
WIDE = 32
#: A word: anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


# ---------------------------------------------------------------- one shard

class DoubleArray:
    """BASE and CHECK of the trie of lexicographically sorted, distinct paths of dense ids.

    State 0 is the root.  ``BASE`` may be negative; a state without children has none.
    """

    def __init__(self, ids: np.ndarray, lengths: np.ndarray):
        self.alphabet = int(ids.max()) + 1 if len(ids) else 0
        size = 2 * len(ids) + self.alphabet + 2
        self.base = np.zeros(size, np.int64)
        self.check = np.full(size, -1, np.int64)
        self.check[0] = 0                       # the root is its own parent
        self.free = 1                           # no free slot lies before this one
        self.top = 1                            # no used slot lies here or after
        starts = np.cumsum(lengths) - lengths
        state = np.zeros(len(lengths), np.int64)
        rows = np.flatnonzero(lengths > 0)
        depth = 0
        while len(rows):
            parent, turn = state[rows], ids[starts[rows] + depth]
            new = np.ones(len(rows), bool)      # rows are sorted: a node's rows stand together
            new[1:] = (parent[1:] != parent[:-1]) | (turn[1:] != turn[:-1])
            slots = self._place(parent[new], turn[new])
            state[rows] = slots[np.cumsum(new) - 1]
            depth += 1
            rows = rows[lengths[rows] > depth]
        self.base, self.check = self.base[:self.top].copy(), self.check[:self.top].copy()

    def _grow(self, size: int) -> None:
        if size > len(self.check):
            more = max(size, 2 * len(self.check)) - len(self.check)
            self.base = np.concatenate([self.base, np.zeros(more, np.int64)])
            self.check = np.concatenate([self.check, np.full(more, -1, np.int64)])

    def _free_slots(self, n: int) -> np.ndarray:
        """The first ``n`` free slots."""
        found, at, have = [], self.free, 0
        while have < n:
            self._grow(at + 2 * n + 64)
            some = at + np.flatnonzero(self.check[at:at + 2 * n + 64] < 0)
            found.append(some)
            have += len(some)
            at += 2 * n + 64
        return np.concatenate(found)[:n]

    def _place(self, parent: np.ndarray, turn: np.ndarray) -> np.ndarray:
        """Slots for the children (parent, turn), sorted by parent's place and turn; sets BASE and CHECK."""
        first = np.flatnonzero(np.append(True, parent[1:] != parent[:-1]))
        count = np.diff(np.append(first, len(parent)))
        slots = np.empty(len(parent), np.int64)
        for k in np.flatnonzero(count > 1).tolist():
            some = turn[first[k]:first[k] + count[k]]
            gaps = some - some[0]
            for slot in self._free_slots(16).tolist():
                self._grow(slot + int(gaps[-1]) + 1)
                if (self.check[slot + gaps] < 0).all():
                    break
            else:
                slot = max(self.top, self.free)
            self._grow(slot + int(gaps[-1]) + 1)
            slots[first[k]:first[k] + count[k]] = slot + gaps
            self.check[slot + gaps] = parent[first[k]]
            self.top = max(self.top, slot + int(gaps[-1]) + 1)
            self._advance()
        single = first[count == 1]              # a child alone fits any free slot
        if len(single):
            slots[single] = self._free_slots(len(single))
            self.check[slots[single]] = parent[single]
            self.top = max(self.top, int(slots[single].max()) + 1)
            self._advance()
        self.base[parent[first]] = slots[first] - turn[first]
        return slots

    def _advance(self) -> None:
        while self.free < len(self.check) and self.check[self.free] >= 0:
            ahead = np.flatnonzero(self.check[self.free:self.free + 4096] < 0)
            if len(ahead):
                self.free += int(ahead[0])
                return
            self.free += 4096
        self.free = min(self.free, len(self.check))

    def step(self, states: np.ndarray, turns: np.ndarray) -> np.ndarray:
        """The children of states by turns, -1 where there is none."""
        to = self.base[states] + turns
        inside = (to > 0) & (to < len(self.check))
        to = np.where(inside, to, 0)
        return np.where(inside & (self.check[to] == states), to, -1)


@dataclass
class Shard:
    """Distinct paths of one shard: dense turn ids, and the arrays over them."""

    turns: np.ndarray          # digests in the order of their ids
    ids: np.ndarray
    lengths: np.ndarray
    trie: DoubleArray

    @classmethod
    def of(cls, paths: list[bytes]) -> Shard:
        lengths = np.array([len(p) // WIDE for p in paths], np.int64)
        turns, ids = np.unique(np.frombuffer(b"".join(paths), f"S{WIDE}"), return_inverse=True)
        return cls(turns, ids.astype(np.int64), lengths, DoubleArray(ids.astype(np.int64), lengths))

    def walk(self) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Level by level: rows that reach it, their turns, and the states that they are in."""
        starts = np.cumsum(self.lengths) - self.lengths
        states = np.zeros(len(self.lengths), np.int64)
        rows, depth = np.flatnonzero(self.lengths > 0), 0
        while len(rows):
            turns = self.ids[starts[rows] + depth]
            states[rows] = self.trie.step(states[rows], turns)
            if (states[rows] < 0).any():
                raise AssertionError("a path left the trie")
            yield rows, turns, states[rows]
            depth += 1
            rows = rows[self.lengths[rows] > depth]


NODES = ("shard long, key string, parent_key string, depth long, conv_id long, parent_conv_id long, n_convs long, "
         "n_children long, n_leaves long, all_words long, node_words long, words long, leaf long, ends_sha256 string")


def _keys(path: bytes) -> list[str]:
    """A name for every prefix of a path, the empty one first."""
    out, digest = [""], b""
    for k in range(0, len(path), WIDE):
        digest = hashlib.blake2b(digest + path[k:k + WIDE], digest_size=16).digest()
        out.append(digest.hex())
    return out


def shard_nodes(shard_id: int, paths: list[bytes], words: np.ndarray, count: np.ndarray, conv: np.ndarray,
                ends: list[str]) -> pa.RecordBatch:
    """The nodes of one shard (``NODES``).  Nodes that other shards may hold too have a ``key``;
    ``all_words`` and ``node_words`` are sums over the subtree, of the last turn's words for every member and once a node."""
    shard = Shard.of(paths)
    size = len(shard.trie.check)
    n_convs, least = np.zeros(size, np.int64), np.full(size, np.iinfo(np.int64).max)
    own, depth, end = np.zeros(size, np.int64), np.zeros(size, np.int64), np.full(size, -1, np.int64)
    n_convs[0], least[0] = count.sum(), conv.min()
    end[0] = 0 if shard.lengths[0] == 0 else -1            # the empty path sorts first
    words_of = np.zeros(len(shard.turns), np.int64)
    words_of[shard.ids] = words
    levels, track = [np.zeros(1, np.int64)], {0: [0], len(paths) - 1: [0]}
    for rows, turns, states in shard.walk():
        np.add.at(n_convs, states, count[rows])
        np.minimum.at(least, states, conv[rows])
        own[states], depth[states] = words_of[turns], len(levels)
        last = shard.lengths[rows] == len(levels)
        end[states[last]] = rows[last]
        for row in track:
            at = np.searchsorted(rows, row)
            if at < len(rows) and rows[at] == row:
                track[row].append(int(states[at]))
        levels.append(np.unique(states))
    parent = shard.trie.check
    children, leaves = np.zeros(size, np.int64), np.zeros(size, np.int64)
    all_words, node_words = n_convs * own, own.copy()
    for states in reversed(levels[1:]):
        leaves[states] += children[states] == 0
        up = parent[states]
        for total, add in ((children, np.ones(len(up), np.int64)), (leaves, leaves[states]),
                           (all_words, all_words[states]), (node_words, node_words[states])):
            np.add.at(total, up, add)
    leaves[0] += children[0] == 0
    key = dict(x for row, states in track.items() for x in zip(states, _keys(paths[row])))
    nodes = np.concatenate(levels)
    names = [key.get(s) for s in nodes.tolist()]
    up = parent[nodes]
    columns = [np.full(len(nodes), shard_id), names, [key.get(p) if s else None for s, p in zip(nodes.tolist(), up.tolist())],
               depth[nodes], least[nodes], pa.array(least[up], mask=nodes == 0), n_convs[nodes], children[nodes], leaves[nodes],
               all_words[nodes], node_words[nodes], own[nodes], (children[nodes] == 0).astype(np.int64),
               [ends[e] if e >= 0 else None for e in end[nodes].tolist()]]
    kinds = [pa.string() if f.endswith("string") else pa.int64() for f in NODES.split(", ")]
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, t) for c, t in zip(columns, kinds)],
                                      names=[f.split()[0] for f in NODES.split(", ")])


# ---------------------------------------------------------------- Spark side

def paths_of(turns: DataFrame) -> DataFrame:
    """``conv_id, path, words`` of every conversation of ``turns (conv_id, turn, role, text)``.

    Turns in order (null first; equal numbers by role, then by digest); null role and text are
    empty, repeated rows are turns of their own.  Rows without a conv_id belong to no conversation.
    """
    own = (turns.filter("conv_id is not null")
           .select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
                   *[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("role", "text")]))
    one = F.struct(F.col("turn").isNotNull().alias("known"), F.coalesce("turn", F.lit(0)).alias("turn"), "role",
                   F.md5(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text")).alias("digest"),
                   F.regexp_count("text", F.lit(WORD)).cast("long").alias("words"))
    return own.groupBy("conv_id").agg(F.sort_array(F.collect_list(one)).alias("turns")) \
        .select("conv_id", F.transform("turns", lambda t: F.struct(t["digest"].alias("digest"), t["words"].alias("words"))).alias("path"))


def rebuilt(paths: DataFrame, group: int = 20, most: int = 3) -> DataFrame:
    """Conversations as they are after a common beginning: the first h turns are those of
    conversation ``conv_id - conv_id % group``, h = crc32(conv_id as text) % (most + 1)."""
    heads = paths.filter(F.col("conv_id") % group == 0).select(F.col("conv_id").alias("base"), F.slice("path", 1, most).alias("head"))
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % (most + 1)).cast("int")
    none = F.slice("path", 1, F.lit(0))
    return (paths.withColumn("base", F.col("conv_id") - F.col("conv_id") % group).join(heads, "base", "left")
            .select("conv_id", F.concat(F.slice(F.coalesce("head", none), F.lit(1), h),
                                        F.slice("path", h + 1, F.size("path"))).alias("path")))


def _ends(paths: DataFrame) -> DataFrame:
    """``(whole, conv_id, n, ends_sha256)`` of every distinct path: its least conversation, their number
    and the digest of their ids.  Ids are joined in ranges first, so that a group of any size is a
    short stream of texts for the one task that must hash it in order."""
    def join(batches):
        held, key = [], None

        def out():
            return pa.RecordBatch.from_arrays([pa.array([key]), pa.array([held[0]], pa.int64()), pa.array([len(held)], pa.int64()),
                                               pa.array([",".join(map(str, held))])], names=["whole", "conv_id", "n", "ids"])

        ready = []
        for batch in batches:
            for whole, conv in zip(batch.column("whole").to_pylist(), batch.column("conv_id").to_pylist()):
                if held and (whole != key or len(held) >= IDS_TOGETHER):
                    ready.append(out())
                    held = []
                key = whole
                held.append(conv)
            if ready:
                yield from pa.Table.from_batches(ready).combine_chunks().to_batches()
                ready = []
        if held:
            yield out()

    def digest(batches):
        key, sha, least, n = None, None, 0, 0
        names = ["whole", "conv_id", "n", "ends_sha256"]
        for batch in batches:
            rows = []
            for whole, conv, m, ids in zip(*(batch.column(c).to_pylist() for c in ("whole", "conv_id", "n", "ids"))):
                if whole != key:
                    if key is not None:
                        rows.append((key, least, n, sha.hexdigest()))
                    key, sha, least, n = whole, hashlib.sha256(ids.encode()), conv, m
                else:
                    sha.update(b"," + ids.encode())
                    n += m
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows)], names=names)
        if key is not None:
            yield pa.RecordBatch.from_arrays([pa.array([key]), pa.array([least]), pa.array([n]), pa.array([sha.hexdigest()])], names=names)

    joined = (paths.select("whole", "conv_id").repartitionByRange("whole", "conv_id").sortWithinPartitions("whole", "conv_id")
              .mapInArrow(join, "whole string, conv_id long, n long, ids string"))
    return (joined.repartition("whole").sortWithinPartitions("whole", "conv_id")
            .mapInArrow(digest, "whole string, conv_id long, n long, ends_sha256 string"))


def distinct_paths(spark: SparkSession, paths: DataFrame) -> DataFrame:
    """``path`` (digests one after the other), ``words``, ``conv_id``, ``n``, ``ends_sha256`` of every distinct path."""
    flat = paths.select("conv_id", F.array_join(F.transform("path", lambda t: t["digest"]), "").alias("path"),
                        F.transform("path", lambda t: t["words"]).alias("words"))
    flat = written(spark, flat.withColumn("whole", F.md5("path")), "conversation-paths")
    return _ends(flat).drop("whole").join(flat.drop("whole"), "conv_id")


def _shards(distinct: DataFrame, make, schema: str) -> DataFrame:
    """``make(shard id, paths, words, n, conv_id, ends)`` for every shard of the sorted paths."""
    def run(batches):
        part, k, held, size = TaskContext.get().partitionId(), 0, [], 0

        def out():
            path, words, n, conv, ends = zip(*held)
            return make((part << 32) + k, [p.encode() for p in path], np.array([w for ws in words for w in ws], np.int64),
                        np.array(n, np.int64), np.array(conv, np.int64), list(ends))

        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in ("path", "words", "n", "conv_id", "ends_sha256"))):
                if held and size + len(row[1]) > SHARD_TURNS:
                    yield out()
                    k, held, size = k + 1, [], 0
                held.append(row)
                size += len(row[1])
        if held:
            yield out()

    return (distinct.select("path", "words", "n", "conv_id", "ends_sha256").repartitionByRange("path")
            .sortWithinPartitions("path").mapInArrow(run, schema))


def packed_tries(distinct: DataFrame) -> DataFrame:
    """The shards' double arrays as rows: ``shard``, ``first`` and ``last`` path, ``turns`` (digests in
    the order of their dense ids), ``base`` and ``check`` (little-endian 64-bit); :func:`find` reads them."""
    def make(shard_id, paths, *_):
        s = Shard.of(paths)
        cells = (shard_id, paths[0].decode(), paths[-1].decode(), b"".join(s.turns.tolist()),
                 s.trie.base.astype("<i8").tobytes(), s.trie.check.astype("<i8").tobytes())
        return pa.RecordBatch.from_arrays([pa.array([c]) for c in cells], names=["shard", "first", "last", "turns", "base", "check"])

    return _shards(distinct, make, "shard long, first string, last string, turns binary, base binary, check binary")


def find(packed, path: str) -> int:
    """The state of a prefix (its digests joined) in one row of ``packed_tries``, or -1."""
    turns = np.frombuffer(bytes(packed["turns"]), f"S{WIDE}")
    base, check = (np.frombuffer(bytes(packed[c]), "<i8") for c in ("base", "check"))
    state = 0
    for k in range(0, len(path), WIDE):
        turn = int(np.searchsorted(turns, path[k:k + WIDE].encode()))
        to = base[state] + turn
        if turn == len(turns) or turns[turn] != path[k:k + WIDE].encode() or not 0 < to < len(check) or check[to] != state:
            return -1
        state = int(to)
    return state


def _below(spark: SparkSession, shared: DataFrame, deepest: int) -> DataFrame:
    """``key`` and the sums of ``words`` and ``leaf`` over its subtree, for a tree of rows ``(key, up, words, leaf)``.
    In round k every node adds its sum to the node 2^k levels up, then points twice as far."""
    for _ in range(deepest.bit_length()):
        add = shared.filter("up is not null").groupBy(F.col("up").alias("key")).agg(
            F.sum("words").alias("more_words"), F.sum("leaf").alias("more_leaf"))
        far = shared.select(F.col("key").alias("up"), F.col("up").alias("far"))
        shared = written(spark, shared.join(add, "key", "left").join(far, "up", "left").select(
            "key", F.col("far").alias("up"), (F.col("words") + F.coalesce("more_words", F.lit(0))).alias("words"),
            (F.col("leaf") + F.coalesce("more_leaf", F.lit(0))).alias("leaf")), "trie-below")
    return shared.select("key", F.col("words").alias("twice_words"), F.col("leaf").alias("twice_leaves"))


def prefix_nodes(spark: SparkSession, paths: DataFrame) -> DataFrame:
    """Every node of the trie of ``paths (conv_id, path array<struct<digest, words>>)``.

    ``conv_id`` (least member), ``depth``, ``parent_conv_id``, ``n_convs``, ``n_children``, ``n_leaves``, ``saved_tokens``
    and ``ends_sha256``; a node's last turn is turn ``depth`` of ``conv_id``.  No paths give no nodes, not
    even a root; a path without turns ends at the root.
    """
    nodes = written(spark, _shards(distinct_paths(spark, paths), shard_nodes, NODES), "trie-nodes")
    border = nodes.filter("key is not null")
    merged = written(spark, border.groupBy("key").agg(
        F.count("*").alias("shards"), F.max("parent_key").alias("parent_key"), F.max("depth").alias("depth"),
        F.min("conv_id").alias("conv_id"), F.max("words").alias("words"), F.sum("leaf").alias("leaf"), F.max("ends_sha256").alias("ends_sha256"),
        *[F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "all_words", "node_words")]), "trie-border")
    # what shards counted of one node more than once, at the node and (children) at its parent
    twice = merged.filter("shards > 1")
    deepest = twice.agg(F.max("depth")).first()[0] or 0
    below = _below(spark, twice.select(
        "key", F.col("parent_key").alias("up"), ((F.col("shards") - 1) * F.col("words")).alias("words"),
        (F.col("leaf") - F.when(F.col("n_children") == 0, 1).otherwise(0)).alias("leaf")), deepest)
    again = twice.filter("parent_key is not null").groupBy(F.col("parent_key").alias("key")).agg(F.sum(F.col("shards") - 1).alias("again"))
    known = merged.select(F.col("key").alias("parent_key"), F.col("conv_id").alias("parent_conv_id"))
    zero = F.lit(0)
    upper = (merged.join(below, "key", "left").join(again, "key", "left").join(known, "parent_key", "left").select(
        "conv_id", "depth", "parent_conv_id", "n_convs", (F.col("n_children") - F.coalesce("again", zero)).alias("n_children"),
        (F.col("n_leaves") - F.coalesce("twice_leaves", zero)).alias("n_leaves"),
        (F.col("all_words") - F.col("node_words") + F.coalesce("twice_words", zero)).alias("saved_tokens"), "ends_sha256"))
    # a border node's members may be in other shards too: its children here ask for its least member, shard by shard
    inner = nodes.filter("key is null")
    asked = border.select("shard", F.col("key").alias("parent_key")).join(known.withColumnRenamed("parent_conv_id", "found"), "parent_key")
    lower = (inner.filter("parent_key is not null").join(asked, ["shard", "parent_key"])
             .withColumn("parent_conv_id", F.col("found")).select(*nodes.columns)
             .unionAll(inner.filter("parent_key is null").select(*nodes.columns))
             .select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves",
                     (F.col("all_words") - F.col("node_words")).alias("saved_tokens"), "ends_sha256"))
    return lower.unionAll(upper).withColumn("ends_sha256", F.coalesce("ends_sha256", F.lit(hashlib.sha256().hexdigest())))


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes of the trie of all rebuilt ``conversations``; odd rows as in ``paths_of`` and ``prefix_nodes``."""
    prepare(spark)
    return prefix_nodes(spark, rebuilt(paths_of(table(spark, sf_dir, "conversations"))))

"""Prefix trie of conversations by union-find over the longest common prefixes of sorted neighbours.

A turn becomes a unit of 24 bytes: 16 of the SHA-256 of its role and text, 8 of its code points; a conversation is its units in order.
Equal conversations are first counted together, so that a hot one is one sequence. The distinct sequences are range-partitioned and
sorted, and a task joins neighbours by union-find, edges of the longest common prefix first: every merge of components creates the branching
node at that depth (or hangs on the node that ends there). Nodes between two branchings have the members of the one below and
are written out on the way.

A task works through its sorted run in windows of bounded size, each a forest of its own. Nodes that hold neither the first nor the
last sequence of their window are final. The others, the prefixes of those two sequences, are all that is left of a contracted window; they
are merged across window boundaries in order, in one task that reads two paths a window and holds one path.

The digest of the members that end at a node is one running hash over their ids in order, which no parallel sum can replace: ids are
brought into sorted strings of at most ``2 ** BUCKET_BITS`` ids first, and one task per sequence hashes these strings one after the other.

Cases: rows without conv_id are no conversation's; a null role or text is empty; a null turn comes first, and rows of equal turn
follow the digest of their role and text; repeated rows are turns of their own. Conversations without turns are members of the root
alone. An empty table gives an empty result; other columns are ignored. What one task must hold is one conversation's units.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, functions as F

from tallyline.llm.common import BROADCAST_ROWS, materialise

UNIT = 24
WINDOW_ROWS, WINDOW_BYTES = 65_536, 32 << 20
BUCKET_BITS = 16
#: Turns that a conversation may take over, and the ids that share one origin.
HEADS, FAMILY = 6, 100
NO_ENDS = sha256(b"").hexdigest()

GROUPED = "seq_key string, n bigint, conv bigint, ends string"
FOREST = ("spine boolean, part bigint, slot bigint, behind boolean, unit binary, key binary, depth bigint, conv_id bigint, parent_conv_id bigint, "
          "n_convs bigint, n_children bigint, n_leaves bigint, saved_tokens bigint, ends_sha256 string")
MERGED = "key binary, parent_key binary, depth bigint, conv_id bigint, n_convs bigint, n_children bigint, n_leaves bigint, saved_tokens bigint, ends_sha256 string"
ARROW = {"boolean": pa.bool_(), "bigint": pa.int64(), "binary": pa.binary(), "string": pa.string()}


def _batches(rows: Iterator[tuple], schema: str, size: int = 4096) -> Iterator[pa.RecordBatch]:
    names, kinds = zip(*[c.split(" ") for c in schema.split(", ")])
    held: list[tuple] = []

    def batch() -> pa.RecordBatch:
        return pa.record_batch([pa.array(c, ARROW[k]) for c, k in zip(zip(*held), kinds)], list(names))

    for row in rows:
        held.append(row)
        if len(held) >= size:
            yield batch()
            held = []
    if held:
        yield batch()


def units(conversations: DataFrame) -> DataFrame:
    """conv_id and its units in order, as an array of hexadecimal strings."""
    role, text = F.coalesce(F.col("role"), F.lit("")), F.coalesce(F.col("text"), F.lit(""))
    digest = F.substring(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256), 1, 2 * (UNIT - 8))
    unit = F.concat(digest, F.lpad(F.hex(F.length(text).cast("bigint")), 16, "0"))
    turns = conversations.filter("conv_id IS NOT NULL").select(F.col("conv_id").cast("bigint"), F.struct(F.col("turn"), unit.alias("unit")).alias("t"))
    return turns.groupBy("conv_id").agg(F.transform(F.sort_array(F.collect_list("t")), lambda t: t["unit"]).alias("own"))


def with_origin(own: DataFrame, heads: int = HEADS, family: int = FAMILY) -> DataFrame:
    """conv_id, seq: the first h units of the family's first conversation, then the own ones after the first h."""
    n = F.crc32(F.col("conv_id").cast("string").cast("binary")) % heads
    first = own.filter(F.col("conv_id") % family == 0).select(F.col("conv_id").alias("origin"), F.slice("own", 1, heads - 1).alias("head"))
    joined = own.withColumn("origin", F.col("conv_id") - F.col("conv_id") % family).join(first, "origin", "left").withColumn("h", n.cast("int"))
    head = F.slice(F.coalesce("head", F.array().cast("array<string>")), F.lit(1), F.col("h"))
    tail = F.slice("own", F.col("h") + 1, F.greatest(F.size("own") - F.col("h"), F.lit(0)))
    return joined.select("conv_id", F.unhex(F.array_join(F.concat(head, tail), "")).alias("seq"))


def _ends(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """Rows (seq_key, n, conv, ids) by key and ascending ids: one row a key, with the hash of all its ids."""
    key = None
    for batch in batches:
        for k, count, least, ids in zip(*[c.to_pylist() for c in batch.columns]):
            if k != key:
                if key is not None:
                    yield key, n, conv, running.hexdigest()
                key, n, conv, running = k, 0, least, sha256()
            running.update((("," if n else "") + ids).encode())
            n, conv = n + count, min(conv, least)
    if key is not None:
        yield key, n, conv, running.hexdigest()


def distinct_sequences(rebuilt: DataFrame, bucket_bits: int = BUCKET_BITS) -> DataFrame:
    """seq, n, conv (the smallest id), ends (digest of the ids) of every distinct sequence of ``rebuilt`` (conv_id, seq)."""
    tasks = int(rebuilt.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rebuilt = materialise(rebuilt, "conversations-rebuilt")
    keyed = rebuilt.select("conv_id", F.sha2("seq", 256).alias("seq_key"), F.shiftright("conv_id", bucket_bits).alias("bucket"))
    ids = F.array_join(F.transform(F.sort_array(F.collect_list("conv_id")), lambda c: c.cast("string")), ",")
    strings = keyed.groupBy("seq_key", "bucket").agg(F.count(F.lit(1)).alias("n"), F.min("conv_id").alias("conv"), ids.alias("ids"))
    ordered = strings.repartition(tasks, "seq_key").sortWithinPartitions("seq_key", "bucket").select("seq_key", "n", "conv", "ids")
    groups = ordered.mapInArrow(lambda batches: _batches(_ends(batches), GROUPED), GROUPED)
    return materialise(rebuilt.join(groups, rebuilt.conv_id == groups.conv).select("seq", "n", "conv", "ends"), "conversation-sequences")


def common_units(a: bytes, b: bytes) -> int:
    """Units that both begin with."""
    n = min(len(a), len(b)) // UNIT
    if a[: n * UNIT] == b[: n * UNIT]:
        return n
    if n <= 16:
        return next(d for d in range(n) if a[d * UNIT: (d + 1) * UNIT] != b[d * UNIT: (d + 1) * UNIT])
    x, y = (np.frombuffer(s, np.uint64, 3 * n).reshape(n, 3) for s in (a, b))
    return int((x != y).any(axis=1).argmax())


class Forest:
    """The contracted trie of one window's distinct sequences in order: nodes where a sequence ends or branches."""

    def __init__(self, seqs: list[bytes], counts: list[int], convs: list[int], ends: list[str]):
        n = len(seqs)
        self.seqs = seqs
        self.depth, self.lo, self.hi = [len(s) // UNIT for s in seqs], list(range(n)), list(range(n))
        self.n, self.conv, self.ends = list(counts), list(convs), list(ends)
        self.kids: list[list[int]] = [[] for _ in range(n)]
        leader, top = list(range(n)), list(range(n))

        def find(i: int) -> int:
            while leader[i] != i:
                leader[i] = i = leader[leader[i]]
            return i

        shared = [common_units(a, b) for a, b in zip(seqs, seqs[1:])]
        for i in sorted(range(n - 1), key=lambda i: -shared[i]):
            a, b = find(i), find(i + 1)
            leader[b] = a
            top[a] = self._join(top[a], top[b], shared[i])
        self.root = top[find(0)]
        if self.depth[self.root]:
            self.root = self._node(0, [self.root])

    def _node(self, depth: int, kids: list[int]) -> int:
        self.depth.append(depth)
        self.lo.append(min(self.lo[k] for k in kids))
        self.hi.append(max(self.hi[k] for k in kids))
        self.n.append(sum(self.n[k] for k in kids))
        self.conv.append(min(self.conv[k] for k in kids))
        self.ends.append(None)
        self.kids.append(kids)
        return len(self.depth) - 1

    def _join(self, u: int, v: int, depth: int) -> int:
        """The node at ``depth`` over two components' top nodes; the left one may end or branch just there."""
        if self.depth[u] != depth:
            return self._node(depth, [u, v])
        self.kids[u].append(v)
        self.hi[u], self.n[u], self.conv[u] = self.hi[v], self.n[u] + self.n[v], min(self.conv[u], self.conv[v])
        return u

    def chars(self, v: int, depth: int) -> int:
        return int.from_bytes(self.seqs[self.lo[v]][depth * UNIT - 8: depth * UNIT], "big") if depth else 0

    def rows(self, part: int) -> Iterator[tuple]:
        """Final rows of the nodes inside the window, partial ones of the prefixes of its first and last sequence."""
        last = len(self.seqs) - 1
        paths = [self._keys(self.seqs[0]), self._keys(self.seqs[last])]
        outer = lambda v: self.lo[v] == 0 or self.hi[v] == last                   # noqa: E731
        leaves, saved = {}, {}                                  # of the topmost node of each one's chain
        spines: list[list[tuple]] = [[], []]
        todo = [(self.root, None, False)]
        while todo:
            v, parent, done = todo.pop()
            if not done:
                todo.append((v, parent, True))
                todo.extend((k, v, False) for k in self.kids[v])
                continue
            inner = [k for k in self.kids[v] if not outer(k)]
            total, count = sum(saved.pop(k) for k in inner), sum(leaves.pop(k) for k in inner)
            above = -1 if parent is None else self.depth[parent]
            if outer(v):
                side = int(self.lo[v] > 0)
                for d in range(self.depth[v], above, -1):
                    own = d == self.depth[v]
                    unit = self.seqs[self.lo[v]][(d - 1) * UNIT: d * UNIT] if d else b""
                    spines[side].append((d, bool(side), unit, paths[side][d], self.conv[v], self.n[v], len(inner) if own else 0, count if own else 0, total if own else 0, self.ends[v] if own else None))
                continue
            count = count if self.kids[v] else 1
            for d in range(self.depth[v], above, -1):
                own = d == self.depth[v]
                total += (self.n[v] - 1) * self.chars(v, d)
                hangs = d - 1 == above and outer(parent)
                key = paths[int(self.lo[parent] > 0)][above] if hangs else None
                up = None if hangs else self.conv[parent] if d - 1 == above else self.conv[v]
                yield False, None, None, None, None, key, d, self.conv[v], up, self.n[v], len(self.kids[v]) if own else 1, count, total, (self.ends[v] if own else None) or NO_ENDS
            leaves[v], saved[v] = count, total
        for slot, (d, behind, unit, key, conv, n, children, count, total, ends) in enumerate(sorted(spines[0]) + sorted(spines[1])):
            yield True, part, slot, behind, unit, key, d, conv, None, n, children, count, total, ends

    @staticmethod
    def _keys(seq: bytes) -> list[bytes]:
        running = sha256()
        keys = [running.digest()[:16]]
        for d in range(0, len(seq), UNIT):
            running.update(seq[d: d + UNIT])
            keys.append(running.digest()[:16])
        return keys


def _forests(batches: Iterator[pa.RecordBatch], window_rows: int) -> Iterator[tuple]:
    part, made = TaskContext.get().partitionId() << 33, 0
    held: list[list] = [[], [], [], []]
    size = 0
    for batch in batches:
        for row in zip(*[c.to_pylist() for c in batch.columns]):
            for column, value in zip(held, row):
                column.append(value)
            size += len(row[0])
            if len(held[0]) >= window_rows or size >= WINDOW_BYTES:
                yield from Forest(*held).rows(part + made)
                made, held, size = made + 1, [[], [], [], []], 0
    if held[0]:
        yield from Forest(*held).rows(part + made)


class _Open:
    """A node that reaches a boundary, as far as it is known."""

    def __init__(self, unit: bytes, key: bytes, conv: int, n: int, children: int, leaves: int, saved: int, ends: str | None):
        self.unit, self.key, self.conv, self.n, self.children, self.leaves, self.saved, self.ends = unit, key, conv, n, children, leaves, saved, ends

    def add(self, conv: int, n: int, children: int, leaves: int, saved: int, ends: str | None) -> None:
        self.conv, self.n = min(self.conv, conv), self.n + n
        self.children, self.leaves, self.saved, self.ends = self.children + children, self.leaves + leaves, self.saved + saved, self.ends or ends


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """Rows of the windows' paths in order: the path that is open is that of the last sequence so far."""
    path: list[_Open] = []
    part, follows, was_behind = None, False, False

    def close(to: int) -> Iterator[tuple]:
        """End the open nodes of depth ``to`` and more."""
        while len(path) > to:
            v, depth = path.pop(), len(path)
            leaves = v.leaves if v.children else 1
            saved = v.saved + ((v.n - 1) * int.from_bytes(v.unit[-8:], "big") if depth else 0)
            if path:
                path[-1].children, path[-1].leaves, path[-1].saved = path[-1].children + 1, path[-1].leaves + leaves, path[-1].saved + saved
            yield v.key, path[-1].key if path else None, depth, v.conv, v.n, v.children, leaves, saved, v.ends or NO_ENDS

    for batch in batches:
        for p, behind, unit, key, depth, *sums in zip(*[c.to_pylist() for c in batch.columns]):
            if p != part:
                part, follows, was_behind = p, True, False
            if behind and not was_behind:
                follows, was_behind = False, True
                yield from close(depth)
            elif follows and not (depth < len(path) and path[depth].unit == unit):
                follows = False
                yield from close(depth)
            if follows:
                path[depth].add(*sums)
            else:
                path.append(_Open(unit, key, *sums))
    yield from close(0)


def trie(sequences: DataFrame, window_rows: int = WINDOW_ROWS) -> DataFrame:
    """A row per node over ``sequences`` (seq, n, conv, ends), all distinct."""
    tasks = int(sequences.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = sequences.select("seq", "n", "conv", "ends").repartitionByRange(tasks, "seq").sortWithinPartitions("seq")
    forest = materialise(ordered.mapInArrow(lambda batches: _batches(_forests(batches, window_rows), FOREST), FOREST), "trie-forests")
    # two paths a window, all that is left of it: 16 or fewer rows a thousand sequences where conversations have eight turns
    paths = forest.filter("spine").repartition(1).sortWithinPartitions("part", "slot").select("part", "behind", "unit", "key", "depth", "conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")
    merged = materialise(paths.mapInArrow(lambda batches: _batches(_merge(batches), MERGED), MERGED), "trie-merged")
    lookup = merged.select(F.col("key").alias("parent_key"), F.col("conv_id").alias("parent_conv_id"))
    if merged.count() <= BROADCAST_ROWS:
        lookup = F.broadcast(lookup)
    columns = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    inside = forest.filter("NOT spine")
    hung = inside.filter("key IS NOT NULL").drop("parent_conv_id").withColumnRenamed("key", "parent_key").join(lookup, "parent_key", "left")
    top = merged.join(lookup, "parent_key", "left")
    return inside.filter("key IS NULL").select(*columns).unionByName(hung.select(*columns)).unionByName(top.select(*columns))


def rebuilt_trie(conversations: DataFrame) -> DataFrame:
    """The trie of the conversations with their family's beginnings."""
    return trie(distinct_sequences(with_origin(units(conversations))))

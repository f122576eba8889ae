"""N-gram Jaccard join by a size-aware heavy-light scheme; documents that it links are grouped.

A document's set holds its distinct shingles of five words. Two sets link when 100 * intersection >= 80 * union.

* Documents with equal sets are one node.
* Small sets, of up to ``boundary`` shingles: every subset of the size that a link needs is a key, so linked small sets share a key.
* Large sets: the sets' rarest shingles are keys of inverted lists. Of n shingles, the n - ceil(0.8 n) + 1 first in one order of all
  shingles are enough for linked sets to meet in a list. The order puts frequent shingles, in order of their count, after all others.
  Small sets whose partners may be large are in the lists too.
* The boundary is the size with the least cost: subsets listed for small sets against list entries read for large sets, from counts of
  sizes and list lengths over all documents. It changes the work, not the result.
* Lists are scanned by ``links.linked``: candidates are tested by what they share in their heads, then by their whole sets.

Shingles are counted over all sets, in the part of each set that heads are taken from. Those that ``FREQUENT_LEAST`` sets or more have are
frequent; if they are more than 2**20, only the most frequent of them, which bounds what is broadcast at any size of the input and changes
the order, not the result. Lists of frequent shingles are scanned in salted parts.

Shingles are compared by 64-bit hashes. Cases: a null text counts as empty; an empty set links with nothing, equal ones neither; rows
that repeat a doc_id are nodes of their own if their texts differ, and a null doc_id is no component's smallest id unless it is the
only one; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from hashlib import blake2b
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from tallyline.llm.common import discard, free_name, let_go, materialise, semi_join, small_batches, thrifty
from tallyline.llm.links import MARKS, linked
from tallyline.llm.words import U64, mix, text_sets

SHINGLE = 5
FREQUENT_MOST = 1 << 20
FREQUENT_LEAST = 16
BLOCK = 1 << 21
#: Rows of a batch that a block is handed on in.
BATCH = 1 << 16
LARGEST_SMALL = 20
LIST_PART = 50_000
NO_ID = -(1 << 63)


def needed(n: int, m: int) -> int:
    """Shingles that linked sets of n and m shingles share at least."""
    return (4 * (n + m) + 8) // 9


def head_size(n: int) -> int:
    return n - (4 * n + 4) // 5 + 1


def subset_sizes(n: int) -> list[int]:
    """Sizes of the subsets that a small set of n shingles lists, for partners of any size that may link and aren't equal to it."""
    return sorted({needed(n, m) for m in range((4 * n + 4) // 5, 5 * n // 4 + 1) if needed(n, m) < n or m > n})


def boundary_by_cost(sizes: dict[int, int], entries_met: float) -> int:
    """The boundary with the least cost; sizes: number of sets of each size up to ``LARGEST_SMALL``; entries_met: entries that a list
    entry meets on average."""
    small = {n: sum(comb(n, c) for c in subset_sizes(n)) for n in range(LARGEST_SMALL + 1)}
    large = {n: head_size(n) * (1 + entries_met) for n in range(1, LARGEST_SMALL + 1)}

    def cost(x: int) -> float:
        return sum(k * ((small[n] if n <= x else 0) + (large[n] if 5 * n // 4 > x else 0)) for n, k in sizes.items() if n)

    return min(range(3, LARGEST_SMALL + 1), key=cost)


def _counted(n: int) -> int:
    """Of a set's n shingles, in order of hash, those that are counted: the head and half as many again, all of a small set."""
    return n if n <= LARGEST_SMALL else min(n, head_size(n) * 3 // 2)


def _census(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (kind, key, n): 0, shingles of a block and the sets that count them; 1, sets of a small size."""
    let_go()
    held: list[np.ndarray] = []
    size = 0
    sizes = np.zeros(LARGEST_SMALL + 1, np.int64)

    def block() -> Iterator[pa.RecordBatch]:
        values, counts = np.unique(np.concatenate(held), return_counts=True)
        made = pa.record_batch([pa.array(np.zeros(len(values), np.int64)), pa.array(values.view(np.int64)), pa.array(counts.astype(np.int64))], ["kind", "key", "n"])
        return (made.slice(at, BATCH) for at in range(0, made.num_rows, BATCH))        # the JVM holds a whole batch outside its heap

    for batch in batches:
        for _, found in text_sets(batch.column(0), SHINGLE):
            if len(found) <= LARGEST_SMALL:
                sizes[len(found)] += 1
            held.append(found[: _counted(len(found))].copy())
            size += len(held[-1])
            if size >= BLOCK:
                yield from block()
                held, size = [], 0
    if held:
        yield from block()
    yield pa.record_batch([pa.array([1] * len(sizes), pa.int64()), pa.array(range(len(sizes)), pa.int64()), pa.array(sizes)], ["kind", "key", "n"])


def census(texts: DataFrame, least: int = FREQUENT_LEAST) -> tuple[np.ndarray, np.ndarray, int]:
    """Frequent shingles in ascending order, their counts, and the boundary between small and large sets."""
    counts = texts.mapInArrow(thrifty(_census), "kind bigint, key bigint, n bigint").groupBy("kind", "key").agg(F.sum("n").alias("n"))
    counted = materialise(counts.filter((F.col("kind") == 1) | (F.col("n") > 1)), "census")
    sizes = {int(r["key"]): int(r["n"]) for r in counted.filter("kind = 1").collect()}       # LARGEST_SMALL + 1 rows
    shingles = counted.filter("kind = 0")
    entries, met = shingles.agg(F.sum("n"), F.sum(F.col("n").cast("double") * F.col("n"))).first()
    level = F.floor(F.log2("n") * 4)
    levels = sorted(shingles.filter(F.col("n") >= least).groupBy(level.alias("level")).agg(F.count(F.lit(1)).alias("k"), F.min("n").alias("n")).collect(), key=lambda r: -r["level"])   # 4 for each power of two
    floor, together = None, 0
    for r in levels:
        together += r["k"]
        if together > FREQUENT_MOST:
            break
        floor = r["n"]
    rows = shingles.filter(F.col("n") >= (floor if floor is not None else (1 << 62))).select("key", "n").toArrow()   # FREQUENT_MOST rows at most
    keys, counts = rows["key"].to_numpy().astype(np.int64).view(U64), rows["n"].to_numpy().astype(np.int64)
    order = np.argsort(keys)
    return keys[order], counts[order], boundary_by_cost(sizes, (met or 0.0) / max(1, entries or 0))


class Keys:
    """Heads and subset keys of sets, given the frequent shingles and the boundary."""

    def __init__(self, frequent: np.ndarray, counts: np.ndarray, boundary: int):
        self.frequent, self.counts, self.boundary = frequent, counts, boundary

    def head(self, found: np.ndarray) -> np.ndarray:
        n = head_size(len(found))
        if not len(self.frequent):
            return found[:n]
        at = np.minimum(np.searchsorted(self.frequent, found), len(self.frequent) - 1)
        often = self.frequent[at] == found
        if not often.any():
            return found[:n]
        late = found[often]
        return np.concatenate([found[~often], late[np.lexsort((late, self.counts[at[often]]))]])[:n]

    def parts(self, keys: np.ndarray) -> np.ndarray:
        """Parts that the list of each key is scanned in."""
        if not len(self.frequent):
            return np.ones(len(keys), np.int64)
        at = np.minimum(np.searchsorted(self.frequent, keys), len(self.frequent) - 1)
        return np.where(self.frequent[at] == keys, 1 + self.counts[at] // LIST_PART, 1)

    def subsets(self, found: np.ndarray) -> np.ndarray:
        """A key for each subset of the sizes needed."""
        out = []
        with np.errstate(over="ignore"):
            for c in subset_sizes(len(found)):
                chosen = found[np.array(list(combinations(range(len(found)), c)), np.int64)]
                h = np.full(len(chosen), U64(c))
                for k in range(c):
                    h = mix(h * U64(31) + chosen[:, k])
                out.append(h)
        return np.concatenate(out) if out else np.zeros(0, U64)

    def of(self, found: np.ndarray, head: np.ndarray) -> np.ndarray:
        n = len(found)
        if n > self.boundary:
            return head
        return np.concatenate([self.subsets(found), head]) if 5 * n // 4 > self.boundary else self.subsets(found)

    def places(self, n: int, head: int, keys: int) -> np.ndarray:
        """Place in the one order of shingles of each key that ``of`` gives for a set of n shingles; subsets, which come first, have 0."""
        out = np.zeros(keys, np.int64)
        if n > self.boundary or 5 * n // 4 > self.boundary:
            out[keys - head:] = np.arange(head)
        return out


def parity_marks(found: np.ndarray) -> list[int]:
    """256 bits: whether the set has an odd number of elements of each value of eight bits of the hash."""
    odd = np.bincount((found >> U64(20) & U64(255)).astype(np.int64), minlength=256) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64).tolist()


def set_id(found: np.ndarray) -> bytes:
    return blake2b(found.tobytes(), digest_size=16).digest()


def profiles(docs: DataFrame, keys) -> DataFrame:
    """Every row's number (its column ``row``, if there is one), doc_id, set size, set id, head and keys, a written table. ``keys`` is a broadcast ``Keys``."""
    numbered = "row" in docs.columns

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        let_go()
        own, made = keys.value, TaskContext.get().partitionId() << 33
        names = ["row", "doc_id", "n", "set_id", "head", "keys", *MARKS]
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                n, ids, heads, found_keys, marks = [], [], [], [], []
                for _, found in text_sets(part.column(1), SHINGLE):
                    head = own.head(found) if len(found) else found
                    n.append(len(found))
                    ids.append(set_id(found))
                    marks.append(parity_marks(found))
                    heads.append(head.tobytes())
                    k = own.of(found, head) if len(found) else found
                    found_keys.append(None if k is head else k.tobytes())
                yield pa.record_batch([part.column(2) if numbered else pa.array(range(made, made + len(n)), pa.int64()), part.column(0), pa.array(n, pa.int64()), pa.array(ids, pa.binary()), pa.array(heads, pa.binary()), pa.array(found_keys, pa.binary()), *(pa.array([m[i] for m in marks], pa.int64()) for i in range(len(MARKS)))], names)
                made += len(n)

    schema = "row bigint, doc_id bigint, n bigint, set_id binary, head binary, keys binary, " + ", ".join(f"{m} bigint" for m in MARKS)
    return materialise(docs.select("doc_id", "text", *(["row"] if numbered else [])).mapInArrow(thrifty(rows), schema), "profiles", "zstd")


def lists_of(nodes: DataFrame, keys) -> DataFrame:
    """node, n, marks and keys (at: the place in the node's head, key) of every node in a list with two members or more, a written table. A list's rows
    come to one task in order of key and pass it in a stream; lists of frequent shingles come in parts, which are all kept."""

    def entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = keys.value
        for batch in batches:
            for node, n, head, all_keys in zip(*(c.to_pylist() for c in batch.columns)):
                k = np.frombuffer(head if all_keys is None else all_keys, U64)
                if len(k):
                    parts = own.parts(k)
                    yield pa.record_batch([pa.array(k.view(np.int64)), pa.array(np.where(parts > 1, 1 + node % parts, 0)), pa.array(own.places(n, len(head) // 8, len(k))), pa.array(np.full(len(k), node)), pa.array(np.full(len(k), n))],
                                          ["key", "part", "at", "node", "n"])

    def gathered(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in rows:
            held.append(batch)
            size += batch.num_rows
            if size >= 20_000:
                yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
                held, size = [], 0
        if held:
            yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]

    def several(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: pa.RecordBatch | None = None                   # the last row, not yet known to have a like
        last_kept = False
        for batch in batches:
            if not batch.num_rows:
                continue
            table = pa.Table.from_batches([batch] if last is None else [last, batch])
            key, part = table["key"].to_numpy(), table["part"].to_numpy()
            like = (key[1:] == key[:-1]) & (part[1:] == part[:-1])
            keep = part > 0
            keep[1:] |= like
            keep[:-1] |= like
            if last is not None:
                keep[0] |= last_kept
            last, last_kept = table.slice(len(key) - 1).combine_chunks().to_batches()[0], bool(keep[-1])
            keep[-1] = False
            yield from table.filter(pa.array(keep)).select(["key", "at", "node"]).to_batches()
        if last is not None and last_kept:
            yield last.select(["key", "at", "node"])

    made = nodes.select("row", "n", "head", "keys").mapInArrow(thrifty(lambda b: gathered(entries(b))), "key bigint, part bigint, at bigint, node bigint, n bigint")
    dealt = made.select("key", F.col("part").cast("int").alias("part"), F.col("at").cast("int").alias("at"), "node").repartition("key", "part").sortWithinPartitions("key", "part")
    kept = dealt.mapInArrow(thrifty(several), "key bigint, at int, node bigint")
    held = kept.groupBy("node").agg(F.collect_list(F.struct("at", "key")).alias("keys"))          # as many as the node's own keys
    return materialise(held.join(nodes.select(F.col("row").alias("node"), F.col("n").cast("int").alias("n"), *MARKS), "node"), "lists")


def _pair_filter(bound) -> callable:
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = batch.column(0), batch.column(1)
            keep = [bound(n, m, np.frombuffer(x, U64), np.frombuffer(y, U64)) for n, m, x, y in zip(*(batch.column(i).to_pylist() for i in range(2, 6)))]
            table = pa.table({"a": a, "b": b}).filter(pa.array(keep, pa.bool_()))
            yield from table.to_batches()
    return rows


def _may_link(n: int, m: int, head: np.ndarray, other: np.ndarray) -> bool:
    """What the heads share and all that can be shared after the end of the head that ends first."""
    shared = len(np.intersect1d(head, other, assume_unique=True))
    return shared + max(n - len(head), m - len(other)) >= needed(n, m)


def _links(n: int, m: int, found: np.ndarray, other: np.ndarray) -> bool:
    shared = len(np.intersect1d(found, other, assume_unique=True))
    return 100 * shared >= 80 * (n + m - shared)


def filtered_pairs(pairs: DataFrame, values: DataFrame, bound) -> DataFrame:
    """The pairs (a, b) for which ``bound`` of both nodes' n and value holds; ``values``: node, n, value."""
    a = values.select(F.col("node").alias("a"), F.col("n").alias("n_a"), F.col("value").alias("v_a"))
    b = values.select(F.col("node").alias("b"), F.col("n").alias("n_b"), F.col("value").alias("v_b"))
    return pairs.join(a, "a").join(b, "b").select("a", "b", "n_a", "n_b", "v_a", "v_b").mapInArrow(thrifty(_pair_filter(bound)), "a bigint, b bigint")


def whole_sets(docs: DataFrame, nodes: DataFrame) -> DataFrame:
    """node, n, value (the whole set) of ``nodes`` (row, doc_id, set_id), a written table, from the documents' texts."""
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                sets = [found for _, found in text_sets(batch.column(1).slice(at, 512), SHINGLE)]
                yield pa.record_batch([pa.array([set_id(s) for s in sets], pa.binary()), pa.array([len(s) for s in sets], pa.int64()), pa.array([s.tobytes() for s in sets], pa.binary())], ["set_id", "n", "value"])

    wanted = materialise(nodes.select(F.coalesce("doc_id", F.lit(NO_ID)).alias("doc_id")).distinct(), "wanted")
    texts = semi_join(docs.select(F.coalesce(F.col("doc_id").cast("bigint"), F.lit(NO_ID)).alias("doc_id"), "text"), wanted, "doc_id")
    made = texts.mapInArrow(thrifty(rows), "set_id binary, n bigint, value binary")
    sets = materialise(made.join(nodes.select(F.col("row").alias("node"), "set_id"), "set_id").dropDuplicates(["node"]).select("node", "n", "value"), "whole-sets", "uncompressed")
    discard(wanted)
    return sets


def verified_by_sets(docs: DataFrame, nodes: DataFrame, pairs: DataFrame) -> DataFrame:
    """The links among ``pairs`` by their whole sets, which are made of the texts of these nodes."""
    ends = pairs.select(F.col("a").alias("row")).union(pairs.select(F.col("b").alias("row"))).distinct()
    sets = whole_sets(docs, nodes.select("row", "doc_id", "set_id").join(ends, "row", "left_semi"))
    found = materialise(filtered_pairs(pairs, sets, _links), "verified")
    discard(sets, pairs)
    return found


def verifier(docs: DataFrame, nodes: DataFrame) -> Callable[[DataFrame], DataFrame]:
    """Links among candidates: by heads first, then what is left by whole sets."""
    heads = nodes.select(F.col("row").alias("node"), "n", F.col("head").alias("value"))
    return lambda pairs: verified_by_sets(docs, nodes, materialise(filtered_pairs(pairs, heads, _may_link), "likely"))


def placed(found: DataFrame, lists: Callable[[DataFrame], DataFrame], verify: Callable[[DataFrame], Callable[[DataFrame], DataFrame]]) -> DataFrame:
    """row, doc_id, n, node (of its component) of every row of ``found`` (row, doc_id, n, set_id and more, a written table). Rows of equal sets are
    one node; ``lists`` gives the nodes' inverted lists, ``verify`` what finds the links among candidates."""
    firsts = found.filter("n > 0").groupBy("set_id").agg(F.min("row").alias("node"))
    places = materialise(found.select("row", "doc_id", "n", "set_id").join(firsts, "set_id", "left").select("row", "doc_id", "n", F.coalesce("node", "row").alias("node")), "places")
    copies = materialise(places.filter("row <> node").select("row"), "copies")
    nodes = semi_join(found.filter("n > 0"), copies, "row", "left_anti")
    labels = linked(lists(nodes), verify(nodes))
    if labels is not None:
        places = places.join(labels, "node", "left").select("row", "doc_id", "n", F.coalesce("component", "node").alias("node"))
    return places


def grouped(found: DataFrame, lists: Callable[[DataFrame], DataFrame], verify: Callable[[DataFrame], Callable[[DataFrame], DataFrame]]) -> DataFrame:
    """doc_id, n_shingles, component_id of every row of ``found``, as for ``placed``."""
    places = placed(found, lists, verify)
    smallest = places.groupBy("node").agg(F.min("doc_id").alias("component_id"))
    return places.join(smallest, "node").select("doc_id", F.col("n").alias("n_shingles"), "component_id")


def _parts(docs: DataFrame, boundary: int | None) -> tuple:
    """What ``grouped`` and ``placed`` take, for ``docs`` (doc_id, text, perhaps row)."""
    frequent, counts, by_cost = census(docs.select("text"))
    keys = docs.sparkSession.sparkContext.broadcast(Keys(frequent, counts, by_cost if boundary is None else boundary))
    return profiles(docs, keys), lambda nodes: lists_of(nodes, keys), lambda nodes: verifier(docs, nodes)


def joined(docs: DataFrame, boundary: int | None = None) -> DataFrame:
    """doc_id, n_shingles, component_id of every row of ``docs`` (doc_id, text)."""
    with small_batches(docs.sparkSession):
        return grouped(*_parts(docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text"), boundary))


def one_of_each(docs: DataFrame) -> DataFrame:
    """One row of each component of ``docs``, with all columns: that of the smallest doc_id (a null one comes last), of several such rows any one. Documents
    without words all stay. Rows are told apart by a number of their own, so a row that repeats the doc_id of a near copy stays if its text is no copy."""
    number = free_name("row_number", docs.columns)
    numbered = materialise(docs.withColumn(number, F.monotonically_increasing_id()), "numbered")
    with small_batches(docs.sparkSession):
        places = placed(*_parts(numbered.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text", F.col(f"`{number}`").alias("row")), None))
    first = places.groupBy("node").agg(F.min(F.struct(F.col("doc_id").isNull().alias("without"), "doc_id", "row")).alias("best"))
    lost = materialise(places.join(first, "node").filter("row <> best.row").select(F.col("row").alias(number)), "near-copies")
    return semi_join(numbered, lost, number, "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])

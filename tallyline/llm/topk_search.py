"""Exact top-k search by inner product, pruned by multi-resolution segment statistics.

A vector is cut into segments; a segment of m components has a mean and a deviation. For vectors q and x the squared distance is at
least the sum over segments of m * ((mean_q - mean_x)**2 + (dev_q - dev_x)**2), and since those statistics hold each vector's whole
norm, the inner product (|q|**2 + |x|**2 - distance**2) / 2 is at most the sum of m * (mean_q * mean_x + dev_q * dev_x). That bound is
taken for long segments first, then for shorter ones of those that are left (``SEGMENTS``); a candidate whose bound is under the
query's k-th best exact score so far goes. What is left after the shortest segments is scored exactly. Bounds get a margin for
rounding, so that pruning never loses a score; ties are never pruned.

Vectors are packed into blocks of whole numbers, written once. Queries are cut into groups of at most ``GROUP_ROWS`` and every
group meets every block; a task that gets several blocks of a group keeps the group's best and passes on ``k`` rows a query. Only counts
go to the driver, nothing is broadcast, and a hot vector is just many rows of many blocks.

Cases: a component x becomes floor(scale * x) in double precision. A vector that is null or has a null or non-finite component takes no part; an
empty vector takes part with scores of 0; of vectors of different lengths the shorter one counts as if it went on with zeros. A query's
own row is no candidate for it, other rows that repeat its id are. A null id is never a query and comes last among ties. Scores beyond
64 bits count as the nearest number of 64 bits, plus or minus. An empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window, functions as F

from tallyline.llm.common import materialise

K = 20
SCALE = 64
EVERY = 20
#: Components of a segment, coarse to fine.
SEGMENTS = (32, 8, 2)
#: Bits of a query's place in its group.
ROW_BITS = 13
#: Vectors of a block and of a group of queries, and the bytes that either may have.
BLOCK_ROWS, GROUP_ROWS, BLOCK_BYTES = 512, 8192, 16 << 20
#: Tasks that share the blocks of a group get this many draws each, so that shares are even.
DRAWS = 4
#: What single precision may err by, in parts of |q| * |x|.
MARGIN = 2e-5
#: Sums below this are exact in double precision.
EXACT = float(1 << 53)

BLOCKS = "block bigint, n int, ids array<bigint>, first array<int>, data binary"
FOUND = "query bigint, query_id bigint, vec_id bigint, score bigint"
LARGEST = (1 << 63) - 1


def _pack(batches: Iterator[pa.RecordBatch], scale: int, rows: int) -> Iterator[pa.RecordBatch]:
    """Blocks of whole-number vectors; those that take no part are left out."""
    part, made = TaskContext.get().partitionId() << 33, 0
    ids: list = []
    vectors: list[np.ndarray] = []
    size = 0

    def block() -> pa.RecordBatch:
        first = np.concatenate([[0], np.cumsum([len(v) for v in vectors])]).astype(np.int32)
        data = np.concatenate(vectors) if vectors else np.zeros(0)
        columns = [[part + made], [len(ids)], [ids], [first.tolist()], [data.astype("<f8").tobytes()]]
        return pa.record_batch([pa.array(c, t) for c, t in zip(columns, [pa.int64(), pa.int32(), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.binary()])], ["block", "n", "ids", "first", "data"])

    for batch in batches:
        for vec_id, cell in zip(batch.column(0).to_pylist(), batch.column(1)):
            if not cell.is_valid or cell.values.null_count:
                continue
            x = cell.values.to_numpy(zero_copy_only=False).astype(np.float64)
            if not np.isfinite(x).all():
                continue
            with np.errstate(over="ignore"):
                v = np.floor(x * float(scale))
            if not np.isfinite(v).all():
                v = np.clip(v, -np.finfo(np.float64).max, np.finfo(np.float64).max)
            ids.append(vec_id)
            vectors.append(v)
            size += v.nbytes
            if len(ids) >= rows or size >= BLOCK_BYTES:
                yield block()
                made, ids, vectors, size = made + 1, [], [], 0
    if ids:
        yield block()


def pack(vectors: DataFrame, id_column: str = "vec_id", vector: str = "embedding", scale: int = SCALE, rows: int = BLOCK_ROWS) -> DataFrame:
    """The written blocks of ``vectors``."""
    plain = vectors.select(F.col(f"`{id_column}`").cast("bigint").alias("id"), F.col(f"`{vector}`").cast("array<double>").alias("v"))
    return materialise(plain.mapInArrow(lambda batches: _pack(batches, scale, rows), BLOCKS), "vector-blocks", "zstd")


def _rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in batch.to_pylist():
            data, first = np.frombuffer(row["data"], "<f8"), row["first"]
            for at in range(0, row["n"], 256):
                to = min(row["n"], at + 256)
                yield pa.record_batch([pa.array([row["block"]] * (to - at), pa.int64()), pa.array(range(at, to), pa.int32()), pa.array(row["ids"][at:to], pa.int64()),
                                       pa.array([data[first[i]: first[i + 1]].tobytes() for i in range(at, to)], pa.binary())], ["block", "place", "id", "v"])


def _group(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.RecordBatch]:
    """Query rows (block, place, id, v) as groups of bounded size, one row each."""
    part, made = TaskContext.get().partitionId() << 33, 0
    held: list[dict] = []
    size = 0

    def group() -> pa.RecordBatch:
        first = np.concatenate([[0], np.cumsum([len(r["v"]) // 8 for r in held])]).tolist()
        columns = [[part + made], [[r["id"] for r in held]], [first], [b"".join(r["v"] for r in held)], [[r["block"] for r in held]], [[r["place"] for r in held]]]
        kinds = [pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.int32())]
        return pa.record_batch([pa.array(c, t) for c, t in zip(columns, kinds)], ["part", "ids", "first", "data", "own_block", "own_place"])

    for batch in batches:
        for row in batch.to_pylist():
            held.append(row)
            size += len(row["v"])
            if len(held) >= rows or size >= BLOCK_BYTES:
                yield group()
                made, held, size = made + 1, [], 0
    if held:
        yield group()


class Vectors:
    """Whole-number vectors of one block or group as a matrix, padded with zeros, and their statistics by segment length."""

    def __init__(self, data: bytes, first: list[int]):
        flat, n = np.frombuffer(data, "<f8"), len(first) - 1
        lengths = np.diff(first)
        width = int(lengths.max()) if n else 0
        if n and (lengths == width).all():
            self.m = flat.reshape(n, width)
        else:
            self.m = np.zeros((n, width))
            for i in range(n):
                self.m[i, : lengths[i]] = flat[first[i]: first[i + 1]]
        top = np.abs(self.m).max(axis=1, initial=0.0)
        scaled = self.m / np.where(top > 0, top, 1.0)[:, None]
        self.norm = top * np.sqrt((scaled * scaled).sum(axis=1))
        self.unit = self.m / np.where(self.norm > 0, self.norm, 1.0)[:, None]
        self.by_length: dict[int, np.ndarray] = {}

    def stats(self, length: int) -> np.ndarray:
        """sqrt(m) * mean and sqrt(m) * deviation of each segment of the vector scaled to norm 1."""
        found = self.by_length.get(length)
        if found is None:
            n, width = self.m.shape
            segments = -(-width // length)
            padded = np.zeros((n, segments * length))
            padded[:, :width] = self.unit
            cut = padded.reshape(n, segments, length)
            mean = cut.mean(axis=2)
            rest = cut - mean[:, :, None]
            found = np.empty((n, segments, 2), np.float32)
            found[:, :, 0] = mean * np.sqrt(length)
            found[:, :, 1] = np.sqrt((rest * rest).sum(axis=2))
            self.by_length[length] = found = found.reshape(n, 2 * segments)
        return found


class Best:
    """The ``k`` best of each query so far: exact scores, ties to smaller ids."""

    def __init__(self, n: int, k: int):
        self.k, self.least = k, np.full(n, -np.inf)
        empty = np.zeros(0, np.int64)
        self.kept = [empty, empty, np.zeros(0, bool), empty]     # query, id, id is null, score
        self.fresh: list[list[np.ndarray]] = []
        self.waiting = 0

    def add(self, query: np.ndarray, ids: np.ndarray, null: np.ndarray, score: np.ndarray) -> None:
        if len(query):
            self.fresh.append([query, ids, null, score])
            self.waiting += len(query)
            if self.waiting >= max(4096, len(self.kept[0]) // 2):
                self.settle()

    def settle(self) -> None:
        if not self.fresh:
            return
        query, ids, null, score = (np.concatenate([x[i] for x in [self.kept, *self.fresh]]) for i in range(4))
        order = np.lexsort((ids, null, -score, query))
        query = query[order]
        starts = np.flatnonzero(np.concatenate([[True], query[1:] != query[:-1]]))
        place = np.arange(len(query)) - np.repeat(starts, np.diff(np.append(starts, len(query))))
        order, query, place = order[place < self.k], query[place < self.k], place[place < self.k]
        self.kept = [query, ids[order], null[order], score[order]]
        full = place == self.k - 1
        self.least[query[full]] = score[order][full].astype(np.float64)
        self.fresh, self.waiting = [], 0


def score_block(queries: Vectors, own_block: np.ndarray, own_place: np.ndarray, block: int, ids: list, vectors: Vectors, best: Best, segments: tuple[int, ...] = SEGMENTS) -> int:
    """Prune and score one block for a group; the number of pairs that were scored exactly."""
    n, width = len(ids), min(queries.m.shape[1], vectors.m.shape[1])
    null = np.array([i is None for i in ids], bool)
    plain_ids = np.array([0 if i is None else i for i in ids], np.int64)
    rows, columns = np.arange(len(queries.m)), np.arange(n)
    whole = float(queries.norm.max(initial=0)) * float(vectors.norm.max(initial=0)) < EXACT
    if whole and np.isneginf(best.least).any() and n > best.k + 1:
        # no k scores yet: the block's own k-th best (one more, as a query may be in the block) is a first limit
        scores = queries.m[:, :width] @ vectors.m[:, :width].T
        limit = np.partition(scores, n - best.k - 1, axis=1)[:, n - best.k - 1]
    else:
        limit = best.least
    floor = np.maximum(limit, best.least)
    with np.errstate(divide="ignore", invalid="ignore", over="ignore"):
        need = np.where(queries.norm > 0, floor / queries.norm, np.where(floor <= 0, -np.inf, np.inf))
    need = np.where(np.isnan(need), -np.inf, need)
    alive = None
    for length in segments:
        a, b = queries.stats(length), vectors.stats(length)
        common = min(a.shape[1], b.shape[1])
        bound = a[np.ix_(rows, range(common))] @ b[np.ix_(columns, range(common))].T
        with np.errstate(over="ignore"):
            keep = (bound + np.float32(MARGIN)) * vectors.norm[columns] >= need[rows][:, None]
        if alive is not None:
            keep &= alive
        r, c = keep.any(axis=1), keep.any(axis=0)
        rows, columns, alive = rows[r], columns[c], keep[np.ix_(r, c)]
        if not len(rows):
            return 0
    own = np.flatnonzero(own_block[rows] == block)
    if len(own):
        at = np.searchsorted(columns, own_place[rows[own]])
        there = (at < len(columns)) & (columns[np.minimum(at, len(columns) - 1)] == own_place[rows[own]])
        alive[own[there], at[there]] = False
    i, j = np.nonzero(alive)
    q, x = rows[i], columns[j]
    if not whole:
        score = np.array([max(-LARGEST, min(LARGEST, sum(int(u) * int(v) for u, v in zip(queries.m[s, :width], vectors.m[t, :width])))) for s, t in zip(q, x)], np.int64)
    elif 8 * len(q) >= alive.size:
        score = (queries.m[rows][:, :width] @ vectors.m[columns][:, :width].T)[i, j]
    else:
        score = np.concatenate([np.zeros(0), *[np.einsum("ij,ij->i", queries.m[q[p: p + 65536], :width], vectors.m[x[p: p + 65536], :width]) for p in range(0, len(q), 65536)]])
    score = score.astype(np.int64)
    take = score >= floor[q]
    best.add(q[take], plain_ids[x[take]], null[x[take]], score[take])
    return len(q)


def _search(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    """Rows come by group, the group's queries (as often as tasks' draws brought them) before its blocks."""
    group, state = None, None

    def results() -> Iterator[pa.RecordBatch]:
        best, ids = state[3], state[4]
        best.settle()
        query, vec, null, score = best.kept
        for at in range(0, len(query), 8192):
            some = slice(at, at + 8192)
            yield pa.record_batch([pa.array((group << ROW_BITS) + query[some], pa.int64()), pa.array([ids[i] for i in query[some]], pa.int64()),
                                   pa.array(vec[some], pa.int64(), mask=null[some]), pa.array(score[some], pa.int64())], ["query", "query_id", "vec_id", "score"])

    for batch in batches:
        for row in batch.to_pylist():
            if row["grp"] != group:
                if state:
                    yield from results()
                group, state = row["grp"], None
            if not row["candidates"]:
                if state is None:
                    state = (Vectors(row["data"], row["first"]), np.array(row["own_block"], np.int64), np.array(row["own_place"], np.int64), Best(len(row["ids"]), k), row["ids"])
            elif state:
                score_block(state[0], state[1], state[2], row["block"], row["ids"], Vectors(row["data"], row["first"]), state[3])
    if state:
        yield from results()


def top_k(vectors: DataFrame, is_query: Column, k: int = K, id_column: str = "vec_id", vector: str = "embedding", scale: int = SCALE,
          block_rows: int = BLOCK_ROWS, group_rows: int = GROUP_ROWS) -> DataFrame:
    """query_id, rank, vec_id, score: the ``k`` best other rows of each row for which ``is_query``, a condition on the column ``id``, holds."""
    spark = vectors.sparkSession
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    blocks = pack(vectors, id_column, vector, scale, block_rows)
    rows = blocks.mapInArrow(_rows_of, "block bigint, place int, id bigint, v binary").filter(is_query)
    n_queries = blocks.select(F.explode("ids").alias("id")).filter(is_query).count()
    n_groups = max(1, -(-n_queries // group_rows))
    groups = materialise(rows.repartition(n_groups).mapInArrow(
        lambda batches: _group(batches, min(group_rows, 1 << ROW_BITS)), "part bigint, ids array<bigint>, first array<int>, data binary, own_block array<bigint>, own_place array<int>"), "query-groups", "zstd")
    # one number for each group: dense, so that a block lists the groups it meets by itself
    numbers = materialise(groups.select("part", (F.row_number().over(Window.orderBy("part")) - 1).cast("bigint").alias("grp")), "query-group-numbers")
    n_groups = numbers.count()
    if not n_groups:
        return spark.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score bigint")
    draws = max(1, -(-DRAWS * tasks // n_groups))                   # shares into which the blocks are cut, for each group
    asked = groups.join(numbers, "part").select("grp", F.explode(F.sequence(F.lit(0), F.lit(draws - 1))).alias("share"), F.lit(False).alias("candidates"), F.lit(0).cast("bigint").alias("block"), "ids", "first", "data", "own_block", "own_place")
    every = F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(n_groups - 1).cast("bigint")))
    met = blocks.select(every.alias("grp"), F.pmod(F.xxhash64("block"), F.lit(draws)).cast("int").alias("share"), F.lit(True).alias("candidates"), "block", "ids", "first", "data",
                        F.lit(None).cast("array<bigint>").alias("own_block"), F.lit(None).cast("array<int>").alias("own_place"))
    dealt = asked.unionByName(met).repartition(tasks, "grp", "share").sortWithinPartitions("grp", "candidates", "share", "block")
    found = dealt.mapInArrow(lambda batches: _search(batches, k), FOUND)
    order = Window.partitionBy("query").orderBy(F.col("score").desc(), F.col("vec_id").asc_nulls_last())
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def every_twentieth(vectors: DataFrame) -> DataFrame:
    """The top ``K`` of every row whose vec_id is divisible by ``EVERY``."""
    return top_k(vectors, F.col("id") % EVERY == 0)

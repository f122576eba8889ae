"""MinHash fingerprints of word shingles.

A text's shingles are hashed to 32 bits; ``PERMUTATIONS`` universal hashes (a * x + b modulo 2**32, a odd, so each permutes the values)
are applied to whole chunks of texts with numpy, and the least value of each, its upper 16 bits, is a component of the signature. The
share of equal components estimates the Jaccard likeness of the shingle sets.

Near duplicates: ``BANDS`` bands of ``BAND_ROWS`` components are keys. Documents that agree in a band are candidates, which are joined on
the band's key and verified by the Jaccard likeness of their whole shingle sets. At a likeness of 0.8 a pair shares no band once in
20,000 times, and less often above. Documents of equal sets are one node; ``links.linked`` walks a key's list by pivots, so a large
group isn't listed as pairs.

Cases: a null text counts as empty; empty texts and texts without words have the fingerprint of all ones and are like each other, and
unlike any other text; a text with fewer than five words is one shingle. Equal doc_ids are ordered by text, a null doc_id comes first.
An empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from tallyline.llm.common import materialise, semi_join
from tallyline.llm.links import MARKS, by_node
from tallyline.llm.ngram_join import grouped, parity_marks, set_id, verified_by_sets
from tallyline.llm.words import U64, chunks, mix, shingle_hashes, text_buffers, text_sets

PERMUTATIONS = 128
SHINGLE = 5
BLOCK = 1 << 14
EMPTY = 0xFFFF
BANDS, BAND_ROWS = 25, 5


def _hashes(n: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(5)
    return rng.integers(0, 2**32, n, dtype=np.uint32) | np.uint32(1), rng.integers(0, 2**32, n, dtype=np.uint32)


def signatures(column: pa.Array, n: int = PERMUTATIONS) -> np.ndarray:
    """One row of ``n`` 16-bit components for each text."""
    a, b = _hashes(n)
    data, at = text_buffers(column)
    out = np.full((len(at) - 1, n), EMPTY, np.uint16)
    for i, j in chunks(at):
        hashes, of = shingle_hashes(data, at[i: j + 1], SHINGLE)
        x = (hashes >> np.uint64(32)).astype(np.uint32)
        full = np.flatnonzero(np.diff(of))
        if not len(full):
            continue
        least = np.full((n, len(full)), 0xFFFFFFFF, np.uint32)
        starts = of[full]
        with np.errstate(over="ignore"):
            for lo in range(0, len(x), BLOCK):                      # blocks that stay in the processor's cache
                hi = min(lo + BLOCK, len(x))
                first = int(np.searchsorted(starts, lo, "right")) - 1
                last = int(np.searchsorted(starts, hi, "left"))
                cuts = np.maximum(starts[first:last] - lo, 0)
                part = x[lo:hi]
                y = np.empty_like(part)
                for k in range(n):
                    np.multiply(part, a[k], out=y)
                    np.add(y, b[k], out=y)
                    np.minimum(least[k, first:last], np.minimum.reduceat(y, cuts), out=least[k, first:last])
        out[i + full] = np.minimum(least.T >> np.uint32(16), EMPTY - 1).astype(np.uint16)
    return out


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (a == b).mean(axis=1)


def _edited(text: str, following: str) -> str:
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def _result(ids: list, texts: list[str], following: list[str], part: list, last: list[bool]) -> pa.RecordBatch:
    """A row for each text; where ``last``, what needs the following text is left out and the text kept for later."""
    edited = [_edited(t, f) for t, f in zip(texts, following)]
    own, other, then = (signatures(pa.array(x, pa.string())) for x in (texts, edited, following))
    binary = lambda s: pa.array([r.tobytes() for r in s.astype(">u2")], pa.binary())
    columns = [pa.array(ids, pa.int64()), pa.array([len(t) for t in texts], pa.int64()), pa.array([sha256(e.encode()).hexdigest() for e in edited], pa.string()), binary(own), binary(other),
               pa.array(likeness(own, other), pa.float64()), pa.array(likeness(own, then), pa.float64()), pa.array([part[0]] * len(ids), pa.int64()), pa.array([t if x else None for t, x in zip(texts, last)], pa.string()), pa.array(part[1:], pa.int64())]
    return pa.record_batch(columns, [f.split()[0] for f in ROW.split(", ")])


ROW = "doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint binary, edited_fingerprint binary, near_edited double, near_next double, part bigint, held string, kind bigint"
ROWS = 512


def fingerprints(docs: DataFrame) -> DataFrame:
    """Each text's fingerprint, that of its edited text (its second half replaced by the start of the next document in ascending doc_id
    order, the first following the last), and the likeness of its fingerprint to those of the edited and the next text.

    Documents are range-partitioned and sorted once. A partition's last row needs the first of the next partition: both texts are
    kept in the written result, two for each partition, and joined afterwards.
    """

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, ids, texts = TaskContext.get().partitionId(), [], []
        begun = False
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                text = text.as_py() or ""
                if not begun:
                    begun = True
                    yield _result([doc_id], [text], [""], [part, 1], [True])      # kind 1: a partition's first text
                ids.append(doc_id)
                texts.append(text)
                if len(ids) > ROWS:
                    yield _result(ids[:-1], texts[:-1], texts[1:], [part] + [0] * (len(ids) - 1), [False] * (len(ids) - 1))
                    ids, texts = ids[-1:], texts[-1:]
        if len(ids) > 1:
            yield _result(ids[:-1], texts[:-1], texts[1:], [part] + [0] * (len(ids) - 1), [False] * (len(ids) - 1))
        if ids:
            yield _result(ids[-1:], texts[-1:], [""], [part, 2], [True])           # kind 2: its last text

    def ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for doc_id, text, following in zip(*(c.to_pylist() for c in batch.columns)):
                yield _result([doc_id], [text], [following], [0, 0], [False])

    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = docs.select(F.col("doc_id").cast("bigint"), "text").repartitionByRange(parts, F.col("doc_id")).sortWithinPartitions("doc_id", "text")
    done = materialise(ordered.mapInArrow(rows, ROW), "fingerprints")
    firsts = done.filter("kind = 1").select("part", F.col("held").alias("following"))
    order = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    nexts = firsts.select("part").select(F.col("part").alias("of"), F.coalesce(F.lead("part").over(Window.orderBy("part")), F.first("part").over(order)).alias("part"))
    lasts = done.filter("kind = 2").select("doc_id", "held", F.col("part").alias("of"))
    joined = lasts.join(nexts, "of").join(firsts, "part").select("doc_id", "held", "following").mapInArrow(ends, ROW)
    columns = ["doc_id", "n_chars", "edited_sha256", F.lower(F.hex("fingerprint")).alias("fingerprint"), F.lower(F.hex("edited_fingerprint")).alias("edited_fingerprint"), "near_edited", "near_next"]
    return done.filter("kind = 0").unionByName(joined).select(*columns)


def band_keys(signature: np.ndarray) -> np.ndarray:
    """One row of ``BANDS`` keys for each signature; a band's number is part of its key."""
    out = np.empty((len(signature), BANDS), U64)
    with np.errstate(over="ignore"):
        for band in range(BANDS):
            h = np.full(len(signature), U64(band + 1))
            for k in range(band * BAND_ROWS, (band + 1) * BAND_ROWS):
                h = mix(h * U64(31) + signature[:, k].astype(U64))
            out[:, band] = h
    return out.view(np.int64)


def banded(docs: DataFrame) -> DataFrame:
    """row, doc_id, n (shingles), set_id, parity marks and band keys of every row of ``docs`` (doc_id, text), a written table."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = TaskContext.get().partitionId() << 33
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                facts = [(len(found), set_id(found), parity_marks(found)) for _, found in text_sets(part.column(1), SHINGLE)]
                n, ids, marks = zip(*facts)
                keys = pa.ListArray.from_arrays(pa.array(range(0, BANDS * (len(n) + 1), BANDS), pa.int32()), pa.array(band_keys(signatures(part.column(1))).ravel()))
                yield pa.record_batch([pa.array(range(made, made + len(n)), pa.int64()), part.column(0), pa.array(n, pa.int64()), pa.array(ids, pa.binary()), keys, *(pa.array([m[i] for m in marks], pa.int64()) for i in range(len(MARKS)))],
                                      ["row", "doc_id", "n", "set_id", "keys", *MARKS])
                made += len(n)

    schema = "row bigint, doc_id bigint, n bigint, set_id binary, keys array<bigint>, " + ", ".join(f"{m} bigint" for m in MARKS)
    return materialise(docs.select("doc_id", "text").mapInArrow(rows, schema), "banded", "zstd")


def band_lists(nodes: DataFrame) -> DataFrame:
    """node, n, marks and keys of every node that shares a band key, a written table; a key that one node alone has is left out."""
    entries = nodes.select(F.explode("keys").alias("key"), F.lit(0).alias("at"), F.col("row").alias("node"), F.col("n").cast("int").alias("n"), *MARKS)
    met = materialise(entries.groupBy("key").agg(F.count(F.lit(1)).alias("c")).filter("c > 1").select("key"), "bands-met")
    return materialise(by_node(semi_join(entries, met, "key")), "bands")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, class_id (the smallest doc_id reached by verified links, itself included) of every row of ``docs`` (doc_id,
    text). Empty texts are linked with nothing."""
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    found = grouped(banded(docs), band_lists, lambda nodes: lambda pairs: verified_by_sets(docs, nodes, pairs))
    return found.withColumnRenamed("component_id", "class_id")

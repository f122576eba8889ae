"""Token-id files: a concatenated id array with Elias-Fano encoded document boundaries.

A file image is: magic, number of documents, number of ids, bytes an id, low bits an offset; the boundaries' high bits as a unary
bit vector and low bits packed; the ids. Boundary i is read by select: the place of the i-th one in the high bits, less i, joined with
its low bits. A boundary costs 2 + log2(ids / documents) bits instead of 64. Ids take 2 bytes where the vocabulary allows.

Documents are range-partitioned and sorted by doc_id; each task writes its run of documents as images of about ``IMAGE_IDS`` ids, as
rows of a table in the shared folder, so that any store works and lost executors are no loss. Only the number of ids of each partition
goes to the driver, to give each partition the number of ids before it.

Cases: a null text counts as empty and has only the end id; equal doc_ids are ordered by text, a null doc_id comes first; an empty
table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import json
import struct
from collections.abc import Iterator
from functools import lru_cache
from zlib import crc32

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F
from tokenizers import Tokenizer

from tallyline.llm.common import materialise
from tallyline.llm.pieces import PLAIN, Pieces

VOCABULARY, END_ID = "byte_bpe_50k.json", 2
IMAGE_IDS = 1 << 20
#: Distinct pieces kept by one worker, about 200 bytes each: the library takes most of the time for a piece that is new.
CACHED = 1_500_000
MAGIC = b"IDEF0001"
#: Bytes of high bits for each count of the select table, and documents that a reader looks up at once.
SELECT_BYTES, READ_DOCS = 64, 1024
HEAD = struct.Struct("<8sQQBB")
IMAGES = "part bigint, image bigint, first_id bigint, n_ids bigint, doc_ids array<bigint>, data binary"


def elias_fano(ends: np.ndarray, total: int) -> tuple[int, bytes, bytes]:
    """(low bits, high part, low part) of ascending ``ends``, each at most ``total``."""
    n = len(ends)
    low = max(0, int(total // max(1, n)).bit_length() - 1)
    ends = ends.astype(np.uint64)
    high = np.zeros(n + (total >> low) + 1, np.uint8)
    high[(ends >> np.uint64(low)).astype(np.int64) + np.arange(n)] = 1
    bits = ((ends[:, None] >> np.arange(low, dtype=np.uint64)) & np.uint64(1)).astype(np.uint8)
    return low, np.packbits(high, bitorder="little").tobytes(), np.packbits(bits.ravel(), bitorder="little").tobytes()


class IdFile:
    """Reads an image; ``select`` gives a boundary, ``ids`` a document's ids without reading others.

    Both parts of the boundaries stay packed as they lie in the image. Beside them, one 32-bit count for every ``SELECT_BYTES`` bytes of the high bits tells
    how many ones come before; a boundary is found by that table, by the ones of each byte of its block, and by the bits of one byte.
    """

    def __init__(self, data: bytes):
        magic, self.n, self.total, width, self.low = HEAD.unpack_from(data)
        if magic != MAGIC:
            raise ValueError("not an id file")
        high_bytes, low_bytes = (self.n + (self.total >> self.low) + 8) // 8, (self.n * self.low + 7) // 8
        self.high = np.frombuffer(data, np.uint8, high_bytes, HEAD.size)
        self.low_part = np.frombuffer(data, np.uint8, low_bytes, HEAD.size + high_bytes)
        self.array = np.frombuffer(data, f"<u{width}", self.total, HEAD.size + high_bytes + low_bytes)
        ones = np.add.reduceat(np.bitwise_count(self.high), np.arange(0, high_bytes, SELECT_BYTES), dtype=np.uint32)
        self.before = (np.cumsum(ones, dtype=np.uint32) - ones).astype(np.uint32)

    def _place(self, i: int) -> int:
        """The place of the i-th one among the high bits."""
        block = int(np.searchsorted(self.before, i, "right")) - 1
        part = self.high[block * SELECT_BYTES: (block + 1) * SELECT_BYTES]
        upto = np.cumsum(np.bitwise_count(part), dtype=np.int64)
        left = i - int(self.before[block])
        byte = int(np.searchsorted(upto, left, "right"))
        left -= int(upto[byte - 1]) if byte else 0
        bits = np.flatnonzero(np.unpackbits(part[byte: byte + 1], bitorder="little"))
        return (block * SELECT_BYTES + byte) * 8 + int(bits[left])

    def _low(self, i: int, j: int) -> np.ndarray:
        """The low bits of boundaries i to j - 1, as numbers."""
        first, last = i * self.low, j * self.low
        bits = np.unpackbits(self.low_part[first // 8: (last + 7) // 8], bitorder="little")[first % 8: first % 8 + last - first]
        return bits.reshape(j - i, self.low).astype(np.int64) @ (1 << np.arange(self.low, dtype=np.int64))

    def select(self, i: int) -> int:
        """The end of document i; -1 gives the start of the first."""
        return 0 if i < 0 else (self._place(i) - i) << self.low | int(self._low(i, i + 1)[0])

    def ends(self, i: int, j: int) -> np.ndarray:
        """The ends of documents i to j - 1; what it unpacks follows their number."""
        if i >= j:
            return np.zeros(0, np.int64)
        first, last = self._place(i), self._place(j - 1)
        ones = np.flatnonzero(np.unpackbits(self.high[first // 8: last // 8 + 1], bitorder="little")) + first // 8 * 8
        ones = ones[np.searchsorted(ones, first):][: j - i]
        return ((ones - np.arange(i, j)) << self.low) + self._low(i, j)

    def ids(self, i: int) -> np.ndarray:
        return self.array[self.select(i - 1): self.select(i)]


def image_of(ids: bytes, counts: list[int], width: int) -> bytes:
    """The image of documents of ``counts`` ids each, whose ids, 4 bytes each, are ``ids``."""
    ends = np.cumsum(counts)
    total = int(ends[-1]) if len(ends) else 0
    low, high_part, low_part = elias_fano(ends, total)
    return HEAD.pack(MAGIC, len(counts), total, width, low) + high_part + low_part + np.frombuffer(ids, "<u4").astype(f"<u{width}").tobytes()


def _byte_letters() -> dict[int, str]:
    """The letters that stand for bytes in a byte-level vocabulary: printable ones for themselves, the others for U+0100 and up, in order."""
    printable = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    others = [b for b in range(256) if b not in printable]
    return {b: chr(b) for b in printable} | {b: chr(256 + i) for i, b in enumerate(others)}


BYTE_LETTERS = _byte_letters()


def _splits_as_pattern(tokenizer: Tokenizer) -> bool:
    """Whether the tokenizer does nothing to a match of the pattern but hand its bytes to its model."""
    parts = json.loads(tokenizer.to_str())
    split = parts["pre_tokenizer"] or {}
    return (split.get("type") == "ByteLevel" and split.get("use_regex", True) and not split.get("add_prefix_space") and parts["model"]["type"] == "BPE"
            and not any(parts.get(k) for k in ("normalizer", "truncation", "padding")))


@lru_cache(maxsize=2)
def _encoder(path: str) -> tuple[Pieces, int]:
    tokenizer = Tokenizer.from_file(path)

    def bytes_of(text: str) -> bytes:
        ids = tokenizer.encode(text, None, False, False).ids
        return struct.pack(f"<{len(ids)}I", *ids)

    model = tokenizer.model

    def piece_bytes_of(piece: str) -> bytes:
        """Of one match of the pattern, by the tokenizer's model alone: there is nothing left to split or to normalise."""
        if not piece.isascii():
            if max(piece) >= PLAIN:                              # the library's letters may be others: it splits for itself
                return bytes_of(piece)
            piece = piece.encode().decode("latin-1")
        ids = [token.id for token in model.tokenize(piece.translate(BYTE_LETTERS))]
        return struct.pack(f"<{len(ids)}I", *ids)

    pieces = Pieces(public_tokenizers.PATTERN, piece_bytes_of if _splits_as_pattern(tokenizer) else bytes_of, b"".join)
    pieces.cached, pieces.whole = CACHED, bytes_of
    pieces.special = [t.content for t in tokenizer.get_added_tokens_decoder().values()]
    return pieces, 2 if tokenizer.get_vocab_size(True) <= 1 << 16 else 4


def encode(pieces: Pieces, text: str) -> bytes:
    """The tokenizers library's ids of a text, 4 bytes each. A text that holds an added token goes through the library whole."""
    if any(s in text for s in pieces.special):
        return pieces.whole(text)
    return b"".join(pieces.values_of(text))


def write_images(docs: DataFrame, path: str | None = None, end_id: int = END_ID, image_ids: int = IMAGE_IDS) -> DataFrame:
    """The written images of ``docs`` (doc_id, text) in ascending doc_id order: part, image (in order in a part), ids before it in
    its part, ids in it, its documents, and its bytes."""
    path = path or public_tokenizers.path(VOCABULARY)

    def images(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces, width = _encoder(path)
        end, part = end_id.to_bytes(4, "little"), TaskContext.get().partitionId()
        made = before = size = 0
        ids: list[bytes] = []
        docs_of: list = []

        def image() -> pa.RecordBatch:
            columns = [[part], [made], [before], [size], [docs_of], [image_of(b"".join(ids), [len(x) // 4 for x in ids], width)]]
            types = [pa.int64()] * 4 + [pa.list_(pa.int64()), pa.binary()]
            return pa.record_batch([pa.array(c, t) for c, t in zip(columns, types)], ["part", "image", "first_id", "n_ids", "doc_ids", "data"])

        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids.append(encode(pieces, text.as_py() or "") + end)
                docs_of.append(doc_id)
                size += len(ids[-1]) // 4
                if size >= image_ids:
                    yield image()
                    made, before, size, ids, docs_of = made + 1, before + size, 0, [], []
        if docs_of:
            yield image()

    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = docs.select(F.col("doc_id").cast("bigint"), "text").repartitionByRange(parts, F.col("doc_id")).sortWithinPartitions("doc_id", "text")
    return materialise(ordered.mapInArrow(images, IMAGES), "id-files", "zstd")


def read_documents(images: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, from its image."""
    totals = images.groupBy("part").agg(F.sum("n_ids").alias("n")).orderBy("part").collect()   # one row for each partition
    base, bases = 0, {}
    for row in totals:
        bases[row["part"]], base = base, base + row["n"]

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                file = IdFile(row["data"])
                before = bases[row["part"]] + row["first_id"]
                for i in range(0, file.n, READ_DOCS):
                    j = min(file.n, i + READ_DOCS)
                    at = np.concatenate([[file.select(i - 1)], file.ends(i, j)])
                    sums = [crc32(file.array[a:b].astype("<u4").tobytes()) for a, b in zip(at, at[1:])]
                    yield pa.record_batch([pa.array(row["doc_ids"][i:j], pa.int64()), pa.array(at[:-1] + before, pa.int64()), pa.array(np.diff(at), pa.int64()), pa.array(sums, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    return images.select("part", "first_id", "doc_ids", "data").mapInArrow(rows, "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint")

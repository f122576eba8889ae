"""Byte-level BPE encoding and decoding in linear time, by backtracking over an automaton of all tokens.

Bytes are read as Latin-1, so an automaton over characters finds every token that ends at every byte of a match in one pass. The
encoder goes left to right with the longest token at each place, steps back to a shorter one where the next token does not fit, and
never visits an end again from which no token led on. Two adjacent tokens fit if merging their joined bytes by rank gives just these
two; a sequence in which all neighbours fit is the merge result, and fits are memoised.

Cases: a null text counts as empty and gives no ids; a match that is itself a token is that token, as in the rank library; a byte that
the ranks lack is an error. Rows that repeat stay; other columns are ignored.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from hashlib import sha256

import ahocorasick
import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tallyline.llm.common import held, thrifty
from tallyline.llm.pieces import CACHED, Pieces
from tallyline.llm.words import _spans

VOCABULARY = "byte_bpe_multi_50k.tiktoken"
RESULT = "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string"


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines if line.strip())}


class ByteBpe:
    """Encodes and decodes with one table of ranks."""

    def __init__(self, ranks: dict[bytes, int], pattern: str = public_tokenizers.PATTERN, memo: int = 2_000_000):
        self.ranks, self.memo = ranks, memo
        self.tokens = {rank: token for token, rank in ranks.items()}
        self.automaton = ahocorasick.Automaton()
        for token, rank in ranks.items():
            self.automaton.add_word(token.decode("latin-1"), rank)
        self.automaton.make_automaton()
        self.fits: dict[int, bool] = {}
        self.size = {rank: len(token) for rank, token in self.tokens.items()}
        self.packed = {rank: rank.to_bytes(4, "little") for rank in self.tokens}
        self.spelled = {rank: str(rank) for rank in self.tokens}
        #: Of each token the next shorter one that starts as it does.
        self.prefix = {rank: next((ranks[t[:k]] for k in range(len(t) - 1, 0, -1) if t[:k] in ranks), None) for rank, t in self.tokens.items()}
        n = self.none = max(self.tokens) + 1
        self.lengths = np.array([len(self.tokens.get(i, b"")) for i in range(n)], np.int64)
        self.offsets = np.concatenate([[0], np.cumsum(self.lengths)])
        self.blob = np.frombuffer(b"".join(self.tokens.get(i, b"") for i in range(n)), np.uint8)
        self.pieces = Pieces(pattern, self._value, self._joined)

    def merge(self, data: bytes) -> list[int]:
        """By definition: join the neighbours of lowest rank, the leftmost first, until none is a token. For short strings."""
        rank, none = self.ranks.get, self.none
        parts = [data[i: i + 1] for i in range(len(data))]
        ranked = [rank(data[i: i + 2], none) for i in range(len(data) - 1)]
        while ranked and (best := min(ranked)) < none:
            i = ranked.index(best)
            parts[i: i + 2] = [parts[i] + parts[i + 1]]
            del ranked[i]
            if i:
                ranked[i - 1] = rank(parts[i - 1] + parts[i], none)
            if i < len(ranked):
                ranked[i] = rank(parts[i] + parts[i + 1], none)
        return [self.ranks[p] for p in parts]

    def _fit(self, a: int, b: int) -> bool:
        """b can follow a (-1: start a match): it comes out of its own merges, and the two stay apart when their joined bytes are merged."""
        if len(self.fits) >= self.memo:
            self.fits.clear()
        joined = self.tokens[b] if a < 0 else self.tokens[a] + self.tokens[b]
        known = self.merge(joined) == ([b] if a < 0 else [a, b])
        self.fits[(a + 1) << 32 | b] = known
        return known

    def encode_match(self, data: bytes) -> list[int]:
        if data in self.ranks:
            return [self.ranks[data]]
        n, letters, longest = len(data), data.decode("latin-1"), self.automaton.iter_long
        fits, size, fit, shorter = self.fits.get, self.size, self._fit, self.prefix.get
        ends, at, last = longest(letters), 0, -1                    # all longest tokens, one after the other, while nothing is stepped back
        dead: set[int] = set()
        path: list[int] = []
        while at < n:
            token = first = next(ends)[1]
            while True:
                while token is not None:
                    fitting = fits((last + 1) << 32 | token)
                    if (fit(last, token) if fitting is None else fitting) and at + size[token] not in dead:
                        break
                    token = shorter(token)
                if token is not None:
                    break
                if not path:
                    raise ValueError("the ranks can't spell this text")
                dead.add(at)                                        # nothing leads on from here: step back to a shorter token before
                token = path.pop()
                at -= size[token]
                token, last, first = shorter(token), path[-1] if path else -1, None
            path.append(token)
            at, last = at + size[token], token
            if token != first and at < n:
                ends = longest(letters, at)
        return path

    def _value(self, match: str) -> tuple[bytes, str]:
        ids = self.encode_match(match.encode("utf-8"))
        return b"".join([self.packed[i] for i in ids]), ",".join([self.spelled[i] for i in ids])

    @staticmethod
    def _joined(values: list[tuple[bytes, str]]) -> tuple[bytes, str]:
        return b"".join(v[0] for v in values), ",".join(v[1] for v in values)

    def encode(self, text: str) -> tuple[np.ndarray, str]:
        """The ids, and the ids as decimal numbers with commas between."""
        values = self.pieces.values_of(text)
        return np.frombuffer(b"".join([v[0] for v in values]), "<u4"), ",".join([v[1] for v in values])

    def decode(self, ids: np.ndarray) -> bytes:
        """The bytes of the ids' tokens, gathered from one table of all tokens' bytes."""
        ids = ids.astype(np.int64)
        return self.blob[_spans(self.offsets[ids], self.lengths[ids])].tobytes() if len(ids) else b""


def coder(path: str) -> ByteBpe:
    return held(f"byte BPE {path}", lambda: ByteBpe(load_ranks(path)))


def _rows(batches: Iterator[pa.RecordBatch], path: str, pieces: int) -> Iterator[pa.RecordBatch]:
    bpe = coder(path)
    bpe.pieces.cached = pieces
    for batch in batches:
        texts = batch.column(1)
        out: list[list] = [[], [], []]
        for value in texts:
            ids, spelled = bpe.encode(value.as_py() or "")
            out[0].append(len(ids))
            out[1].append(sha256(spelled.encode()).hexdigest())
            out[2].append(sha256(bpe.decode(ids)).hexdigest())
        yield pa.record_batch([batch.column(0), pa.array(out[0], pa.int64()), pa.array(out[1], pa.string()), pa.array(out[2], pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])


def encoded_digests(docs: DataFrame, path: str | None = None, pieces: int = CACHED) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every row of ``docs`` (doc_id, text). A worker keeps ``pieces`` pieces of texts, some 330 bytes each."""
    path = path or public_tokenizers.path(VOCABULARY)
    return docs.select(F.col("doc_id").cast("bigint"), "text").mapInArrow(thrifty(lambda b: _rows(b, path, pieces)), RESULT)


def encoded(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id and the ids themselves."""
    path = path or public_tokenizers.path(VOCABULARY)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = coder(path)
        for batch in batches:
            ids = [bpe.encode(t.as_py() or "")[0].astype(np.int32) for t in batch.column(1)]
            yield pa.record_batch([batch.column(0), pa.array(ids, pa.list_(pa.int32()))], ["doc_id", "ids"])

    return docs.select(F.col("doc_id").cast("bigint"), "text").mapInArrow(rows, "doc_id bigint, ids array<int>")


def decoded(ids: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id and the text of its ids; bytes that are no UTF-8 are replaced."""
    path = path or public_tokenizers.path(VOCABULARY)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = coder(path)
        for batch in batches:
            texts = [bpe.decode(np.array(x.as_py() or [], np.int64)).decode("utf-8", "replace") for x in batch.column(1)]
            yield pa.record_batch([batch.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    return ids.select("doc_id", "ids").mapInArrow(rows, "doc_id bigint, text string")

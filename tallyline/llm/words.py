"""Words and word shingles of UTF-8 texts as 64-bit hashes, computed over whole chunks of texts with numpy.

A word is a run of bytes other than space and 0x09-0x0D. ASCII letters are lower-cased. The hash of a word is a polynomial in an
odd base over a random value for each byte, read off one running sum of the chunk; a shingle's hash mixes its words' hashes in order.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa

U64 = np.uint64
SPACES = [0x20, *range(0x09, 0x0E)]
CHUNK_BYTES = 1 << 20
BASE, STEP = U64(0x9E3779B97F4A7C15), U64(0xD6E8FEB86659FD93)


@lru_cache(maxsize=1)
def _tables() -> tuple[np.ndarray, np.ndarray]:
    """Of each byte: its random value, with capitals as small letters; whether it is part of a word."""
    values = np.random.default_rng(20240229).integers(1, 2**64, 256, dtype=U64)
    values[65:91] = values[97:123]
    inside = np.ones(256, bool)
    inside[SPACES] = False
    return values, inside


@lru_cache(maxsize=1)
def _powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and BASE**-i modulo 2**64 for i < size."""
    inverse = U64(pow(int(BASE), -1, 2**64))
    with np.errstate(over="ignore"):
        return tuple(np.cumprod(np.concatenate([[U64(1)], np.full(size - 1, b, U64)]), dtype=U64) for b in (BASE, inverse))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> U64(32))) * U64(0xD6E8FEB86659FD93)
        x = (x ^ (x >> U64(29))) * U64(0xBF58476D1CE4E5B9)
        return x ^ (x >> U64(32))


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and n + 1 offsets of a column of texts; a null is an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.fill_null("").cast(pa.large_binary())
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64, len(column) + 1, column.offset * 8)
    return (np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)), at


def word_hashes(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of the texts data[at[i]:at[i+1]] in order, and n + 1 offsets of each text's words."""
    lo, hi = int(at[0]), int(at[-1])
    data, at = data[lo:hi], at - lo
    if not len(data):
        return np.zeros(0, U64), np.zeros(len(at), np.int64)
    values, inside = _tables()
    word = inside[data]
    first = word.copy()
    first[1:] &= ~word[:-1]
    last = word.copy()
    last[:-1] &= ~word[1:]
    cuts = at[1:-1]                                   # texts touch each other: a word ends where its text ends
    cuts = cuts[(cuts > 0) & (cuts < len(data))]
    first[cuts] = word[cuts]
    last[cuts - 1] = word[cuts - 1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    size = 1 << max(20, int(len(data)).bit_length())
    up, down = _powers(size)
    with np.errstate(over="ignore"):
        run = np.zeros(len(data) + 1, U64)
        np.cumsum(values[data] * up[: len(data)], out=run[1:])
        hashes = mix((run[ends] - run[starts]) * down[starts])
    return hashes, np.searchsorted(starts, at)


def shingle_hashes(data: np.ndarray, at: np.ndarray, size: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of each text's shingles of ``size`` words in order, with offsets. A text with fewer words, but one at least, has one
    shingle: the whole sequence."""
    words, of = word_hashes(data, at)
    counts = np.diff(of)
    short = (counts > 0) & (counts < size)
    n = np.where(counts >= size, counts - size + 1, short.astype(np.int64))
    out_at = np.concatenate([[0], np.cumsum(n)])
    if not len(words):
        return np.zeros(0, U64), out_at
    with np.errstate(over="ignore"):
        rolled = np.zeros(max(0, len(words) - size + 1), U64)
        for k in range(size):
            rolled = rolled * STEP + words[k: len(words) - size + 1 + k] if len(rolled) else rolled
        out = np.zeros(out_at[-1], U64)
        long = np.flatnonzero(counts >= size)
        if len(long):
            take = np.repeat(of[long] - out_at[long], n[long]) + _spans(out_at[long], n[long])
            out[_spans(out_at[long], n[long])] = mix(rolled[take] + U64(size))
        for i in np.flatnonzero(short):
            h = U64(0)
            for w in words[of[i]: of[i + 1]]:
                h = h * STEP + w
            out[out_at[i]] = mix(np.array([h + U64(counts[i])], U64))[0]
    return out, out_at


def _spans(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """starts[i], starts[i] + 1, ... for lengths[i] values each, one after the other."""
    ends = np.cumsum(lengths)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - (ends - lengths), lengths)


def chunks(at: np.ndarray, size: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges [i, j) of texts of about ``size`` bytes together, a longer text alone: what numpy holds follows the longest text."""
    i, n = 0, len(at) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(at, at[i] + size, "right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


def text_sets(column: pa.Array, size: int = 5) -> Iterator[tuple[int, np.ndarray]]:
    """(row, sorted distinct shingle hashes) of every text."""
    data, at = text_buffers(column)
    for i, j in chunks(at):
        hashes, of = shingle_hashes(data, at[i: j + 1], size)
        for k in range(j - i):
            yield i + k, np.unique(hashes[of[k]: of[k + 1]])

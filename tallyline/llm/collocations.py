"""Phrase collocations by Toivonen mining: a sample proposes, one pass counts, border failures are expanded until the border holds.

Phrases are runs of one to three words inside a piece of a text. In the sample, phrases seen often enough for a lowered limit
are proposed; with them goes their negative border, the phrases that aren't proposed while all their shorter parts are. One pass over
the corpus counts both: a phrase is counted if its first part (without the last word) and its last part (without the first)
are proposed, so words are always counted. A frequent phrase that wasn't proposed is a border failure: phrases over it were not counted. Failures are
added to the proposals, and a further pass counts just what they newly let in, until no failure is left; each pass settles one more
length at least, so there are at most as many passes as lengths.

The mining passes count by one 64-bit hash of a phrase, so that a counted phrase costs 8 bytes and its count. Two phrases of one hash are counted
together, which can only raise a count: no frequent phrase is missed. A last pass counts what is frequent by hash once more, by the words themselves, and drops what
isn't. What a task asks of the proposals, and of the frequent phrases, is a table of ``FILTER_BITS`` bits, the same at every size of the corpus; a phrase that it takes for
one of them is counted too, in one pass exactly, and judged by its count. Counts are combined in each task over windows of ``WINDOW_WORDS`` words, then on Spark's map
side, then by key. Words are told apart by 64-bit hashes of language and word; frequent words keep their text, and are counted by it.

Cases: a null text is empty; a null language is ``und``; a language may hold any string; rows that repeat are counted as rows; one very long text is
worked through in pieces like many short ones; an empty table, or one without frequent phrases, gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from hashlib import sha256

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window, functions as F

from tallyline.llm.common import materialise, small_batches, thrifty
from tallyline.llm.words import BASE, STEP, U64, mix, text_buffers

MIN_COUNT, TOP, SHARE = 10, 2000, 50
NO_LANGUAGE = "und"
#: One of so many documents is in the sample; a phrase is proposed if it stands there so often.
SAMPLE, PROPOSED = 4, 2
FILTER_BITS = 26
WINDOW_WORDS, CHUNK_BYTES = 1 << 19, 1 << 19
#: Rows of a side that is broadcast to a join of phrases: below 10 MB as a hash table.
SMALL_ROWS = 1 << 16

GAPS, BREAKS = b" \t", b".,;:!?\n\x0b\x0c\r"
HASHED = "key bigint, size int, n bigint"
COUNTS = "lang string, word string, size int, w1 bigint, w2 bigint, w3 bigint, n bigint"
KEYS = ["lang", "word", "size", "w1", "w2", "w3"]


@lru_cache(maxsize=1)
def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of each byte: its random value (capitals as small letters), whether it is in a word, whether it breaks; powers of BASE and of its inverse."""
    values = np.random.default_rng(20250607).integers(1, 2**64, 256, dtype=U64)
    values[65:91] = values[97:123]
    inside, breaks = np.ones(256, bool), np.zeros(256, bool)
    inside[list(GAPS + BREAKS)] = False
    breaks[list(BREAKS)] = True
    return values, inside, breaks, _powers(2 * CHUNK_BYTES)


@lru_cache(maxsize=4)
def _powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    with np.errstate(over="ignore"):
        return tuple(np.cumprod(np.concatenate([[U64(1)], np.full(size - 1, b, U64)]), dtype=U64) for b in (BASE, U64(pow(int(BASE), -1, 2**64))))


def pieces_of(data: np.ndarray, cuts: np.ndarray) -> Iterator[tuple[int, int]]:
    """Ranges of about ``CHUNK_BYTES`` bytes that end where a text or a piece ends. What a task holds follows the longest piece."""
    breaks, at, end = _tables()[2], 0, len(data)
    while at < end:
        to = min(end, at + CHUNK_BYTES)
        if to < end:
            i = int(np.searchsorted(cuts, to, "right"))
            if i and cuts[i - 1] > at:
                to = int(cuts[i - 1])
            else:                                        # inside one text: on to its next break or its end
                stop = int(cuts[i]) if i < len(cuts) else end
                while to < stop:
                    step = np.flatnonzero(breaks[data[to: min(stop, to + CHUNK_BYTES)]])
                    if len(step):
                        stop = to = to + int(step[0]) + 1
                    else:
                        to = min(stop, to + CHUNK_BYTES)
        yield at, to
        at = to


def words_of(data: np.ndarray, cuts: np.ndarray, seed: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of the bytes' words in order: hash, first byte, end, and whether the next word is in the same piece. ``cuts`` are the places
    inside at which a text ends."""
    values, inside, breaks, powers = _tables()
    word = inside[data]
    first = word.copy()
    first[1:] &= ~word[:-1]
    last = word.copy()
    last[:-1] &= ~word[1:]
    first[cuts] = word[cuts]
    last[cuts - 1] = word[cuts - 1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    if not len(starts):
        return np.zeros(0, U64), starts, ends, np.zeros(0, bool)
    up, down = powers if len(data) <= len(powers[0]) else _powers(1 << int(len(data)).bit_length())
    with np.errstate(over="ignore"):
        run = np.zeros(len(data) + 1, U64)
        np.cumsum(values[data] * up[: len(data)], out=run[1:])
        hashes = mix((run[ends] - run[starts]) * down[starts] + U64(seed))
    ending = breaks[data]
    piece = np.cumsum(ending, dtype=np.int32)[starts]
    text = np.searchsorted(cuts, starts, "right")
    follows = np.zeros(len(starts), bool)
    follows[:-1] = (piece[1:] == piece[:-1]) & (text[1:] == text[:-1])
    return hashes, starts, ends, follows


def pair_hash(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return mix(a * STEP + b + U64(1))


class Proposed:
    """Set bits for proposed phrases; holds whatever was added and now and then something else."""

    def __init__(self, bits: np.ndarray):
        self.bits = bits

    @staticmethod
    def places(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return (hashes >> U64(64 - FILTER_BITS)).astype(np.int64), (hashes & U64((1 << FILTER_BITS) - 1)).astype(np.int64)

    def has(self, hashes: np.ndarray) -> np.ndarray:
        a, b = self.places(hashes)
        return (self.bits[a >> 3] >> (a & 7).astype(np.uint8) & 1 & (self.bits[b >> 3] >> (b & 7).astype(np.uint8))).astype(bool)


def _filter_cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(cell, bits): the filter's set bits of a task's keys, 64 a cell."""
    for batch in batches:
        places = np.concatenate(Proposed.places(batch.column(0).to_numpy(zero_copy_only=False).view(U64)))
        cells, at = np.unique(places >> 6, return_inverse=True)
        bits = np.zeros(len(cells), U64)
        np.bitwise_or.at(bits, at, U64(1) << (places & 63).astype(U64))
        yield pa.record_batch([pa.array(cells, pa.int64()), pa.array(bits.view(np.int64))], ["cell", "bits"])


def filter_of(keys: DataFrame, old: np.ndarray | None = None) -> np.ndarray:
    """The table of the phrases with ``keys``, added to ``old``. The driver gets its set cells: 16 MB at most."""
    cells = keys.select("key").mapInArrow(thrifty(_filter_cells), "cell bigint, bits bigint").groupBy("cell").agg(F.expr("bit_or(bits)").alias("bits")).toArrow()
    out = np.zeros(1 << (FILTER_BITS - 6), U64) if old is None else old.view(U64).copy()
    out[cells["cell"].to_numpy()] |= cells["bits"].to_numpy().view(U64)
    return out.view(np.uint8)


class Spans:
    """A chunk's words of one language: hashes, bytes, and where two or three of them are in one piece."""

    def __init__(self, lang: str, raw: np.ndarray, w: np.ndarray, starts: np.ndarray, ends: np.ndarray, follows: np.ndarray):
        self.lang, self.raw, self.w, self.starts, self.ends = lang, raw, w, starts, ends
        self.two = np.flatnonzero(follows)
        self.three = self.two[follows[self.two + 1]] if len(self.two) else self.two
        self.pairs = np.zeros(len(w), U64)
        self.pairs[self.two] = pair_hash(w[self.two], w[self.two + 1])

    def triples(self, at: np.ndarray) -> np.ndarray:
        return pair_hash(self.pairs[at], self.w[at + 2])


def _spans(batches: Iterator[pa.RecordBatch]) -> Iterator[Spans]:
    """The words of all texts, chunk by chunk, one language at a time."""
    for batch in batches:
        langs = batch.column(1).fill_null(NO_LANGUAGE)
        for lang in langs.unique().to_pylist():
            data, at = text_buffers(batch.column(0).filter(pc.equal(langs, lang)))
            data, at = data[int(at[0]): int(at[-1])], at - at[0]
            seed = int.from_bytes(sha256(lang.encode()).digest()[:8], "little")
            cuts = at[1:-1]
            cuts = np.unique(cuts[(cuts > 0) & (cuts < len(data))])
            for lo, hi in pieces_of(data, cuts):
                inner = cuts[np.searchsorted(cuts, lo, "right"): np.searchsorted(cuts, hi)] - lo
                w, starts, ends, follows = words_of(data[lo:hi], inner, seed)
                if len(w):
                    yield Spans(lang, data[lo:hi], w, starts, ends, follows)


def _hashed(batches: Iterator[pa.RecordBatch], now: Broadcast | None, before: Broadcast | None, sizes: tuple[int, ...]) -> Iterator[pa.RecordBatch]:
    """(key, size, n) of the phrases of ``sizes`` that ``now`` lets in and ``before`` didn't; without ``now``, of all."""
    allowed = Proposed(np.frombuffer(now.value, np.uint8)) if now else None
    done = Proposed(np.frombuffer(before.value, np.uint8)) if before else None
    held: dict[int, list[np.ndarray]] = {size: [] for size in sizes}
    words = 0

    def let_in(at: np.ndarray, hashes: np.ndarray) -> np.ndarray:
        """Of the places ``at``, those whose two parts, in ``hashes`` there and one place later, make them new phrases."""
        if allowed is None:
            return at
        at = at[allowed.has(hashes[at])]
        at = at[allowed.has(hashes[at + 1])]
        return at if done is None else at[~(done.has(hashes[at]) & done.has(hashes[at + 1]))]

    def flush() -> Iterator[pa.RecordBatch]:
        for size, parts in held.items():
            if parts:
                keys, n = np.unique(np.concatenate(parts), return_counts=True)
                parts.clear()
                for i in range(0, len(keys), 65536):
                    some = slice(i, i + 65536)
                    yield pa.record_batch([pa.array(keys[some].view(np.int64)), pa.array(np.full(len(keys[some]), size, np.int32)), pa.array(n[some].astype(np.int64))], ["key", "size", "n"])

    for s in _spans(batches):
        if 1 in sizes:
            held[1].append(s.w)
        if 2 in sizes:
            held[2].append(s.pairs[let_in(s.two, s.w)])
        if 3 in sizes:
            held[3].append(s.triples(let_in(s.three, s.pairs)))
        words += len(s.w)
        if words >= WINDOW_WORDS:
            yield from flush()
            words = 0
    yield from flush()


def _exact(batches: Iterator[pa.RecordBatch], wanted: Broadcast) -> Iterator[pa.RecordBatch]:
    """lang, word, size, w1, w2, w3, n of the phrases that ``wanted`` has, and of all other words of a language together, as size 0."""
    known = Proposed(np.frombuffer(wanted.value, np.uint8))
    held: dict[str, list[Spans]] = {}
    words = 0

    def rows(lang: str, size: int, parts: list[np.ndarray], n: np.ndarray, texts: list[str] | None) -> Iterator[pa.RecordBatch]:
        for i in range(0, len(n), 32768):
            some = slice(i, i + 32768)
            m = len(n[some])
            yield pa.record_batch([
                pa.array([lang] * m, pa.string()), pa.array(texts[some], pa.string()) if texts else pa.nulls(m, pa.string()), pa.array(np.full(m, size, np.int32)),
                *[pa.array(parts[k][some].view(np.int64)) if k < len(parts) else pa.nulls(m, pa.int64()) for k in range(3)], pa.array(n[some].astype(np.int64))], [c.split(" ")[0] for c in COUNTS.split(", ")])

    def grouped(parts: list[np.ndarray]) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
        """Distinct tuples, how often each stands, and the place of one of them."""
        key = parts[0]
        for p in parts[1:]:
            key = pair_hash(key, p)
        order = np.argsort(key, kind="stable")
        parts = [p[order] for p in parts]
        new = np.zeros(len(order), bool)
        new[:1] = True
        for p in parts:
            new[1:] |= p[1:] != p[:-1]
        at = np.flatnonzero(new)
        return [p[at] for p in parts], np.diff(np.append(at, len(order))), order[at]

    def flush() -> Iterator[pa.RecordBatch]:
        for lang, chunks in held.items():
            singles, where, rest = [], [], 0
            for c, s in enumerate(chunks):
                i = np.flatnonzero(known.has(s.w))
                singles.append(s.w[i])
                where.append(np.stack([np.full(len(i), c), s.starts[i], s.ends[i]]))
                rest += len(s.w) - len(i)
            if rest:
                yield from rows(lang, 0, [], np.array([rest]), None)
            (w,), n, place = grouped([np.concatenate(singles)])
            of = np.concatenate(where, axis=1)[:, place].T.tolist()
            raws = [s.raw.tobytes() for s in chunks]
            yield from rows(lang, 1, [w], n, [raws[c][a:b].translate(_LOWER).decode("utf-8", "replace") for c, a, b in of])
            for size in (2, 3):
                found = []
                for s in chunks:
                    at = s.two if size == 2 else s.three
                    at = at[known.has(s.pairs[at] if size == 2 else s.triples(at))]
                    found.append([s.w[at + k] for k in range(size)])
                parts, n, _ = grouped([np.concatenate([f[k] for f in found]) for k in range(size)])
                yield from rows(lang, size, parts, n, None)
        held.clear()

    for s in _spans(batches):
        held.setdefault(s.lang, []).append(s)
        words += len(s.w)
        if words >= WINDOW_WORDS:
            yield from flush()
            words = 0
    yield from flush()


_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("text"), F.col("lang").cast("string").alias("lang"))


def hashed_counts(docs: DataFrame, now: np.ndarray | None, before: np.ndarray | None, sizes: tuple[int, ...]) -> DataFrame:
    """key, size, n of every counted phrase."""
    context = docs.sparkSession.sparkContext
    told = [context.broadcast(bits.tobytes()) if bits is not None else None for bits in (now, before)]
    return _texts(docs).mapInArrow(thrifty(lambda batches: _hashed(batches, *told, sizes)), HASHED).groupBy("key", "size").agg(F.sum("n").alias("n"))


def _failures(found: DataFrame, bits: np.ndarray) -> DataFrame:
    """The frequent words and pairs that were not proposed."""
    told = found.sparkSession.sparkContext.broadcast(bits.tobytes())

    def failures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Proposed(np.frombuffer(told.value, np.uint8))
        for batch in batches:
            yield batch.filter(pa.array(~known.has(batch.column(0).to_numpy(zero_copy_only=False).view(U64))))

    return materialise(found.filter("size < 3").select("key").mapInArrow(thrifty(failures), "key bigint"), "phrase-failures")


def mined_keys(docs: DataFrame, min_count: int = MIN_COUNT, sample: int = SAMPLE, proposed: int = PROPOSED) -> DataFrame:
    """The hashes of all phrases with at least ``min_count`` occurrences (and perhaps a few others): the sample, the full pass, and expansions."""
    drawn = F.xxhash64("text", "lang", *(["doc_id"] if "doc_id" in docs.columns else []))
    some = docs.filter(F.pmod(drawn, F.lit(sample)) == 0)
    bits, before, sizes = filter_of(hashed_counts(some, None, None, (1, 2)).filter(F.col("n") >= proposed)), None, (1, 2, 3)
    kept = None
    while True:
        found = materialise(hashed_counts(docs, bits, before, sizes).filter(F.col("n") >= min_count), "phrases")
        kept = found if kept is None else kept.unionByName(found)
        failed = _failures(found, bits)
        if not failed.count():
            return kept
        sizes = (2, 3) if sizes[0] == 1 else (3,)
        before, bits = bits, filter_of(failed, bits)


def frequent_phrases(docs: DataFrame, min_count: int = MIN_COUNT, sample: int = SAMPLE, proposed: int = PROPOSED) -> tuple[DataFrame, DataFrame]:
    """(lang, n of all words), and the phrases of 1 to 3 words with at least ``min_count`` occurrences: lang, word, size, w1, w2, w3, n."""
    wanted = docs.sparkSession.sparkContext.broadcast(filter_of(mined_keys(docs, min_count, sample, proposed)).tobytes())
    rows = _texts(docs).mapInArrow(thrifty(lambda batches: _exact(batches, wanted)), COUNTS)
    exact = rows.groupBy(*KEYS).agg(F.sum("n").alias("n"))
    # words that are rare after all join their language's others
    rare = (F.col("size") < 2) & (F.col("n") < min_count)
    marked = exact.filter((F.col("size") < 2) | (F.col("n") >= min_count)).select("lang", *[F.when(~rare, F.col(c)).alias(c) for c in KEYS[1:]], "n")
    found = materialise(marked.groupBy(*KEYS).agg(F.sum("n").alias("n")), "phrases")
    totals = materialise(found.filter("size IS NULL OR size < 2").groupBy("lang").agg(F.sum("n").alias("all_words")), "phrase-totals")
    return totals, found.filter("size > 0")


def _joined(df: DataFrame, small: DataFrame, on: list[str], rows: int) -> DataFrame:
    """A join with a counted side: broadcast up to ``SMALL_ROWS`` rows; above, shuffled, and hot words are split by adaptive execution."""
    return df.join(F.broadcast(small) if rows <= SMALL_ROWS else small, on)


def scored(phrases: DataFrame, share: int = SHARE) -> DataFrame:
    """lang, size, w1, w2, w3, a, l, r, score of the candidates that no longer one takes in."""
    words = materialise(phrases.filter("size = 1").select("lang", F.col("w1").alias("w"), "n"), "frequent-words")
    n_words = words.count()
    pairs = phrases.filter("size = 2").select("lang", "w1", "w2", F.col("n").alias("a"))
    threes = materialise(phrases.filter("size = 3").select("lang", "w1", "w2", "w3", F.col("n").alias("a")), "frequent-threes")
    of = lambda w, n: words.select("lang", F.col("w").alias(w), F.col("n").alias(n))       # noqa: E731
    head = pairs.select("lang", "w1", "w2", F.col("a").alias("of_head"))
    tail = pairs.select("lang", F.col("w1").alias("w2"), F.col("w2").alias("w3"), F.col("a").alias("of_tail"))
    n_pairs = pairs.count()
    triple = _joined(_joined(threes, head, ["lang", "w1", "w2"], n_pairs), tail, ["lang", "w2", "w3"], n_pairs)
    triple = _joined(_joined(triple, of("w1", "of_first"), ["lang", "w1"], n_words), of("w3", "of_last"), ["lang", "w3"], n_words)
    taken = threes.select("lang", "a", F.explode(F.array(F.struct("w1", "w2"), F.struct(F.col("w2").alias("w1"), F.col("w3").alias("w2")))).alias("p")).groupBy("lang", "p.w1", "p.w2").agg(F.max("a").alias("longer"))
    alone = pairs.join(taken, ["lang", "w1", "w2"], "left").filter((F.col("longer").isNull()) | (100 * F.col("longer") < share * F.col("a"))).drop("longer")
    double = _joined(_joined(alone, of("w1", "l"), ["lang", "w1"], n_words), of("w2", "r"), ["lang", "w2"], n_words)
    one = double.select("lang", F.lit(2).alias("size"), "w1", "w2", F.lit(None).cast("bigint").alias("w3"), "a", "l", "r", _score("a", "l", "r").alias("score"))
    cuts = [F.struct(_score("a", *k).alias("score"), F.lit(at).alias("k"), F.col(k[0]).alias("l"), F.col(k[1]).alias("r")) for at, k in ((1, ("of_first", "of_tail")), (2, ("of_head", "of_last")))]
    least = triple.withColumn("cut", F.array_min(F.array(*cuts)))
    return one.unionByName(least.select("lang", F.lit(3).alias("size"), "w1", "w2", "w3", "a", "cut.l", "cut.r", "cut.score"))


def _score(a: str, l: str, r: str) -> Column:
    """floor(1000000 * a * a / (l * r)) in whole numbers of 38 digits: exact for counts below 10**14."""
    return F.expr(f"CAST((CAST({a} AS DECIMAL(14,0)) * CAST({a} AS DECIMAL(14,0)) * CAST(1000000 AS DECIMAL(7,0))) DIV (CAST({l} AS DECIMAL(14,0)) * CAST({r} AS DECIMAL(14,0))) AS BIGINT)")


def collocations(docs: DataFrame, min_count: int = MIN_COUNT, top: int = TOP, share: int = SHARE, sample: int = SAMPLE, proposed: int = PROPOSED) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: the first ``top`` candidates of each language in ``docs`` (text, lang)."""
    with small_batches(docs.sparkSession):
        totals, phrases = frequent_phrases(docs, min_count, sample, proposed)
    candidates = materialise(scored(phrases, share), "phrase-candidates")
    # the score and count of each language's last place: row_number lets each task pass ``top`` rows on, ties are cut anywhere
    level = Window.partitionBy("lang").orderBy(F.col("score").desc(), F.col("a").desc(), "w1", "w2", "w3")
    first = candidates.select("lang", "score", "a", "w1", "w2", "w3").withColumn("rank", F.row_number().over(level)).filter(F.col("rank") <= top)
    lowest = materialise(first.groupBy("lang").agg(F.min(F.struct("score", "a")).alias("least")), "phrase-levels")
    near = _joined(candidates, lowest, ["lang"], lowest.count()).filter(F.struct("score", "a") >= F.col("least")).drop("least")
    words = materialise(phrases.filter("size = 1").select("lang", "w1", "word"), "phrase-words")
    n_words = words.count()
    for k in (1, 2, 3):
        side = words.select("lang", F.col("w1").alias(f"w{k}"), F.col("word").alias(f"t{k}"))
        near = near.join(F.broadcast(side) if n_words <= SMALL_ROWS else side, ["lang", f"w{k}"], "left")
    named = near.withColumn("phrase", F.concat_ws(" ", "t1", "t2", "t3"))
    order = Window.partitionBy("lang").orderBy(F.col("score").desc(), F.col("a").desc(), "phrase")
    ranked = named.select("lang", "phrase", "a", "l", "r", "score").withColumn("rank", F.row_number().over(order).cast("bigint")).filter(F.col("rank") <= top)
    return _joined(ranked, totals, ["lang"], totals.count()).select("lang", "rank", "phrase", "a", "l", "r", F.col("all_words").alias("n"), "score")

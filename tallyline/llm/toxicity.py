"""Toxicity scores from a support vector machine on a gapped subsequence kernel, with Nystroem landmarks.

The kernel of two strings sums, over common subsequences of ``ORDER`` characters, a decay for every character spanned, so insults with
inserted, dropped or spaced-out characters stay near the plain word. A sentence is represented by its units (words, letters and digits
only; runs of single letters are also read as one word), and its margin is that of its most toxic unit: training alternates between
fitting the machine and choosing each labelled sentence's unit; typical units are also learned with letters put in and left out. A document's score is a logistic function of its two highest sentence
margins, so all of the text counts and its length doesn't.

Training: of the labelled documents outside the held-out fold, the ``TRAINING`` toxic and as many clean ones with the least digest of
their id (a bounded sample; toxic ones first known from their label, clean ones weighted back to their share). Sentences of clean
documents have label 0; of toxic documents, the sentences with the units that are most typical of toxic documents have label 1. All
documents are scored. Labels, language, source and id are no inputs of a score.

Cases: a null text counts as empty; an empty text, or one without letters, has the score of margins at the floor; repeated rows get the
same score; without labels of both kinds every score is 0; a row with a null doc_id is in no fold and not held out.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations
from math import exp, lgamma, log

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from tallyline.llm.common import free_name, let_go, materialise

ORDER, DECAY = 3, 0.9
LONGEST, STEP = 14, 7
OTHERS = 8                       # landmarks of each kind that are no seeds, at least
LANDMARKS = 48
NEW = 0.5                        # part of a typical string that the landmarks before it don't span, for it to be one
ENOUGH = 6                       # tenths of a typical string that a unit has in order
UNLIKELY = 0.01                  # units that pass for typical of toxic documents by chance, in expectation
GUESSES = 32                     # seeds of a sample in which no unit is beyond chance
TRAINING = 1500
FOLDS = 5
CACHED = 200_000               # chunks and units whose margin a task remembers
FLOOR = -2.0
RUN = re.compile(r"(?<![^\W_])[^\W_](?:[\W_]{1,3}[^\W_](?![^\W_])){2,}")
BETWEEN = re.compile(r"[\W_]+")
SENTENCE = re.compile(r"[.!?\n]+(?=\s|\Z)|\n")


def fold_of(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % FOLDS


def plain(chunk: str) -> str:
    """A chunk's letters and digits."""
    return chunk if chunk.isalnum() else BETWEEN.sub("", chunk)


def chunks_of(text: str) -> list[str]:
    """Chunks between white space, in lower case, and the runs of single letters as words of their own."""
    text = text.lower()
    return text.split() + [BETWEEN.sub("", m) for m in RUN.findall(text)]


def windows(unit: str) -> list[str]:
    """A unit of up to ``LONGEST`` characters, a longer one in overlapping windows."""
    if len(unit) <= LONGEST:
        return [unit]
    return [unit[i: i + LONGEST] for i in range(0, len(unit) - STEP, STEP)]


def _codes(units: list[str], width: int) -> np.ndarray:
    """Code points padded with zeros."""
    return np.array([u[:width].ljust(width, "\0") for u in units], dtype=f"<U{width}").reshape(-1, 1).view(np.uint32).reshape(len(units), width) if units else np.zeros((0, width), np.uint32)


def kernel(units: list[str], others: list[str]) -> np.ndarray:
    """The subsequence kernel of every unit with every other, not normalised, by one recursion over both strings for all pairs at once."""
    a, b = _codes(units, LONGEST), _codes(others, LONGEST)
    n, m = len(a), len(b)
    width_a, width_b = (max((len(u) for u in x), default=0) for x in (units, others))
    decay = np.float32(DECAY)
    # begun[j]: weight of common subsequences, one character shorter than the level, that start before place j of the other string
    begun = np.ones((width_a + 1, width_b + 1, n, m), np.float32)
    total = np.zeros((n, m), np.float32)
    square = decay * decay
    same = [[((a[:, i, None] == b[None, :, j]) & (a[:, i, None] != 0)).astype(np.float32) * square for j in range(width_b)] for i in range(width_a)]
    for level in range(1, ORDER + 1):
        last = level == ORDER
        nxt = None if last else np.zeros_like(begun)
        for i in range(1, width_a + 1):
            row = np.zeros((n, m), np.float32)
            for j in range(1, width_b + 1):
                if last:
                    total += same[i - 1][j - 1] * begun[i - 1, j - 1]
                else:
                    row *= decay
                    row += same[i - 1][j - 1] * begun[i - 1, j - 1]
                    np.multiply(nxt[i - 1, j], decay, out=nxt[i, j])
                    nxt[i, j] += row
        begun = nxt
    return total


def self_kernel(units: list[str]) -> np.ndarray:
    """The kernel of each unit with itself."""
    out = np.zeros(len(units), np.float32)
    a = _codes(units, LONGEST)
    n, w = len(a), max((len(u) for u in units), default=0)
    begun = np.ones((w + 1, w + 1, n), np.float32)
    d2 = np.float32(DECAY * DECAY)
    for level in range(1, ORDER + 1):
        last, nxt = level == ORDER, np.zeros_like(begun)
        for i in range(1, w + 1):
            row = np.zeros(n, np.float32)
            for j in range(1, w + 1):
                same = (a[:, i - 1] == a[:, j - 1]) & (a[:, i - 1] != 0)
                if last:
                    out += same * (d2 * begun[i - 1, j - 1])
                else:
                    row = np.float32(DECAY) * row + same * (d2 * begun[i - 1, j - 1])
                    nxt[i, j] = np.float32(DECAY) * nxt[i - 1, j] + row
        begun = nxt
    return out


def similarity(units: list[str], landmarks: list[str], landmark_self: np.ndarray, block: int = 256) -> np.ndarray:
    """The kernel scaled to 1 for equal strings."""
    out = np.zeros((len(units), len(landmarks)), np.float32)
    for at in range(0, len(units), block):
        part = units[at: at + block]
        scale = np.sqrt(np.maximum(self_kernel(part), 1e-12))[:, None] * np.sqrt(np.maximum(landmark_self, 1e-12))[None, :]
        out[at: at + block] = kernel(part, landmarks) / scale
    return out


class Screen:
    """Units that have enough of a typical string in order: a common subsequence of ``ENOUGH`` of its characters, ``ORDER`` at least.
    Other units are at the floor of margins; the kernel is computed for the rest."""

    def __init__(self, typical: list[str]):
        alphabet = {c: i + 1 for i, c in enumerate(sorted(set("".join(typical))))}
        self.places = np.zeros((len(alphabet) + 1, len(typical)), np.uint16)   # LONGEST bits are in use
        for k, t in enumerate(typical):
            for i, c in enumerate(t):
                self.places[alphabet[c], k] |= np.uint16(1 << i)
        self.codes = np.array([ord(c) for c in sorted(alphabet)], np.uint32)
        self.least = np.array([max(ORDER, -(-len(t) * ENOUGH // 10)) for t in typical])
        self.ends = np.array([(1 << len(t)) - 1 for t in typical], np.uint16)

    def passed(self, units: list[str]) -> np.ndarray:
        """Bit-parallel longest common subsequences of all units with all typical strings."""
        codes = _codes(units, LONGEST)
        at = np.minimum(np.searchsorted(self.codes, codes), len(self.codes) - 1)
        place = np.where(self.codes[at] == codes, at + 1, 0)
        left = np.full((len(units), self.places.shape[1]), ~np.uint16(0))
        with np.errstate(over="ignore"):
            for i in range(max((len(u) for u in units), default=0)):
                met = left & self.places[place[:, i]]
                left = (left + met) | (left - met)
        return (np.bitwise_count(~left & self.ends) >= self.least).any(axis=1)


class Triples:
    """What landmarks and weights say of each subsequence of ``ORDER`` = 3 characters: the weighted sum of a unit's similarities is one sum over
    its own subsequences, since the kernel is an inner product of their weights."""

    def __init__(self, landmarks: list[str], landmark_self: np.ndarray, weights: np.ndarray):
        self.chars = np.array(sorted({ord(c) for u in landmarks for c in u}), np.uint32)
        self.base = len(self.chars) + 1
        self.table = np.zeros(self.base ** 3)
        for unit, own, weight in zip(landmarks, landmark_self, weights):
            codes = np.searchsorted(self.chars, np.array([ord(c) for c in unit], np.uint32)) + 1
            for i, j, k in combinations(range(len(unit)), 3):
                self.table[(codes[i] * self.base + codes[j]) * self.base + codes[k]] += weight / np.sqrt(max(own, 1e-12)) * DECAY ** (k - i + 1)

    def sums(self, units: list[str]) -> np.ndarray:
        """The weighted sum of similarities of every unit."""
        codes = _codes(units, LONGEST)
        at = np.minimum(np.searchsorted(self.chars, codes), len(self.chars) - 1)
        place = np.where(self.chars[at] == codes, at + 1, 0).T
        width = max((len(u) for u in units), default=0)
        out = np.zeros(len(units))
        for i in range(width - 2):
            for j in range(i + 1, width - 1):
                pair = (place[i] * self.base + place[j]) * self.base
                for k in range(j + 1, width):
                    out += self.table.take(pair + place[k]) * DECAY ** (k - i + 1)
        return out / np.sqrt(np.maximum(self_kernel(units), 1e-12))


@dataclass
class Model:
    screen: Screen
    landmarks: list[str]
    landmark_self: np.ndarray
    weights: np.ndarray            # of the similarities to the landmarks: the machine's weights through the Nystroem map
    bias: float
    logistic: np.ndarray           # of 1, the highest and the second highest margin

    def __post_init__(self) -> None:
        self.triples = Triples(self.landmarks, self.landmark_self, self.weights)

    def margins(self, units: list[str]) -> np.ndarray:
        out = np.full(len(units), FLOOR)
        for at in range(0, len(units), 2048):
            part = units[at: at + 2048]
            hit = np.flatnonzero(self.screen.passed(part))
            if len(hit):
                out[at + hit] = self.triples.sums([part[i] for i in hit]) + self.bias
        return out

    def score(self, best: np.ndarray) -> np.ndarray:
        z = self.logistic[0] + np.clip(best, FLOOR, 2.0) @ self.logistic[1:]
        return 1.0 / (1.0 + np.exp(-np.clip(z, -30, 30)))


class Margins(dict):
    """chunk -> margin of its most toxic window; unknown chunks of many texts are computed together."""

    def __init__(self, model: Model):
        super().__init__()
        self.model = model

    def learn(self, chunks: set[str]) -> None:
        new = [c for c in chunks if c not in self]
        if not new:
            return
        units = {c: plain(c) for c in new}
        fresh = list({w for u in units.values() if u and u not in self for w in windows(u) if len(w) >= ORDER})
        fresh.sort(key=len)
        known = dict(zip(fresh, self.model.margins(fresh).tolist()))
        for chunk, unit in units.items():
            found = self.get(unit) if unit else FLOOR
            if found is None:
                found = max((known.get(w, FLOOR) for w in windows(unit)), default=FLOOR)
                self[unit] = found
            self[chunk] = found

    def best_two(self, texts: list[str]) -> np.ndarray:
        """The two highest margins of each text's units; those of one sentence come from different units as well."""
        if len(self) > CACHED:
            self.clear()
        found = [chunks_of(t) for t in texts]
        self.learn(set().union(*found) if found else set())
        out = np.full((len(texts), 2), FLOOR)
        for i, chunks in enumerate(found):
            if chunks:
                values = np.fromiter(map(self.__getitem__, chunks), np.float64, len(chunks))
                top = np.partition(values, -2)[-2:] if len(values) > 1 else values
                out[i, 0], out[i, 1] = top[-1], top[0] if len(top) > 1 else FLOOR
        return np.maximum(out, FLOOR)


def train_svm(x: np.ndarray, y: np.ndarray, cost: np.ndarray, epochs: int = 30) -> tuple[np.ndarray, float]:
    """A linear support vector machine by dual coordinate descent; a constant feature carries the bias."""
    x = np.hstack([x, np.ones((len(x), 1))])
    alpha, w = np.zeros(len(x)), np.zeros(x.shape[1])
    norms = (x * x).sum(axis=1)
    rng = np.random.default_rng(1)
    for _ in range(epochs):
        for i in rng.permutation(len(x)):
            step = np.clip(alpha[i] - (y[i] * (w @ x[i]) - 1) / norms[i], 0, cost[i])
            if step != alpha[i]:
                w += (step - alpha[i]) * y[i] * x[i]
                alpha[i] = step
    return w[:-1], float(w[-1])


def train_logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 0.02) -> np.ndarray:
    """Weighted logistic regression by Newton steps."""
    x = np.hstack([np.ones((len(x), 1)), x])
    beta = np.zeros(x.shape[1])
    for _ in range(40):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        h = (x * (weight * np.maximum(p * (1 - p), 1e-9))[:, None]).T @ x + ridge * len(x) * np.diag([1e-6, 1e-2, 1e-2])
        beta = beta + np.linalg.solve(h, x.T @ (weight * (y - p)) - ridge * len(x) * np.array([1e-6, 1e-2, 1e-2]) * beta)
    return beta


def distinct(own: list[set[str]], labels: list[int]) -> list[int]:
    """Places of the documents without near copies of an earlier one with the same label: equal minima in a band, and half of all units
    in common. A group of copies is one witness for its words."""
    hashes = {u: zlib.crc32(u.encode("utf-8", "surrogatepass")) + 1 for units in own for u in units}
    factors = np.random.default_rng(3).integers(1, 2**61, 24, dtype=np.uint64) | np.uint64(1)
    first: dict[tuple, int] = {}
    out = []
    for i, units in enumerate(own):
        if units:
            least = ((np.fromiter((hashes[u] for u in units), np.uint64, len(units))[:, None] * factors) >> np.uint64(20)).min(axis=0)
            keys = [(labels[i], at, least[at: at + 3].tobytes()) for at in range(0, 24, 3)]
            if any(2 * len(own[j] & units) >= len(own[j] | units) for j in {first[k] for k in keys if k in first}):
                continue
            for k in keys:
                first.setdefault(k, i)
        out.append(i)
    return out


def log_tail(k: int, n: int, p: float) -> float:
    """Logarithm of the chance of ``k`` or more of ``n`` at probability ``p``."""
    logs = [lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * log(p) + (n - i) * log(1 - p) for i in range(k, n + 1)]
    return max(logs) + log(sum(exp(x - max(logs)) for x in logs))


def typical_units(left: list[set[str]], in_clean: Counter, clean: int) -> list[str]:
    """Units that stand in more toxic documents than chance explains, whatever their number; then, in the toxic documents without any of
    these, the units typical of those, until there are none: a rare insult need not stand out from the frequent ones."""
    found: set[str] = set()
    while left:
        counts = Counter()
        for units in left:
            counts.update(units)
        p = len(left) / (len(left) + clean)
        bar = log(UNLIKELY / max(1, len(counts)))
        ratio = lambda u: log((counts[u] + 0.1) / len(left)) - log((in_clean[u] + 0.5) / clean)
        new = {u for u, k in counts.items() if k > in_clean[u] and k * log(p) <= bar and ratio(u) > 1.0 and log_tail(k, k + in_clean[u], p) <= bar}
        if not new:
            break
        found |= new
        left = [units for units in left if not units & new]
    return list(found)


def spanning(units: list[str]) -> list[int]:
    """Places of the units, in their order, that those taken before span by less than all but ``NEW`` in the kernel's space."""
    alike = similarity(units, units, self_kernel(units)).astype(np.float64)
    rows, rest = np.zeros((len(units), 0)), np.ones(len(units))
    out = []
    for i in range(len(units)):
        if rest[i] > NEW:
            row = (alike[:, i] - rows @ rows[i]) / rest[i] ** 0.5
            rows, rest = np.hstack([rows, row[:, None]]), rest - row * row
            out.append(i)
    return out


def gapped_variants(unit: str, letters: str, rng: np.random.Generator) -> list[str]:
    """The unit with a letter put in at every place, with two or three in the middle, with one between all its letters, and with one letter missing."""
    some = lambda k: "".join(letters[i] for i in rng.integers(len(letters), size=k))      # noqa: E731
    middle = len(unit) // 2
    out = [unit[:i] + some(1) + unit[i:] for i in range(1, len(unit)) for _ in range(2)]
    out += [unit[:middle] + some(k) + unit[middle:] for k in (2, 2, 3)]
    out += ["".join(c + some(1) for c in unit[:-1]) + unit[-1:] for _ in range(3)]
    if len(unit) > ORDER + 1:
        out += [unit[:i] + unit[i + 1:] for i in range(1, len(unit) - 1)]
    return [v for v in out if ORDER <= len(v) <= LONGEST]


def fit(texts: list[str], labels: list[int], clean_weight: float = 1.0) -> Model | None:
    """A model from labelled documents; None if they are of one kind."""
    y = np.array(labels)
    if not len(y) or y.min() == y.max():
        return None
    sentences = [[[plain(c) for c in chunks_of(s)] for s in SENTENCE.split(t) if s] for t in texts]
    own = [{u for s in doc for u in s if len(u) >= ORDER} for doc in sentences]
    counted = distinct(own, labels)
    in_toxic, in_clean = Counter(), Counter()
    for i in counted:
        (in_toxic if y[i] else in_clean).update(own[i])
    toxic, clean = sum(labels[i] for i in counted), sum(1 - labels[i] for i in counted)
    typical = {u: np.log((k + 0.1) / toxic) - np.log((in_clean[u] + 0.5) / clean) for u, k in in_toxic.items()}
    known = typical_units([own[i] for i in counted if y[i]], in_clean, clean)
    everyone = known or sorted((u for u in typical if typical[u] > 0), key=lambda u: (-in_toxic[u] * typical[u], u))[:400]
    everyone.sort(key=lambda u: (-in_toxic[u] * typical[u], u))
    seeds = [everyone[i] for i in spanning([u[:LONGEST] for u in everyone])][: None if known else GUESSES]
    set_of = set(everyone)
    rng = np.random.default_rng(2)
    common = sorted((u for u in in_clean if u not in set_of), key=lambda u: (-in_clean[u], u))
    seed_self = self_kernel([u[:LONGEST] for u in seeds])
    pool = [w for w in {w for u in common[:20_000] for w in windows(u)} if len(w) >= ORDER]
    pool.sort()
    close = similarity(pool, [u[:LONGEST] for u in seeds], seed_self).max(axis=1) if pool else np.zeros(0)
    near = [pool[i] for i in np.argsort(-close, kind="stable")[:1500] if pool[i] not in set_of]
    others = max(OTHERS, (LANDMARKS - len(seeds)) // 2)
    landmarks = [u[:LONGEST] for u in seeds] + [*near[:others], *[u[:LONGEST] for u in common[:others]]]
    landmarks = list(dict.fromkeys(landmarks))
    landmark_self = self_kernel(landmarks)
    values, vectors = np.linalg.eigh(similarity(landmarks, landmarks, landmark_self).astype(np.float64))
    keep = values > 1e-4
    root = vectors[:, keep] / np.sqrt(values[keep])
    weights, bias = None, 0.0
    witness_of = [max((u for u in units if u in set_of), key=lambda u: typical[u], default=None) if label else None for units, label in zip(own, y)]
    letters = "".join(u[0] for u in common[:20_000] if u[0].isalpha()) or "e"
    random_clean = [pool[i] for i in rng.permutation(len(pool))[:1500]]
    for turn in range(2):
        witnesses = Counter({u[:LONGEST]: in_toxic[u] for u in everyone}) + Counter(u[:LONGEST] for u in witness_of if u)
        positive = sorted(witnesses)
        variants = {v: witnesses[p] / 10 for p in seeds for v in gapped_variants(p, letters, rng)}
        gapped = sorted(set(variants) - set(positive))
        negative = sorted(set(near + random_clean) - set(positive))
        units = positive + gapped + negative
        target = np.array([1.0] * (len(positive) + len(gapped)) + [-1.0] * len(negative))
        share = np.array([witnesses[u] for u in positive] + [variants[u] for u in gapped])
        cost = np.concatenate([4.0 * len(negative) * share / share.sum() / 4, np.ones(len(negative))])
        phi = similarity(units, landmarks, landmark_self).astype(np.float64) @ root
        w, bias = train_svm(phi, target, np.maximum(cost, 0.5))
        weights = root @ w
        model = Model(Screen(positive if known else [u[:LONGEST] for u in seeds]), landmarks, landmark_self, weights, bias, np.zeros(3))
        if turn == 0:
            margins = Margins(model)
            margins.learn({u for units_of, label in zip(own, y) if label for u in units_of})
            margins.learn({u for units_of, label in zip(own, y) if not label for u in units_of})
            witness_of = [(best if margins[best] > 0 else None) if label and units_of and (best := max(sorted(units_of), key=lambda u: margins[u])) else None for units_of, label in zip(own, y)]
            false = sorted({u for units_of, label in zip(own, y) if not label for u in units_of if margins[u] > -0.5}, key=lambda u: (-margins[u], u))[:1500]
            near = list(dict.fromkeys([w for u in false for w in windows(u) if len(w) >= ORDER] + near))[:3000]
    best = Margins(model).best_two(texts)
    model.logistic = train_logistic(np.clip(best, FLOOR, 2.0), y, np.where(y == 1, 1.0, clean_weight))
    return model


def training_rows(docs: DataFrame, labels: DataFrame, most: int = TRAINING) -> tuple[list[str], list[int], float]:
    """Texts and labels of the bounded sample, and the weight of a clean row in it."""
    usable = labels.filter(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull() & (fold_of(F.col("doc_id")) != 0)).select("doc_id", F.col("toxic").cast("int").alias("toxic")).dropDuplicates(["doc_id"])
    usable = materialise(usable, "usable-labels")
    counts = {r["toxic"]: r["count"] for r in usable.groupBy("toxic").count().collect()}
    order = F.xxhash64("doc_id")
    chosen = usable.filter("toxic = 1").orderBy(order).limit(most).unionByName(usable.filter("toxic = 0").orderBy(order).limit(most))
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("doc_id", "text", "toxic").toArrow()   # 2 * TRAINING labels at most
    rows = rows.sort_by("doc_id")
    clean = min(most, counts.get(0, 0))
    weight = counts.get(0, 0) / clean * min(most, counts.get(1, 0)) / max(1, counts.get(1, 0)) if clean else 1.0
    return [t or "" for t in rows["text"].to_pylist()], rows["toxic"].to_pylist(), weight


def scored(docs: DataFrame, model: Model | None) -> DataFrame:
    """``docs`` with all columns, and ``score`` (a column of that name is replaced)."""
    spark = docs.sparkSession
    docs = docs.drop("score")
    if model is None:
        return docs.withColumn("score", F.lit(0.0))
    shared = spark.sparkContext.broadcast(model)
    schema = docs.withColumn("score", F.lit(0.0)).schema
    place = docs.columns.index("text")

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        let_go()
        margins = Margins(shared.value)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                scores = margins.model.score(margins.best_two([t or "" for t in part.column(place).to_pylist()]))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(scores, pa.float64())], [*part.schema.names, "score"])

    return docs.mapInArrow(rows, schema)


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted of every row of ``docs`` (doc_id, text), learned from ``labels`` (doc_id, toxic)."""
    model = fit(*training_rows(docs, labels))
    found = scored(docs.select("doc_id", "text"), model)
    held_out = F.coalesce(fold_of(F.col("doc_id")) == 0, F.lit(False))
    return found.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def clean_rows(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` that are scored below one half, with their columns."""
    score = free_name("toxicity_score", docs.columns)
    model = fit(*training_rows(docs, labels))
    kept = [c if c.lower() != "score" else score for c in docs.columns]
    renamed = docs.toDF(*kept)
    return scored(renamed, model).filter("score < 0.5").select(*[F.col(f"`{k}`").alias(c) for k, c in zip(kept, docs.columns)])

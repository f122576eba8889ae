"""Queries without SQL against brute force on a whole small table."""

from hashlib import sha256
from itertools import combinations
from zlib import crc32

import pyarrow.parquet as pq
import public_tokenizers as P
import pytest
import tiktoken
from tokenizers import Tokenizer

from tallyline.llm import minhash
from tallyline.llm.byte_bpe import load_ranks
from tallyline.llm.queries import QUERIES

FOLDER = "/root/testdata/sf0.001"
SPACES = " \t\n\x0b\x0c\r"


@pytest.fixture(scope="module")
def docs():
    rows = pq.read_table(f"{FOLDER}/documents.parquet").to_pylist()
    return sorted(rows, key=lambda r: r["doc_id"])


def result(spark, name):
    return {r["doc_id"]: r for r in QUERIES[name](spark, FOLDER).collect()}


def shingles(text, size=5):
    for s in SPACES[1:]:
        text = text.replace(s, " ")
    words = ["".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in w) for w in text.split(" ") if w]
    if len(words) < size:
        return {tuple(words)} if words else set()
    return {tuple(words[i: i + size]) for i in range(len(words) - size + 1)}


def test_op3_is_the_rank_library(spark, docs):
    ranks = load_ranks(P.path("byte_bpe_multi_50k.tiktoken"))
    library = tiktoken.Encoding("t", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    got = result(spark, "op3_byte_bpe")
    for d in docs:
        ids = library.encode_ordinary(d["text"] or "")
        row = got[d["doc_id"]]
        assert (row["n_tokens"], row["ids_sha256"]) == (len(ids), sha256(",".join(map(str, ids)).encode()).hexdigest())
        assert row["decoded_sha256"] == sha256((d["text"] or "").encode()).hexdigest()


def test_op6_is_the_tokenizers_library(spark, docs):
    library = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    got, start = result(spark, "op6_id_files"), 0
    for d in docs:
        ids = library.encode(d["text"] or "", add_special_tokens=False).ids + [2]
        row = got[d["doc_id"]]
        assert (row["start"], row["n_tokens"]) == (start, len(ids))
        assert row["ids_crc32"] == crc32(b"".join(i.to_bytes(4, "little") for i in ids))
        start += len(ids)


def test_op2_answers_every_limit(spark, docs):
    library = tiktoken.Encoding("t", pat_str=P.PATTERN, mergeable_ranks=load_ranks(P.path("byte_bpe_50k.tiktoken")), special_tokens={})
    lengths = [len(library.encode_ordinary(d["text"] or "")) for d in docs]
    rows = QUERIES["op2_token_counts"](spark, FOLDER).collect()
    assert sorted(r["context_limit"] for r in rows) == sorted(set(lengths))
    for r in rows:
        limit = r["context_limit"]
        assert r["docs"] == lengths.count(limit) and r["docs_longer"] == sum(x > limit for x in lengths)
        assert r["kept_tokens"] == sum(min(x, limit) for x in lengths) and r["total_tokens"] == sum(lengths)
        assert r["tokens_of_longer"] == sum(x for x in lengths if x > limit)
        assert abs(r["share_within"] - sum(x <= limit for x in lengths) / len(lengths)) < 1e-12


def test_op5_edits_and_likeness(spark, docs):
    got, errors = result(spark, "op5_fingerprints"), []
    for i, d in enumerate(docs):
        text, following = d["text"] or "", docs[(i + 1) % len(docs)]["text"] or ""
        half = len(text) // 2
        edited = text[: len(text) - half] + following[:half]
        row = got[d["doc_id"]]
        assert (row["n_chars"], row["edited_sha256"]) == (len(text), sha256(edited.encode()).hexdigest())
        a = shingles(text)
        for other, near in ((edited, row["near_edited"]), (following, row["near_next"])):
            b = shingles(other)
            errors.append(near - (len(a & b) / len(a | b) if a | b else 1.0))
    assert max(map(abs, errors)) < 0.25 and (sum(e * e for e in errors) / len(errors)) ** 0.5 < 0.05
    by_text = {}
    for d in docs:
        assert by_text.setdefault(d["text"], got[d["doc_id"]]["fingerprint"]) == got[d["doc_id"]]["fingerprint"]


def brute_components(sets):
    parent = {i: i for i in sets}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in combinations(sorted(sets), 2):
        x, y = sets[a], sets[b]
        if x and y and 5 * min(len(x), len(y)) >= 4 * max(len(x), len(y)) and 100 * len(x & y) >= 80 * len(x | y):
            parent[max(root(a), root(b))] = min(root(a), root(b))
    return {i: root(i) for i in sets}


@pytest.mark.parametrize("folder", ["/root/testdata/sf0.001", "/root/testdata/sf0.01"])
def test_op10_components(spark, folder):
    sets = {r["doc_id"]: shingles(r["text"] or "") for r in pq.read_table(f"{folder}/documents.parquet").to_pylist()}
    want = brute_components(sets)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in QUERIES["op10_ngram_join"](spark, folder).collect()}
    assert got == {i: (len(sets[i]), want[i]) for i in sets}
    assert sum(i != c for i, c in want.items()) > 3


@pytest.mark.parametrize("folder", ["/root/testdata/sf0.001", "/root/testdata/sf0.01"])
def test_minhash_classes(spark, folder):
    """Bands find at least nine of ten documents with a link, and verification joins nothing that brute force doesn't."""
    sets = {r["doc_id"]: shingles(r["text"] or "") for r in pq.read_table(f"{folder}/documents.parquet").to_pylist()}
    want = brute_components(sets)
    got = {r["doc_id"]: r["class_id"] for r in minhash.near_duplicates(spark.read.parquet(f"{folder}/documents.parquet")).collect()}
    assert got.keys() == sets.keys() and all(want[i] == want[c] for i, c in got.items())
    later = [i for i, c in want.items() if i != c]
    assert later and sum(got[i] != i for i in later) >= 0.9 * len(later)

"""The prefix trie against brute force, over one window and over many."""

import random
from hashlib import sha256
from zlib import crc32

import pytest

from tallyline.llm import prefix_trie
from tallyline.llm.common import read_table

SCHEMA = "conv_id bigint, turn bigint, role string, text string, key string, depth int"


def digest(role, text):
    return sha256(f"{len(role)}:{role}{text}".encode()).hexdigest()[:32]


def brute(turns):
    own = {}
    for conv, turn, role, text in turns:
        if conv is not None:
            own.setdefault(conv, []).append((turn is not None, turn or 0, digest(role or "", text or ""), (role or "", text or "")))
    own = {c: [t[3] for t in sorted(rows)] for c, rows in own.items()}
    whole = {}
    for c, mine in own.items():
        h = crc32(str(c).encode()) % 6
        family = c - (c % 100 if c >= 0 else -(-c % 100))
        whole[c] = tuple(own.get(family, [])[:h] + mine[h:])
    members = {}
    for c, seq in whole.items():
        for d in range(len(seq) + 1):
            members.setdefault(seq[:d], []).append(c)
    kids = {}
    for node in members:
        if node:
            kids.setdefault(node[:-1], []).append(node)
    sums = {}
    for node in sorted(members, key=len, reverse=True):
        below = kids.get(node, [])
        own_saved = (len(members[node]) - 1) * len(node[-1][1]) if node else 0
        sums[node] = (sum(sums[k][0] for k in below) if below else 1, own_saved + sum(sums[k][1] for k in below))
    out = []
    for node, who in members.items():
        ends = ",".join(str(c) for c in sorted(c for c in who if len(whole[c]) == len(node)))
        out.append((min(who), len(node), min(members[node[:-1]]) if node else None, len(who), len(kids.get(node, [])), *sums[node], sha256(ends.encode()).hexdigest()))
    return sorted(out, key=repr)


def made(seed, n):
    draw = random.Random(seed)
    turns = []
    for c in [*range(n), *range(100, 100 + n), -3, -100, 10**12, 77_777]:
        for t in range(draw.choice([1, 2, 3, 7])):
            turns.append((c, draw.choice([t, t, 0, None]), draw.choice(["user", None, ""]), draw.choice(["a", "bé", "", None, "a b c"])))
    return turns + [(None, 1, "user", "x"), turns[0]]


def result(spark, turns, **sizes):
    df = spark.createDataFrame([(*t, "k", 3) for t in turns], SCHEMA)
    sequences = prefix_trie.distinct_sequences(prefix_trie.with_origin(prefix_trie.units(df)), **{k: v for k, v in sizes.items() if k == "bucket_bits"})
    got = prefix_trie.trie(sequences, **{k: v for k, v in sizes.items() if k == "window_rows"})
    return sorted((tuple(r) for r in got.collect()), key=repr)


@pytest.mark.parametrize("sizes", [{}, {"window_rows": 1, "bucket_bits": 1}, {"window_rows": 3, "bucket_bits": 2}])
def test_like_brute_force(spark, sizes):
    turns = made(7, 90)
    assert result(spark, turns, **sizes) == brute(turns)


def test_hot_and_odd(spark):
    hot = [(c, t, "user", f"same {t}") for c in range(0, 60) for t in range(3)]
    deep = [(500 + c, t, "user", f"deep {t}") for c in range(2) for t in range(40 + c)]
    turns = made(3, 20) + hot + deep
    assert result(spark, turns, window_rows=5) == brute(turns)
    assert result(spark, []) == [] and result(spark, [(None, 1, "user", "x")]) == []
    one = [(1, 0, None, None)]
    assert result(spark, one) == brute(one)


def test_whole_table(spark):
    table = read_table(spark, "/root/testdata/sf0.01", "conversations")
    turns = [tuple(r) for r in table.select("conv_id", "turn", "role", "text").collect()]
    assert sorted((tuple(r) for r in prefix_trie.rebuilt_trie(table).collect()), key=repr) == brute(turns)

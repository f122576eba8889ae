"""Phrase mining against brute force: expansion passes, cuts inside long texts, ties, languages."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from tallyline.llm import collocations
from tallyline.llm.common import read_table

SCHEMA = "doc_id bigint, text string, lang string, phrase string, n int"


def brute(rows, min_count=10, top=2000, share=50):
    f, n = defaultdict(Counter), Counter()
    for _, text, lang in rows:
        lang = "und" if lang is None else lang
        lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lower):
            words = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(words)
            for size in (1, 2, 3):
                f[lang].update(tuple(words[i: i + size]) for i in range(len(words) - size + 1))
    out = []
    for lang, counts in f.items():
        longer = Counter()
        for p, a in counts.items():
            if len(p) == 3 and a >= min_count:
                for q in (p[:2], p[1:]):
                    longer[q] = max(longer[q], a)
        found = []
        for p, a in counts.items():
            if len(p) == 1 or a < min_count or len(p) == 2 and longer[p] and 100 * longer[p] >= share * a:
                continue
            score, _, l, r = min((1000000 * a * a // (counts[p[:k]] * counts[p[k:]]), k, counts[p[:k]], counts[p[k:]]) for k in range(1, len(p)))
            found.append((-score, -a, " ".join(p).encode(), l, r))
        out += [(lang, i + 1, p.decode(), -a, l, r, n[lang], -s) for i, (s, a, p, l, r) in enumerate(sorted(found)[:top])]
    return sorted(out)


def result(spark, rows, **options):
    df = spark.createDataFrame([(*r, "p", 1) for r in rows], SCHEMA)
    return sorted(tuple(r) for r in collocations.collocations(df, **options).collect())


def made(seed, n):
    draw = random.Random(seed)
    words = ["a", "A", "bé", "Ça", "x-y", "\x1f", "zz'", "d", "e", "f", "g"]
    gaps = [" ", "  ", "\t", " ", " ", ". ", ",", "\n", "!"]
    rows = [(i, "".join(draw.choice(words) + draw.choice(gaps) for _ in range(draw.choice([0, 3, 40]))), draw.choice(["en", "en", None, "", "de"])) for i in range(n)]
    return rows + [(None, None, "en"), (3, "", None), (4, " .. \n", "fr")] + rows[:2]


@pytest.mark.parametrize("options", [{}, {"top": 5}, {"min_count": 2, "share": 90}, {"sample": 1000, "proposed": 50}])
def test_like_brute_force(spark, options):
    rows = made(1, 200)
    assert result(spark, rows, **options) == brute(rows, **{k: v for k, v in options.items() if k in ("min_count", "top", "share")})


def test_nothing_proposed_and_empty(spark):
    """A sample that proposes nothing leaves all to the expansion passes."""
    rows = [(i, "one two three four", "en") for i in range(40)]
    assert result(spark, rows, sample=10**6, proposed=10**6) == brute(rows) != []
    assert result(spark, []) == [] and result(spark, [(1, None, None), (2, "a b", "en")]) == []


def test_long_texts(spark, monkeypatch):
    """Texts and pieces that go over the chunks' and windows' sizes."""
    rows = [(1, "w1 w2 w3 w4. " * 3000 + "tail of it " * 900, "en"), (2, "no break " * 5000, "en"), (3, ("k" * 3000 + " l ") * 12, "en")] + made(2, 60)
    data, want = np.frombuffer("".join(r[1] or "" for r in rows).encode(), np.uint8), None
    cuts = np.unique(np.cumsum([len((r[1] or "").encode()) for r in rows])[:-1])
    for size in (64, 1000, 1 << 20):
        monkeypatch.setattr(collocations, "CHUNK_BYTES", size)
        got = []
        for lo, hi in collocations.pieces_of(data, cuts[cuts < len(data)]):
            inner = cuts[(cuts > lo) & (cuts < hi)] - lo
            w, starts, ends, follows = collocations.words_of(data[lo:hi], inner, 1)
            got += list(zip(w.tolist(), (starts + lo).tolist(), (ends + lo).tolist(), follows.tolist()))
        assert want is None or got == want
        want = got
    assert result(spark, rows) == brute(rows)


def test_whole_table(spark):
    table = read_table(spark, "/root/testdata/sf0.001", "documents")
    rows = [tuple(r) for r in table.select("doc_id", "text", "lang").collect()]
    assert sorted(tuple(r) for r in collocations.collocations(table).collect()) == brute(rows)

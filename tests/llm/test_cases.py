"""Nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns."""

import pytest
from pyspark.sql import functions as F

from tallyline.llm import byte_bpe, exact_dedup, fixity, id_files, main_text, minhash, mixing, ngram_join, token_lengths, toxicity

SCHEMA = "doc_id bigint, text string, source string, gid string, score double, component_id int"
LONG = " ".join(f"w{i % 977}" for i in range(30_000))


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(1, None), (2, ""), (3, " \t\n"), (4, "a b c"), (4, "a b c"), (5, "A b\tc"), (6, LONG), (7, LONG + " end"), (None, "x y"), (None, None), (8, "ab c"), (9, "one two three four five six seven")]
    return spark.createDataFrame([(i, t, "s" if (i or 0) % 2 else None, "g", 1.0, 7) for i, t in rows], SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_exact_dedup(docs, empty):
    got = exact_dedup.groups(docs)
    kept = [r for r in got.collect() if r["kept"]]
    assert got.count() == 12 and len(kept) == len({r["text_sha256"] for r in kept}) == 7
    same = {(r["keep_id"], r["group_size"]) for r in got.collect() if r["doc_id"] in (4, 8)}
    assert same == {(4, 3)}
    blank = {(r["keep_id"], r["group_size"]) for r in got.collect() if r["doc_id"] in (1, 2, 3)}
    assert blank == {(3, 4)}
    stay = exact_dedup.unique_rows(docs)
    assert stay.columns == docs.columns and stay.count() == 7
    assert exact_dedup.groups(empty).count() == exact_dedup.unique_rows(empty).count() == 0


def test_mixing(docs, empty):
    got = mixing.mix(docs).collect()
    assert len(got) == 12 and all(0 <= r["taken"] <= 3 * r["size"] for r in got)
    by_source = {r["source_size"]: r["target"] for r in got}
    assert abs(sum(by_source.values()) - sum(by_source)) < 1e-6
    assert abs(sum(r["taken"] for r in got) - sum(by_source)) <= len(by_source)
    assert rows(mixing.mix(docs)) == rows(mixing.mix(docs, range_rows=1))
    made = mixing.mixed_rows(docs)
    assert made.columns == docs.columns
    assert made.agg(F.sum(mixing.size_of(F.col("text")))).first()[0] == sum(r["taken"] for r in got)
    assert mixing.mix(empty).count() == mixing.mixed_rows(empty).count() == 0


@pytest.mark.parametrize("boundary", [None, 3, 6, 20])
def test_ngram_join(spark, docs, empty, boundary):
    got = ngram_join.joined(docs, boundary)
    of = {(r["doc_id"], r["n_shingles"]): r["component_id"] for r in got.collect()}
    assert got.count() == 12 and of[7, 978] == 6 and of[5, 1] == 4 and of[1, 0] == 1 and of[2, 0] == 2 and of[9, 3] == 9 and of[None, 1] is None
    small = spark.createDataFrame([(i, " ".join(f"{c}" for c in range(k, k + 12)), "s", "", 0.0, 0) for i, k in enumerate([0, 1, 2, 50, 51])], SCHEMA)
    assert [r["component_id"] for r in ngram_join.joined(small, boundary).orderBy("doc_id").collect()] == [0, 1, 2, 3, 4]
    wide = spark.createDataFrame([(i, " ".join(f"{c}" for c in range(k, k + 24)), "s", "", 0.0, 0) for i, k in enumerate([0, 1, 2, 50, 51])], SCHEMA)
    assert [r["component_id"] for r in ngram_join.joined(wide, boundary).orderBy("doc_id").collect()] == [0, 0, 0, 3, 3]
    assert ngram_join.joined(empty, boundary).count() == 0
    assert ngram_join.one_of_each(docs).columns == docs.columns


def test_one_of_each_by_row(spark):
    """Near copies without an id, and a row that repeats a near copy's id with a text of its own."""
    base = [f"t{i}" for i in range(60)]
    other = " ".join(base[:40] + ["x"] + base[41:])
    rows = [(None, " ".join(base)), (None, other), (5, " ".join(base[1:])), (5, "a text of its own that is no copy"), (6, ""), (6, None), (7, "b c"), (7, "b c")]
    df = spark.createDataFrame([(i, t, "s", "g", 0.0, 0) for i, t in rows], SCHEMA)
    got = sorted(((r["doc_id"], r["text"]) for r in ngram_join.one_of_each(df).collect()), key=repr)
    assert got == sorted([(5, " ".join(base[1:])), rows[3], rows[4], rows[5], (7, "b c")], key=repr)


def test_lists_of_any_size(spark, monkeypatch):
    """Groups above the limits of pair-by-pair lists have the components that pairs alone give."""
    from tallyline.llm import links
    groups, members = 6, 30
    texts = []
    for g in range(groups):
        words = [f"g{g}w{i}" for i in range(50)]
        for m in range(members):
            k = m % 44
            texts.append(" ".join(words[:k] + [f"v{m % 3}"] + words[k + 1:] if m else words))
    df = spark.createDataFrame([(i, t, "s", "g", 0.0, 0) for i, t in enumerate(texts)], SCHEMA)
    want = None
    for limits in ((24, 400), (10**9, 10**9)):
        monkeypatch.setattr(links, "EASY_FIRST", limits[0])
        monkeypatch.setattr(links, "EASY", limits[1])
        got = {r["doc_id"]: r["component_id"] for r in ngram_join.joined(df).collect()}
        assert want is None or got == want
        want = got
    assert len(set(want.values())) < len(texts)


def _entries(spark, nodes):
    """List entries of nodes (node, n, keys in order)."""
    from tallyline.llm import links
    rows = [(key, at, node, n, *[0] * len(links.MARKS)) for node, n, keys in nodes for at, key in keys]
    return spark.createDataFrame(rows, "key bigint, at int, node bigint, n int, " + ", ".join(f"{m} bigint" for m in links.MARKS))


def test_pairs_that_share_many_lists_meet_once(spark):
    """Three nodes share thirty lists, of which one node lacks the first: each pair makes one row, in its first list."""
    from tallyline.llm import links
    shared = [(at, 100 + at) for at in range(30)]
    entries = _entries(spark, [(1, 300, shared), (2, 300, shared), (3, 300, shared[1:])])
    met = links.pair_by_pair(links._cross(links.by_node(entries), None, links.PAST))
    assert sorted(tuple(r) for r in met.collect()) == [(1, 2), (1, 3), (2, 3)]


def test_pairs_that_first_meet_too_late_are_left_out(spark):
    """Sets of 90 need 80 shared elements: those that meet at the twelfth place first can't have them, those at the eleventh can."""
    from tallyline.llm import links
    entries = _entries(spark, [(1, 90, [(10, 5)]), (2, 90, [(10, 5)]), (3, 90, [(11, 6)]), (4, 90, [(0, 6)])])
    met = links.pair_by_pair(links._cross(links.by_node(entries), None, links.PAST))
    assert [tuple(r) for r in met.collect()] == [(1, 2)]


def test_lists_pair_by_pair_lose_no_link(spark, monkeypatch):
    """Near copies of random edits, below and above the limit: components as brute force gives them, whatever is tested pair by pair."""
    import random

    from tallyline.llm import links
    monkeypatch.setattr(links, "PIVOTS", 1)
    monkeypatch.setattr(links, "EASY_FIRST", 3)
    rng = random.Random(3)
    texts = []
    for g in range(3):
        words = [f"g{g}w{i}" for i in range(120)]
        for _ in range(25):
            cut = set(rng.sample(range(120), rng.choice([0, 1, 2, 3])))
            texts.append([w if i not in cut else f"v{rng.random()}" for i, w in enumerate(words)])
    sets = [{tuple(t[i:i + 5]) for i in range(len(t) - 4)} for t in texts]
    want = list(range(len(sets)))
    for i in range(len(sets)):
        for j in range(i):
            if 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]) and want[i] != want[j]:
                low, high = sorted((want[i], want[j]))
                want = [low if x == high else x for x in want]
    df = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id bigint, text string")
    assert [r["component_id"] for r in ngram_join.joined(df).orderBy("doc_id").collect()] == want and 3 < len(set(want)) < len(want)


def test_workers_let_an_encoder_go():
    """A task of another stage frees the encoder that an earlier stage left in its worker."""
    import weakref

    import public_tokenizers

    path = public_tokenizers.path(byte_bpe.VOCABULARY)
    first = weakref.ref(byte_bpe.coder(path))
    assert first() is byte_bpe.coder(path)
    list(ngram_join._census(iter([])))
    assert first() is None


def test_encoders(docs, empty):
    got = {r["doc_id"]: r for r in byte_bpe.encoded_digests(docs).collect()}
    assert got[1]["n_tokens"] == got[2]["n_tokens"] == 0
    back = byte_bpe.decoded(byte_bpe.encoded(docs)).filter("doc_id = 6").first()
    assert back["text"] == LONG
    read = id_files.read_documents(id_files.write_images(docs, image_ids=100)).collect()
    starts = sorted((r["start"], r["n_tokens"]) for r in read)
    assert len(read) == 12 and all(a + n == b for (a, n), (b, _) in zip(starts, starts[1:]))
    assert token_lengths.limits(token_lengths.histogram(token_lengths.lengths(docs))).agg(F.sum("docs")).first()[0] == 12
    for df in (byte_bpe.encoded_digests(empty), id_files.read_documents(id_files.write_images(empty)), token_lengths.limits(token_lengths.histogram(token_lengths.lengths(empty)))):
        assert df.count() == 0


def test_fingerprints(docs, empty):
    got = minhash.fingerprints(docs).collect()
    assert len(got) == 12 and all(0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1 for r in got)
    assert len({r["fingerprint"] for r in got if r["n_chars"] in (0, 3) and r["doc_id"] in (1, 2, 3)}) == 1
    assert minhash.fingerprints(empty).count() == 0
    near = {(r["doc_id"], r["n_shingles"]): r["class_id"] for r in minhash.near_duplicates(docs).collect()}
    assert near[7, 978] == 6 and near[5, 1] == 4 and near[1, 0] == 1 and near[2, 0] == 2 and near[9, 3] == 9 and near[None, 1] is None
    assert minhash.near_duplicates(docs).count() == 12 and minhash.near_duplicates(empty).count() == 0


def test_fixity(spark):
    records = spark.createDataFrame([(1, "u", "abc"), (2, None, None), (2, None, None), (None, "n", "x"), (70_000, "u", "def"), (-5, "", "")], "record_id bigint, url string, payload string")
    assert fixity.audit(records, records).count() == 0
    other = records.withColumn("payload", F.when(F.col("record_id") == 70_000, F.lit("dXf")).otherwise(F.col("payload"))).filter("record_id IS NULL OR record_id <> -5").unionByName(records.filter("record_id = 1"))
    assert {(r["record_id"], r["problem"]) for r in fixity.audit(records, other).collect()} == {(70_000, "altered"), (-5, "missing"), (1, "extra")}
    assert fixity.audit(records, records.limit(0)).filter("problem = 'missing'").count() == 5
    assert fixity.audit(records.limit(0), records.limit(0)).count() == 0


def test_main_text(spark):
    page = "<html><header>Site</header><div class='cookie-notice'>We use many cookies</div><div><h2>Head</h2><p>First &amp; <b>second</b>\n words that are long enough to be a text of some weight here.<p>Short.</div><div class=comments><p>nice</div><footer>end</footer>"
    assert main_text.main_text(page) == "Head\nFirst & second words that are long enough to be a text of some weight here.\nShort."
    pages = spark.createDataFrame([(1, "u", None), (2, None, ""), (3, "u", page), (3, "u", page), (4, "u", "<p>cut <a hr")], "page_id bigint, url string, html string")
    assert [r["n_chars"] for r in main_text.extracted(pages).orderBy("page_id").collect()] == [0, 0, len(main_text.main_text(page)), len(main_text.main_text(page)), 3]
    assert main_text.extracted(pages.limit(0)).count() == 0


def test_toxicity(spark, docs, empty):
    labelled = [(100 + i, ("you are an idiot and a moron " if i % 3 == 0 else "this is a calm and friendly word ") + f"said{i} here.") for i in range(120)]
    texts = docs.unionByName(spark.createDataFrame([(i, t, "s", "", 0.0, 0) for i, t in labelled], SCHEMA))
    labels = spark.createDataFrame([(i, int("idiot" in t)) for i, t in labelled] + [(None, 1), (4, None)], "doc_id bigint, toxic int")
    got = toxicity.toxicity(texts, labels)
    assert got.count() == 132
    held = [r for r in got.filter("held_out AND doc_id >= 100").collect()]
    assert held and all(r["predicted"] == int((r["doc_id"] - 100) % 3 == 0) for r in held)
    assert toxicity.clean_rows(texts, labels).columns == texts.columns and toxicity.clean_rows(texts, labels).count() == 92
    assert toxicity.toxicity(empty, labels).count() == 0 and toxicity.toxicity(docs, labels.limit(0)).agg(F.max("score")).first()[0] == 0.0


def test_census_hands_on_small_batches(monkeypatch):
    import pyarrow as pa

    from tallyline.llm import ngram_join

    monkeypatch.setattr(ngram_join, "BATCH", 7)
    text = " ".join(f"w{i}" for i in range(60))
    made = list(ngram_join._census(iter([pa.record_batch([pa.array([text, text, "a b", None])], ["text"])])))
    counts = {(r["kind"], r["key"]): r["n"] for b in made for r in b.to_pylist() if r["kind"] == 0}
    assert max(b.num_rows for b in made[:-1]) == 7
    assert sorted(counts.values()) == [1] + [2] * ngram_join._counted(56)

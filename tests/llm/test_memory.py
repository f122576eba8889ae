"""What Python workers and their batches hold: rows pass a megabyte at a time, and what a task freed goes back to the system."""

import re
from pathlib import Path

import pyarrow as pa
import pytest

from tallyline.llm import collocations, common, ngram_join

DOCS = "doc_id bigint, text string, lang string"
ROWS = [(i, f"one two three four five six {i % 7}. seven eight", "en") for i in range(60)]


def seen_batches(spark, monkeypatch, module, run):
    """The session's limit whenever ``module`` writes a table, and after ``run``."""
    write, limits = module.materialise, []

    def noted(df, *rest):
        limits.append(spark.conf.get(common.BATCH_BYTES))
        return write(df, *rest)

    monkeypatch.setattr(module, "materialise", noted)
    run(spark.createDataFrame(ROWS, DOCS)).collect()
    return limits, spark.conf.get(common.BATCH_BYTES)


def test_collocations_pass_texts_in_small_batches(spark, monkeypatch):
    before = spark.conf.get(common.BATCH_BYTES)
    limits, after = seen_batches(spark, monkeypatch, collocations, collocations.collocations)
    assert str(common.TEXT_BYTES) in [re.sub(r"\D", "", x) for x in limits[:3]] and limits[0] == limits[1] and after == before


@pytest.mark.parametrize("run", [ngram_join.joined, ngram_join.one_of_each])
def test_the_join_passes_texts_and_sets_in_small_batches(spark, monkeypatch, run):
    before = spark.conf.get(common.BATCH_BYTES)
    limits, after = seen_batches(spark, monkeypatch, ngram_join, run)
    assert str(common.TEXT_BYTES) in [re.sub(r"\D", "", x) for x in limits] and after == before


def test_a_batch_is_bounded_by_its_bytes(spark):
    texts = spark.range(0, 64, 1, 1).selectExpr("repeat('x', 262144) AS text")
    size = lambda batches: (pa.record_batch([pa.array([b.nbytes])], ["n"]) for b in batches)        # noqa: E731
    with common.small_batches(spark):
        sizes = [r["n"] for r in texts.mapInArrow(size, "n bigint").collect()]
    assert max(sizes) < common.TEXT_BYTES + 2 * 262144 and sum(sizes) >= 64 * 262144


def test_a_limit_that_the_session_set_holds_again(spark):
    spark.conf.set(common.BATCH_BYTES, "5m")
    try:
        with pytest.raises(KeyError), common.small_batches(spark):
            raise KeyError
        assert spark.conf.get(common.BATCH_BYTES) == "5m"
    finally:
        spark.conf.unset(common.BATCH_BYTES)


def held_mb():
    return int(re.search(r"RssAnon:\s+(\d+)", Path("/proc/self/status").read_text()).group(1)) / 1024


def fragmented(batches):
    """Many pieces that the allocator keeps when they are freed, as one at the end stays."""
    made = [bytearray(100_000) for _ in range(1500)]
    kept.append(bytearray(100_000))
    made.clear()
    yield from batches


kept = []


@pytest.mark.skipif(not Path("/proc/self/status").exists(), reason="no /proc")
def test_a_task_gives_back_what_it_freed():
    batch = pa.record_batch([pa.array([1])], ["n"])
    before = held_mb()
    assert list(fragmented(iter([batch]))) == [batch]
    plain = held_mb() - before
    assert list(common.thrifty(fragmented)(iter([batch]))) == [batch]
    assert plain > 100 and held_mb() - before < 50


def test_a_task_that_is_left_early_gives_back_too(monkeypatch):
    calls = []
    monkeypatch.setattr(common, "give_back", lambda: calls.append(1))
    rows = common.thrifty(lambda batches: batches)(iter([1, 2, 3]))
    assert next(rows) == 1 and not calls
    rows.close()
    assert calls == [1]

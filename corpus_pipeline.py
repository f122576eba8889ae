"""The corpus pipeline: each stage works on the rows that the stage before it kept."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession

from tallyline.llm import byte_bpe, exact_dedup, mixing, ngram_join, toxicity
from tallyline.llm.common import BATCH_BYTES, TEXT_BYTES, read_table
from tallyline.session import ensure_checkpoint_dir


#: Pieces that a worker of the last stage keeps: the stages before it leave the JVM at its full size, so a worker has some 200 MB.
BPE_PIECES = 120_000
BATCH_ROWS, TEXT_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch", 2_000


def in_small_batches(stage: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    """Texts pass to Python ``TEXT_ROWS`` rows at a time or, if the session says so, fewer, and ``TEXT_BYTES`` bytes at most: JVM and worker hold a
    whole batch outside the heap. The session keeps this, as a stage's rows are read after it has returned."""

    @wraps(stage)
    def begun(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        if not 0 < int(spark.conf.get(BATCH_ROWS)) <= TEXT_ROWS:
            spark.conf.set(BATCH_ROWS, str(TEXT_ROWS))
        spark.conf.set(BATCH_BYTES, str(TEXT_BYTES))
        return stage(spark, docs, sf_dir)

    return begun


@in_small_batches
def not_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the model, learned from ``labels``, doesn't reject."""
    return toxicity.clean_rows(docs, read_table(spark, sf_dir, "labels"))


@in_small_batches
def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of equal texts."""
    return exact_dedup.unique_rows(docs)


@in_small_batches
def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of documents that are linked by their shingles."""
    return ngram_join.one_of_each(docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The sources' shares: documents as often as the mix takes them."""
    return mixing.mixed_rows(docs)


@in_small_batches
def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of every document of the mix, as digests."""
    return byte_bpe.encoded_digests(docs, pieces=BPE_PIECES)


STAGES = [("toxicity", not_toxic), ("exact dedup", exact_copies), ("n-gram Jaccard join", near_copies), ("mixing", mixture), ("byte-level BPE", encoding)]

#: Learned scores and BPE have no SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on ``documents``; what a stage returns is written as Parquet and read again for the next."""
    folder = f"{ensure_checkpoint_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = read_table(spark, sf_dir, "documents")
    for at, (_, stage) in enumerate(STAGES):
        made = stage(spark, docs, sf_dir)
        if at == len(STAGES) - 1:
            return made
        made.write.parquet(f"{folder}/{at}")
        docs = spark.read.parquet(f"{folder}/{at}")
    return docs

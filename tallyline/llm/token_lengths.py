"""Exact token-length histogram: one pass encodes, and every question about a context limit is answered from the counts of lengths.

Documents are counted by encoded length. With suffix sums over the lengths, n(L) documents longer than L and t(L) their tokens, the
tokens kept under limit L are total - t(L) + L * n(L), so totals, quantiles and truncated totals for every limit follow without
another pass. Suffix sums go over blocks of ``BLOCK`` lengths first and inside a block then, so no task holds all lengths.

Cases: a null or empty text has length 0; repeated rows count as often as they stand; an empty table gives an empty result; other
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import public_tokenizers
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame, Window, functions as F

from tallyline.llm.byte_bpe import load_ranks
from tallyline.llm.common import materialise
from tallyline.llm.pieces import Pieces

VOCABULARY = "byte_bpe_50k.tiktoken"
BLOCK = 1024


@lru_cache(maxsize=2)
def _counter(path: str) -> Pieces:
    encoding = tiktoken.Encoding("lengths", pat_str=public_tokenizers.PATTERN, mergeable_ranks=load_ranks(path), special_tokens={})
    return Pieces(public_tokenizers.PATTERN, lambda match: len(encoding.encode_ordinary(match)), sum)


def lengths(docs: DataFrame, path: str | None = None) -> DataFrame:
    """n_tokens of every row of ``docs`` (text)."""
    path = path or public_tokenizers.path(VOCABULARY)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = _counter(path)
        for batch in batches:
            yield pa.record_batch([pa.array([sum(counter.values_of(t.as_py() or "")) for t in batch.column(0)], pa.int64())], ["n_tokens"])

    return docs.select("text").mapInArrow(rows, "n_tokens bigint")


def histogram(lengths_of: DataFrame) -> DataFrame:
    """n_tokens, docs; a written table, one row for each length, so that no question encodes again."""
    return materialise(lengths_of.groupBy("n_tokens").agg(F.count(F.lit(1)).alias("docs")), "length-histogram")


def limits(counts: DataFrame) -> DataFrame:
    """For every length L that occurs: documents of just L and of more, tokens of all documents and of those with more, tokens kept if
    every document is cut to L tokens, documents cut, and the share of documents of L tokens or fewer (the quantile L is at)."""
    block = counts.withColumn("block", F.floor(F.col("n_tokens") / BLOCK)).withColumn("tokens", F.col("n_tokens") * F.col("docs"))
    later = Window.orderBy(F.col("block").desc()).rowsBetween(Window.unboundedPreceding, -1)
    all_rows = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    sums = block.groupBy("block").agg(F.sum("docs").alias("d"), F.sum("tokens").alias("t")).select(
        "block", *[F.coalesce(F.sum(c).over(later), F.lit(0)).alias(f"{c}_later") for c in "dt"], F.sum("d").over(all_rows).alias("d_all"), F.sum("t").over(all_rows).alias("t_all"))
    inside = Window.partitionBy("block").orderBy(F.col("n_tokens").desc()).rowsBetween(Window.unboundedPreceding, -1)
    above = block.withColumn("d_in", F.coalesce(F.sum("docs").over(inside), F.lit(0))).withColumn("t_in", F.coalesce(F.sum("tokens").over(inside), F.lit(0))).join(sums, "block")
    longer, tokens = F.col("d_in") + F.col("d_later"), F.col("t_in") + F.col("t_later")
    return above.select(
        F.col("n_tokens").alias("context_limit"), "docs", longer.alias("docs_longer"), F.col("t_all").alias("total_tokens"), tokens.alias("tokens_of_longer"),
        (F.col("t_all") - tokens + F.col("n_tokens") * longer).alias("kept_tokens"), ((F.col("d_all") - longer) / F.col("d_all")).alias("share_within"))


def quantiles(table: DataFrame, shares: list[float]) -> DataFrame:
    """share, context_limit: the least length that at least this share of the documents is within."""
    wanted = table.sparkSession.createDataFrame([(float(s),) for s in shares], "share double")
    pairs = table.select("context_limit", "share_within", F.explode(F.array(*[F.lit(float(s)) for s in shares])).alias("share"))
    least = pairs.filter(F.col("share_within") >= F.col("share")).groupBy("share").agg(F.min("context_limit").alias("context_limit"))
    return wanted.join(least, "share", "left")


def kept_under(table: DataFrame, limit: int) -> DataFrame:
    """kept_tokens and docs_cut for any limit, also one that no document has just."""
    longer = F.when(F.col("context_limit") > limit, F.col("docs")).otherwise(F.lit(0))
    return table.agg(
        F.coalesce(F.max("total_tokens") - F.sum(F.col("context_limit") * longer) + F.sum(longer) * limit, F.lit(0)).alias("kept_tokens"), F.coalesce(F.sum(longer), F.lit(0)).alias("docs_cut"),
    ).select(F.lit(limit).alias("context_limit"), "kept_tokens", "docs_cut")

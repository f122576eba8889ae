"""Mixing sources to target weights, with DataFrame functions only.

Every source gets a share of all words by its weight, stopped at ``max_repeats`` times what it has; the excess goes to the others by
weight. A source takes whole epochs of all its documents first. The rest is an Efraimidis-Spirakis sample without replacement: a
document's key is an exponential draw divided by its quality weight, documents are taken in ascending order of the key until the
source's words are reached, and the document at the limit gives only the words that are missing.

A source's documents are never brought together: keys are cut into ranges of about ``RANGE_ROWS`` documents, words are summed per
range first (combined on the map side), and the running sum inside a range starts from the sum of the ranges before it. The table of
sources, one row each, is ordered in one task.

Cases: a null text has size 0 and is taken 0 times; the null source is a source of its own, last in order; a source without words
has target 0; the draw depends on doc_id and seed only (a null doc_id draws as an empty text), and rows that agree in it are ordered
by size; rows that agree in all of these are interchangeable. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from tallyline.llm.common import free_name, materialise

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5, 2, 1)
RANGE_ROWS = 4_096
SEED = "mix-1"


def size_of(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


def quality_of(text: Column, size: Column) -> Column:
    """1 for texts of six characters a word, less for texts of very short or very long words, 0.25 at least."""
    per_word = F.length(text).cast("double") / size.cast("double")
    return F.when(size > 0, F.greatest(F.lit(0.25), F.lit(1.0) - F.abs(per_word - F.lit(6.0)) / F.lit(12.0))).otherwise(F.lit(0.25))


def draw_of(doc_id: Column, seed: str = SEED) -> Column:
    """A number in (0, 1] from the id and the seed: 52 bits of a digest."""
    bits = F.conv(F.substring(F.md5(F.concat(F.lit(seed + ":"), F.coalesce(doc_id.cast("string"), F.lit("")))), 1, 13), 16, 10)
    return (bits.cast("bigint") + F.lit(1)).cast("double") / F.lit(float(2 ** 52))


def targets(sized: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_repeats: int = 3) -> DataFrame:
    """source, rows, source_size, target. A source's share stops at ``max_repeats`` times its size, and what it leaves is shared
    again: with sources in order of size to weight, all up to some place are stopped and the others share the rest by weight."""
    order = Window.orderBy(F.col("source").asc_nulls_last())
    sums = sized.groupBy("source").agg(F.count(F.lit(1)).alias("rows"), F.sum("size").alias("source_size"))
    place = F.pmod(F.row_number().over(order) - 1, F.lit(len(weights)))
    weight = F.element_at(F.array(*[F.lit(int(w)) for w in weights]), place.cast("int") + 1)
    weighed = sums.withColumn("weight", weight).withColumn("cap", F.col("source_size") * max_repeats)
    level = Window.orderBy((F.col("cap").cast("double") / F.col("weight")).asc(), F.col("source").asc_nulls_last())
    before, after, every = level.rowsBetween(Window.unboundedPreceding, -1), level.rowsBetween(0, Window.unboundedFollowing), Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    rest = (F.sum("source_size").over(every) - F.coalesce(F.sum("cap").over(before), F.lit(0))).cast("double") / F.sum("weight").over(after).cast("double")
    tried = weighed.withColumn("rest", rest).withColumn("open", F.col("rest") * F.col("weight") <= F.col("cap"))
    share = F.first(F.when(F.col("open"), F.col("rest")), ignorenulls=True).over(level.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    target = F.when(share.isNull(), F.col("cap").cast("double")).otherwise(F.least(F.col("cap").cast("double"), share * F.col("weight")))
    return tried.select("source", "rows", "source_size", target.alias("target"))


def mix(docs: DataFrame, carry: list[str] | None = None, weights: tuple[int, ...] = WEIGHTS, max_repeats: int = 3, seed: str = SEED, range_rows: int = RANGE_ROWS) -> DataFrame:
    """doc_id, size, source_size, target, taken of every row of ``docs`` (doc_id, text, source), and a struct ``row`` of the columns
    of ``carry``. Without ``carry`` the sizes are written once and the texts read once."""
    size = size_of(F.col("text"))
    key = -F.log(draw_of(F.col("doc_id"), seed)) / quality_of(F.col("text"), F.col("size"))
    kept = [F.struct(*[F.col(f"`{c}`") for c in carry]).alias("row")] if carry else []
    sized = docs.select("doc_id", "source", "text", size.alias("size"), *kept).withColumn("key", key).drop("text")
    if not carry:
        sized = materialise(sized, "mix-sizes")
    goals = materialise(targets(sized.select("source", "size"), weights, max_repeats), "mix-targets").withColumnRenamed("source", "of")
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("bigint")
    goals = goals.withColumn("epochs", epochs).withColumn("limit", F.floor(F.col("target") - F.col("epochs") * F.col("source_size")).cast("bigint"))
    ranges = F.greatest(F.lit(1), F.ceil(F.col("rows") / F.lit(range_rows)))
    place = F.floor((F.lit(1.0) - F.exp(-F.col("key"))) * ranges).cast("bigint")
    placed = sized.join(goals, F.col("source").eqNullSafe(F.col("of"))).withColumn("range", F.least(place, ranges.cast("bigint") - 1)).drop("of")
    sums = placed.groupBy("source", "range").agg(F.sum("size").alias("words"))
    running = Window.partitionBy("source").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select(F.col("source").alias("of"), F.col("range").alias("at"), F.coalesce(F.sum("words").over(running), F.lit(0)).alias("earlier"))
    inside = Window.partitionBy("source", "range").orderBy("key", F.col("doc_id").asc_nulls_last(), "size").rowsBetween(Window.unboundedPreceding, -1)
    summed = placed.withColumn("inside", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    found = summed.join(starts, F.col("source").eqNullSafe(F.col("of")) & (F.col("range") == F.col("at")))
    part = F.greatest(F.lit(0), F.least(F.col("size"), F.col("limit") - F.col("earlier") - F.col("inside")))
    return found.select("doc_id", "size", "source_size", "target", (F.col("epochs") * F.col("size") + part).alias("taken"), *(["row"] if carry else []))


def mixed_rows(docs: DataFrame) -> DataFrame:
    """The rows of the mix, with the columns of ``docs``: a document once for each whole time it is taken, and once more with its first
    words, a space between them, where the mix takes a part of it. Rows without words are not taken."""
    taken = mix(docs, carry=docs.columns).filter("taken > 0")
    n = free_name("n_words", docs.columns)
    counts = F.expr("transform(sequence(1, CAST(ceil(taken / size) AS INT)), i -> least(size, taken - (i - 1) * size))")
    copies = taken.select("row", "size", F.explode(counts).alias(n))
    first = F.array_join(F.slice(F.filter(F.split(F.col("row.text"), r"[\x20\x09-\x0D]+"), lambda w: w != ""), 1, F.col(n).cast("int")), " ")
    text = F.when(F.col(n) == F.col("size"), F.col("row.text")).otherwise(first)
    return copies.select(*[text.alias(c) if c == "text" else F.col(f"row.`{c}`") for c in docs.columns])

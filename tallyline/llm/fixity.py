"""Merkle fixity audit of WARC records: trees over ordered ranges of records, compared between replicas from the roots down.

A leaf covers one record id; a node covers the ids that agree after ``BITS`` more bits are dropped, an ordered range of records and so of
offsets in their file. A node's hash is the digest of its children's hashes in order. Two replicas are compared at the roots; below a
node whose hashes agree nothing is read again, so an audit of few faults touches few rows of each level. Levels are written tables.

Cases: a record id that repeats is one leaf, whose hash covers the number of its records and the sum of their digests, so order is
free; records without an id share one leaf; a null url or payload counts as empty; a replica without rows gives every record of the other
as missing; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from tallyline.llm.common import materialise

BITS = 4
FILE_BITS = 10
NO_ID = -(1 << 63)


def record_bytes(record_id: Column, url: Column, payload: Column) -> Column:
    """A response record: header lines, a blank line, the payload, two line ends."""
    body = F.coalesce(payload, F.lit(""))
    return F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:record:"), F.coalesce(record_id.cast("string"), F.lit("")), F.lit(">\r\nWARC-Target-URI: "), F.coalesce(url, F.lit("")),
        F.lit("\r\nContent-Length: "), F.octet_length(body).cast("string"), F.lit("\r\n\r\n"), body, F.lit("\r\n\r\n"))


def leaves(records: DataFrame) -> DataFrame:
    """node (the record id), n records, bytes, hash of ``records`` (record_id, url, payload); a written table."""
    data = record_bytes(F.col("record_id"), F.col("url"), F.col("payload"))
    hashed = records.select(F.coalesce(F.col("record_id").cast("bigint"), F.lit(NO_ID)).alias("node"), F.octet_length(data).cast("bigint").alias("bytes"), F.sha2(data, 256).alias("digest"))
    part = lambda at: F.sum(F.conv(F.substring("digest", at, 15), 16, 10).cast("decimal(38,0)"))
    grouped = hashed.groupBy("node").agg(F.count(F.lit(1)).alias("n"), F.sum("bytes").alias("bytes"), *[part(at).alias(f"s{at}") for at in (1, 16, 31, 46)])
    whole = F.sha2(F.concat_ws(":", "node", "n", "s1", "s16", "s31", "s46"), 256)
    return materialise(grouped.select("node", "n", "bytes", whole.alias("hash")), "fixity-leaves")


def tree(leaf_table: DataFrame, levels: int) -> list[DataFrame]:
    """The levels from the leaves up; each node has 2**BITS children at most."""
    out = [leaf_table]
    for _ in range(levels):
        children = out[-1].select(F.shiftright("node", BITS).alias("node"), F.struct(F.col("node").alias("child"), "hash").alias("c"))
        digest = F.sha2(F.concat_ws(",", F.transform(F.array_sort(F.collect_list("c")), lambda c: F.concat_ws("=", c["child"], c["hash"]))), 256)
        out.append(materialise(children.groupBy("node").agg(digest.alias("hash")), "fixity-level"))
    return out


def depth(*leaf_tables: DataFrame) -> int:
    """Levels until the ids of each sign share one root; the leaf of records without an id is left to its own root."""
    most = 1
    for t in leaf_tables:
        top = t.filter(F.col("node") != NO_ID).agg(F.max(F.greatest(F.col("node"), -F.col("node")))).first()[0]
        most = max(most, top or 1)
    return max(1, -(-most.bit_length() // BITS))


def differing(a: DataFrame, b: DataFrame) -> DataFrame:
    """Nodes whose hashes differ or that one side lacks."""
    right = b.select(F.col("node").alias("other"), F.col("hash").alias("other_hash"))
    return a.select("node", "hash").join(right, F.col("node") == F.col("other"), "full").filter(~F.col("hash").eqNullSafe(F.col("other_hash"))).select(F.coalesce("node", "other").alias("node"))


def audit(records: DataFrame, replica: DataFrame) -> DataFrame:
    """record_id, file, file_offset, n_bytes, problem of every record id at which ``replica`` differs from ``records``: altered, missing
    or extra (not in ``records``, or there fewer times). Offsets are those of ``records``; an id they lack has none."""
    mine, theirs = leaves(records), leaves(replica)
    levels = depth(mine, theirs)
    left, right = tree(mine, levels), tree(theirs, levels)
    bad = materialise(differing(left[levels], right[levels]), "fixity-bad")
    for level in range(levels - 1, -1, -1):
        parents = bad.withColumnRenamed("node", "parent")
        below = [side[level].withColumn("parent", F.shiftright("node", BITS)).join(parents, "parent", "left_semi") for side in (left, right)]
        bad = materialise(differing(*below), "fixity-bad")
    order = Window.partitionBy(F.shiftright("node", FILE_BITS)).orderBy("node").rowsBetween(Window.unboundedPreceding, -1)
    touched = bad.select(F.shiftright("node", FILE_BITS).alias("file")).distinct()
    placed = mine.withColumn("file", F.shiftright("node", FILE_BITS)).join(touched, "file", "left_semi").withColumn("file_offset", F.coalesce(F.sum("bytes").over(order), F.lit(0)))
    own = placed.select("node", "file_offset", F.col("bytes").alias("n_bytes"), F.col("n").alias("n_own"))
    other = theirs.select("node", F.col("n").alias("n_other"))
    found = bad.join(own, "node", "left").join(other, "node", "left")
    have, has = F.coalesce("n_own", F.lit(0)), F.coalesce("n_other", F.lit(0))
    problem = F.when(has < have, F.lit("missing")).when(has > have, F.lit("extra")).otherwise(F.lit("altered"))
    return found.select(F.when(F.col("node") != NO_ID, F.col("node")).alias("record_id"), F.shiftright("node", FILE_BITS).alias("file"), "file_offset", "n_bytes", problem.alias("problem"))


def damaged(records: DataFrame) -> DataFrame:
    """A replica with known faults, to prove an audit: of the record ids, some lose a record, some have one twice, and some have the
    first character of their payload overwritten."""
    kept = records.filter(F.coalesce(F.pmod("record_id", F.lit(509)) != 7, F.lit(True)))
    hit = F.coalesce(F.pmod("record_id", F.lit(211)) == 5, F.lit(False)) & (F.length("payload") > 0)
    altered = kept.withColumn("payload", F.when(hit, F.concat(F.lit("#"), F.expr("substr(payload, 2)"))).otherwise(F.col("payload")))
    return altered.unionByName(altered.filter(F.pmod("record_id", F.lit(997)) == 11))


def audit_pages(pages: DataFrame) -> DataFrame:
    """The audit of ``pages`` (page_id, url, html) as records against their damaged replica."""
    records = pages.select(F.col("page_id").alias("record_id"), "url", F.col("html").alias("payload"))
    return audit(records, damaged(records))

"""A consumer's own position in a ledger, and entries that are resolved and shown once.

Acknowledgements are a stream of their own: (consumer, acked), the time up to which the consumer has seen the ledger. They are kept in a ledger
like any other, where the latest one counts, so that a late or repeated acknowledgement moves nothing back.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, functions as F

from tallyline.streaming.ledger import read_ledger, start_ledger


def latest(key: list[str], acked: str) -> Callable[[DataFrame | None, DataFrame], DataFrame]:
    """Merge rule: the latest time of every consumer; nulls are no acknowledgement."""
    def merge(old: DataFrame | None, new: DataFrame) -> DataFrame:
        both = new.select(*key, acked) if old is None else old.select(*key, acked).unionByName(new.select(*key, acked))
        return both.where(F.col(acked).isNotNull()).groupBy(*key).agg(F.max(acked).alias(acked))
    return merge


def start_acknowledgements(stream: DataFrame, path: str, checkpoint: str, *, consumer: str = "consumer", acked: str = "acked", **options):
    """Start the query that keeps every consumer's position."""
    return start_ledger(stream.select(consumer, acked), path, checkpoint, [consumer], latest([consumer], acked), **options)


def unseen(rows: DataFrame, acks: DataFrame | None, consumers: DataFrame, *, consumer: str = "consumer", acked: str = "acked", first_seen: str = "first_seen", day: str | None = None, days: int = 7) -> DataFrame:
    """(consumer, rows...) that each of ``consumers`` hasn't acknowledged: first seen after its position.

    A consumer without a position is shown the ``days`` days before the newest one of ``day`` (the first sighting if none is named). ``consumers`` is a list of people or programs, one row each.
    """
    at = F.to_date(F.col(day or first_seen))
    newest = rows.agg(F.max(at)).first()[0]
    position = consumers.select(consumer).distinct()
    position = position.withColumn(acked, F.lit(None).cast("timestamp")) if acks is None else position.join(acks.select(consumer, acked), consumer, "left")
    recent = F.lit(False) if newest is None else at >= F.date_sub(F.lit(newest), days)
    held = position.collect()                                                          # a row per consumer
    if not held:
        return rows.limit(0).withColumn(consumer, F.lit(None).cast(position.schema[consumer].dataType))
    each = F.array(*[F.struct(F.lit(r[consumer]).alias(consumer), F.lit(r[acked]).cast("timestamp").alias(acked)) for r in held])
    shown = F.when(F.col("_c." + acked).isNull(), recent).otherwise(F.col(first_seen) > F.col("_c." + acked))
    return rows.withColumn("_c", F.explode(each)).where(shown).withColumn(consumer, F.col("_c." + consumer)).drop("_c")


def read_positions(spark, path: str) -> DataFrame | None:
    return read_ledger(spark, path)


def start_detected_entries(stream: DataFrame, ids: DataFrame, owners: DataFrame, path: str, checkpoint: str, *, entry: str, name: str, owner: str, event_time: str | None = None, keep_seen: str | None = None, resolve_key: Callable = F.col):
    """Start the query that resolves each new entry once: (entry, ..., id, owner_id, is_resolved), into one folder per batch.

    Entries that were seen before are dropped by a set kept in the query's state, so a source that repeats its list emits nothing twice; with ``event_time`` and
    ``keep_seen`` the set forgets entries that old. Names and owners are looked up in the static tables ``ids`` (key, id) and ``owners`` (owner, owner_id);
    an unknown one leaves a null and a false ``is_resolved``. A batch that Spark runs again overwrites its own folder.
    """
    fresh = stream.where(F.col(entry).isNotNull())
    fresh = fresh.withWatermark(event_time, keep_seen).dropDuplicatesWithinWatermark([entry]) if event_time and keep_seen else fresh.dropDuplicates([entry])
    known = ids.select(F.col("key").alias("_key"), "id").dropDuplicates(["_key"])
    held = owners.select(F.col("owner").alias("_owner"), "owner_id").dropDuplicates(["_owner"])

    def write(batch: DataFrame, batch_id: int) -> None:
        out = batch.withColumn("_key", resolve_key(name)).join(known, "_key", "left").drop("_key").withColumn("_owner", F.col(owner)).join(held, "_owner", "left").drop("_owner")
        out.withColumn("is_resolved", F.col("id").isNotNull() & F.col("owner_id").isNotNull()).write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return fresh.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()

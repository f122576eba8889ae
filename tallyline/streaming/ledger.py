"""Streaming ledgers: keyed first/last sightings and window replacement through ``foreachBatch``.

A ledger folder is cut into hash buckets with a version each. A micro-batch reads and rewrites only the buckets it touches, as one version
above all that other batches wrote, and names its stream's run and its batch id there. A replayed batch finds what it wrote by that name and
writes it again, so nothing is lost or doubled; a stream that starts anew without its position counts batches from 0 again, but is
another run, whose versions come after the stored ones.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F

from tallyline.operators.merge import first_last_seen, merge_ledger, replace_window_keep

BUCKETS = 64
PLACE = ["bucket", "version", "ledger_run", "ledger_batch"]
#: What Spark says of a folder that isn't there, and of one without a data file.
NOT_WRITTEN = ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA")


def bucket_of(key: list[str], buckets: int = BUCKETS):
    return F.pmod(F.xxhash64(*[F.col(k) for k in key]), F.lit(buckets)).cast("int")


def stored_rows(spark: SparkSession, path: str) -> DataFrame | None:
    """All versions; None before the first batch. A folder that can't be read is an error, not an empty ledger."""
    try:
        return spark.read.parquet(path)
    except AnalysisException as e:
        if e.getCondition() in NOT_WRITTEN:
            return None
        raise


def newest_version(rows: DataFrame) -> DataFrame:
    """Rows of the newest version of every bucket."""
    newest = rows.groupBy("bucket").agg(F.max("version").alias("version"))            # partition columns only
    return rows.join(F.broadcast(newest), ["bucket", "version"], "left_semi")         # at most one row per bucket


def read_ledger(spark: SparkSession, path: str) -> DataFrame | None:
    rows = stored_rows(spark, path)
    return None if rows is None else newest_version(rows).drop(*PLACE)


def ledger_batch(path: str, key: list[str], merge: Callable[..., DataFrame], *, buckets: int = BUCKETS, day: str | None = None,
                 run: Callable[[SparkSession], str] | None = None) -> Callable[[DataFrame, int], None]:
    """foreachBatch function that merges a micro-batch into the ledger's touched buckets.

    ``merge`` gets the touched buckets' rows (None before the first batch) and the batch's rows; with ``day``, also the newest day of
    the batch and all the ledger. ``run`` names the stream that batch ids belong to; without it, they go on with the newest stored run.
    """
    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        new = batch.withColumn("bucket", bucket_of(key, buckets)).persist()
        try:
            touched = [r[0] for r in new.select("bucket").distinct().collect()]       # at most ``buckets`` numbers
            if not touched:
                return
            name, version, current = run(spark) if run else None, 1, None
            stored = stored_rows(spark, path)
            if stored is not None:
                name = name or stored.agg(F.max_by("ledger_run", "version")).first()[0]
                stored = stored.where((F.col("ledger_run") != name) | (F.col("ledger_batch") != batch_id))
                version = 1 + (stored.agg(F.max("version")).first()[0] or 0)
                current = newest_version(stored) if version > 1 else None
            old = None if current is None else current.where(F.col("bucket").isin(*touched)).drop(*PLACE)
            fresh = new.drop("bucket")
            if day is None:
                merged = merge(old, fresh)
            else:
                days = [d for part in (current, new) if part is not None if (d := part.agg(F.max(day)).first()[0]) is not None]
                merged = merge(old, fresh, max(days, default=None))
            out = merged.withColumn("bucket", bucket_of(key, buckets)).withColumns(
                {"version": F.lit(version), "ledger_run": F.lit(name or "direct"), "ledger_batch": F.lit(batch_id)})
            out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*PLACE).parquet(path)
        finally:
            new.unpersist()
    return write


def run_of(checkpoint: str) -> Callable[[SparkSession], str]:
    """The id that Spark keeps in a query's checkpoint folder: the same after a restart, a new one after a reset."""
    return lambda spark: "query-" + spark.read.schema("id string").json(f"{checkpoint}/metadata").first()["id"]


def sightings(key: list[str], seen: str, attributes: list[str]) -> Callable[[DataFrame | None, DataFrame], DataFrame]:
    """Merge rule: earliest first sighting, newest last sighting, newest known attribute. Order of arrival does not matter."""
    def merge(old: DataFrame | None, new: DataFrame) -> DataFrame:
        fresh = first_last_seen(new, key, seen, attributes)
        if old is None:
            return fresh
        both = old.unionByName(fresh)
        return both.groupBy(*key).agg(F.min("first_seen").alias("first_seen"), F.max("last_seen").alias("last_seen"), F.sum("n_seen").alias("n_seen"),
                                      *[F.max_by(a, F.when(F.col(a).isNotNull(), F.col("last_seen"))).alias(a) for a in attributes])
    return merge


def transactions(signature: list[str]) -> Callable[[DataFrame | None, DataFrame], DataFrame]:
    """Merge rule of the transaction ledger (key ``txn_key``)."""
    return lambda old, new: merge_ledger(old, new, signature=signature)


def window_batch(path: str, key: list[str], day: str, *, overlap_days: int, buckets: int = BUCKETS, run: Callable[[SparkSession], str] | None = None) -> Callable[[DataFrame, int], None]:
    """foreachBatch function for an overlapping re-pull: rows of the last ``overlap_days`` before the newest day of ledger and batch
    are replaced, late corrections older than that are ignored; keys in no fresh row keep their stored copy."""
    def merge(old: DataFrame | None, new: DataFrame, newest) -> DataFrame:
        inside = F.col(day) >= F.date_sub(F.lit(newest).cast("date"), overlap_days)
        new = new.where(inside)
        if old is None:
            return new
        vanished = old.where(inside).select(*key).join(new.select(*key), key, "left_anti")
        return replace_window_keep(old, new, in_window=inside, key=key, keep=vanished)
    return ledger_batch(path, key, merge, buckets=buckets, day=day, run=run)


def start_ledger(stream: DataFrame, path: str, checkpoint: str, key: list[str], merge: Callable[[DataFrame | None, DataFrame], DataFrame], *, available_now: bool = True, buckets: int = BUCKETS):
    """Start the ledger query; the checkpoint folder holds the consumer's position."""
    writer = stream.writeStream.foreachBatch(ledger_batch(path, key, merge, buckets=buckets, run=run_of(checkpoint))).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="1 minute")).start()


def snapshot_alerts(stored: Callable[[SparkSession], DataFrame | None], diff: Callable[[DataFrame, DataFrame], DataFrame], sink: Callable[[DataFrame, int], None]) -> Callable[[DataFrame, int], None]:
    """foreachBatch function that compares each incoming snapshot with the stored one and hands the difference to a sink."""
    def run(batch: DataFrame, batch_id: int) -> None:
        before = stored(batch.sparkSession)
        if before is not None:
            sink(diff(before, batch), batch_id)
    return run

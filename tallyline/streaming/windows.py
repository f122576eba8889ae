"""Event-time windows over a stream, and the batch forms that give the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F


def with_event_time(stream: DataFrame, ts: str, watermark: str | None) -> DataFrame:
    """``ts`` as a zoned timestamp (a watermark refuses naive ones), with a watermark when asked for."""
    out = stream.withColumn(ts, F.col(ts).cast("timestamp"))
    return out.withWatermark(ts, watermark) if watermark else out


def tumbling_counts(rows: DataFrame, ts: str, keys: list[str], width: str, *, value: str | None = None, watermark: str | None = "1 day") -> DataFrame:
    """(start, end, keys, n, v) per tumbling window; works on a stream in append mode and on a batch."""
    aggs = [F.count(F.lit(1)).alias("n")] + ([F.sum(value).alias("v")] if value else [])
    out = with_event_time(rows, ts, watermark).groupBy(F.window(ts, width), *keys).agg(*aggs)
    return out.select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), *keys, "n", *(["v"] if value else []))


def sliding_counts(rows: DataFrame, ts: str, keys: list[str], width: str, slide: str, *, watermark: str | None = "1 day") -> DataFrame:
    out = with_event_time(rows, ts, watermark).groupBy(F.window(ts, width, slide), *keys).agg(F.count(F.lit(1)).alias("n"))
    return out.select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), *keys, "n")


def session_stream(stream: DataFrame, ts: str, keys: list[str], gap: str, *, watermark: str = "1 day") -> DataFrame:
    out = with_event_time(stream, ts, watermark).groupBy(F.session_window(ts, gap), *keys).agg(F.count(F.lit(1)).alias("n"))
    return out.select(*keys, F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n")


def sessions(rows: DataFrame, ts: str, keys: list[str], gap: str, *, watermark: str | None = None) -> DataFrame:
    """(keys, start, end, n): sessions closed by a pause longer than ``gap``, as the native session window does.

    Batch form. Events are first summed per (key, piece of half a gap): two events of one piece always share a session. So a
    window holds at most twice (time span / gap) rows of a key, however many events the key has.
    """
    if rows.isStreaming:
        return session_stream(rows, ts, keys, gap, watermark=watermark or "1 day")
    seconds = F.lit(_seconds(gap)).cast("long")
    t = F.unix_micros(F.col(ts).cast("timestamp"))
    piece = F.floor(t / (seconds * 500_000))
    parts = rows.groupBy(*keys, piece.alias("_piece")).agg(F.min(t).alias("_a"), F.max(t).alias("_b"), F.count(F.lit(1)).alias("_n"))
    w = Window.partitionBy(*keys).orderBy("_piece")
    fresh = F.coalesce((F.col("_a") - F.lag("_b").over(w)) > seconds * 1_000_000, F.lit(True))
    numbered = parts.withColumn("_new", fresh.cast("int")).withColumn("_sid", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    out = numbered.groupBy(*keys, "_sid").agg(F.min("_a").alias("_s"), F.max("_b").alias("_e"), F.sum("_n").alias("n"))
    return out.select(*keys, F.timestamp_micros("_s").alias("start"), F.timestamp_micros((F.col("_e") + seconds * 1_000_000).cast("long")).alias("end"), "n")


def _seconds(gap: str) -> int:
    amount, unit = gap.split()
    return int(amount) * {"second": 1, "minute": 60, "hour": 3600, "day": 86400}[unit.rstrip("s")]


def deduplicated(stream: DataFrame, ts: str, keys: list[str], *, watermark: str = "7 days") -> DataFrame:
    """First row per key within the watermark."""
    return with_event_time(stream, ts, watermark).dropDuplicatesWithinWatermark(keys)



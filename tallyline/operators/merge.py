"""Incremental maintenance: replace partitions and windows, upsert, append-only ledgers."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from tallyline.operators.ranking import asc, desc, keep_first


def union_all(*frames: DataFrame) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def replace_keys(existing: DataFrame, new: DataFrame, key: list[str], replaced: DataFrame | None = None) -> DataFrame:
    """``new`` plus the existing rows whose key is not being replaced (by default the keys in ``new``)."""
    gone = (new if replaced is None else replaced).select(*key).distinct()
    return union_all(existing.join(gone, key, "left_anti"), new)


def replace_periods(existing: DataFrame, new: DataFrame, periods: list, *, period: str = "season") -> DataFrame:
    """Replace the named periods, keep every other one."""
    return union_all(existing.where(~F.col(period).isin(*periods)), new.where(F.col(period).isin(*periods)))


def replace_periods_unless_skipped(existing: DataFrame, new: DataFrame, periods: list, skipped: list, *, period: str = "season") -> DataFrame:
    """Replace ingested periods, except those in which a page was skipped: they keep their stored rows and gain the new ones."""
    full = [p for p in periods if p not in skipped]
    fresh = new.join(existing.where(F.col(period).isin(*skipped)), new.columns, "left_anti") if skipped else new
    return union_all(existing.where(~F.col(period).isin(*full)) if full else existing, fresh)


def replace_pulled_pairs(existing: DataFrame, new: DataFrame, pulled: DataFrame, pair: list[str]) -> DataFrame:
    """Replace exactly the pairs pulled; a pulled pair with no new row never erases stored rows."""
    with_rows = pulled.select(*pair).distinct().join(new.select(*pair).distinct(), pair, "left_semi")
    return union_all(existing.join(with_rows, pair, "left_anti"), new.join(pulled.select(*pair).distinct(), pair, "left_semi"))


def replace_window(existing: DataFrame, new: DataFrame, *, in_window: Column) -> DataFrame:
    """Replace the rows of a window (a period and a date range, given as a predicate on the existing rows)."""
    return union_all(existing.where(~F.coalesce(in_window, F.lit(False))), new)


def replace_window_keep(existing: DataFrame, new: DataFrame, *, in_window: Column, key: list[str], keep: DataFrame) -> DataFrame:
    """Replace a window, but the stored copy of a kept key stays and its fresh copy is ignored."""
    held = keep.select(*key).distinct()
    rescued = existing.where(F.coalesce(in_window, F.lit(False))).join(held, key, "left_semi")
    return union_all(existing.where(~F.coalesce(in_window, F.lit(False))), rescued, new.join(held, key, "left_anti"))


def upsert(existing: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """One row per key: a new non-null value wins, a new null never erases."""
    old = existing.select(*key, *[F.col(c).alias("_o_" + c) for c in existing.columns if c not in key])
    both = old.join(new, key, "full")
    columns = [*existing.columns, *[c for c in new.columns if c not in existing.columns]]
    return both.select(*key, *[F.coalesce(*([F.col(c)] if c in new.columns else []), *([F.col("_o_" + c)] if c in existing.columns else [])).alias(c)
                               for c in columns if c not in key])


def merge_id_map(existing: DataFrame, new: DataFrame) -> DataFrame:
    """Upsert by (source, source_id); rows of other sources are untouched."""
    return replace_keys(existing, new, ["source", "source_id"])


def layered(frames: list[DataFrame], key: list[str], columns: list[str]) -> DataFrame:
    """First non-null value per column over sources in order of precedence; one aggregate, not one join per source."""
    tagged = union_all(*[f.select(*key, *[(F.col(c) if c in f.columns else F.lit(None)).alias(c) for c in columns]).withColumn("_rank", F.lit(i))
                         for i, f in enumerate(frames)])
    return tagged.groupBy(*key).agg(*[F.min_by(c, F.when(F.col(c).isNotNull(), F.col("_rank"))).alias(c) for c in columns])


def fill_from(rows: DataFrame, sources: list[DataFrame], key: list[str], column: str) -> DataFrame:
    """Fill nulls of ``column`` from ordered sources."""
    fill = layered(sources, key, [column]).withColumnRenamed(column, "_fill")
    return rows.join(fill, key, "left").withColumn(column, F.coalesce(F.col(column), F.col("_fill"))).drop("_fill")


def dedupe_conflicting(rows: DataFrame, key: list[str], prefer: list[str]) -> tuple[DataFrame, DataFrame]:
    """(kept, counts): identical duplicates first, then one row per key by the preferred measures; counts by drop reason."""
    distinct = rows.distinct()
    n = F.count(F.lit(1))
    kept = keep_first(distinct, key, [desc(c) for c in prefer] + [asc(c) for c in sorted(rows.columns) if c not in key + prefer])
    a, b, c = rows.agg(n.alias("n")), distinct.agg(n.alias("n")), distinct.select(*key).distinct().agg(n.alias("n"))
    counts = a.select(F.lit("identical duplicate").alias("reason"), (F.col("n") - b.scalar()).alias("n_rows")).unionByName(
        b.select(F.lit("conflicting duplicate").alias("reason"), (F.col("n") - c.scalar()).alias("n_rows")))
    return kept, counts


def drop_report(rows: DataFrame, reason: Column) -> DataFrame:
    """(reason, n_rows) of the rows a reason applies to."""
    return rows.withColumn("reason", reason).where(F.col("reason").isNotNull()).groupBy("reason").agg(F.count(F.lit(1)).alias("n_rows"))


def first_last_seen(observed: DataFrame, key: list[str], seen: str, attributes: list[str] | None = None) -> DataFrame:
    """Ledger of keyed observations: first and last sighting, and each attribute's newest non-null value."""
    return observed.groupBy(*key).agg(
        F.min(seen).alias("first_seen"), F.max(seen).alias("last_seen"), F.count(F.lit(1)).alias("n_seen"),
        *[F.max_by(a, F.when(F.col(a).isNotNull(), F.col(seen))).alias(a) for a in (attributes or [])])


def merge_ledger(existing: DataFrame | None, new: DataFrame, *, key: str = "txn_key", signature: list[str] | None = None,
                 fill: tuple[str, ...] = ("player_id", "other_team_id")) -> DataFrame:
    """Append-only merge. A known key keeps ``first_seen``, gets the fresh ``last_seen`` and fills of nulls only. With a
    ``signature`` (day, team, text), a stored row whose source text is now read differently is superseded, and its successor
    inherits the earliest ``first_seen``. Merging the same pull twice changes nothing."""
    fresh = new.groupBy(key).agg(*[F.min_by(c, F.struct("last_seen", *[x for x in (signature or []) if x != c])).alias(c) for c in new.columns if c != key])
    if existing is None:
        return fresh.select(*new.columns)
    old = existing
    if signature:
        read_now = fresh.select(*signature).distinct()
        stale = old.join(read_now, signature, "left_semi").join(fresh.select(key), key, "left_anti")
        inherited = stale.groupBy(*signature).agg(F.min("first_seen").alias("_inherit"))
        known = old.select(key, F.lit(True).alias("_known"))
        fresh = fresh.join(inherited, signature, "left").join(known, key, "left").withColumn(
            "first_seen", F.when(F.col("_known").isNull(), F.least("first_seen", "_inherit")).otherwise(F.col("first_seen"))).drop("_inherit", "_known")
        old = old.join(stale.select(key), key, "left_anti")
    right = fresh.select(key, *[F.col(c).alias("_n_" + c) for c in fresh.columns if c != key])
    both = old.withColumn("_old", F.lit(True)).join(right, key, "full")

    def merged(c: str) -> Column:
        mine, theirs = F.col(c), F.col("_n_" + c)
        if c == "last_seen":
            return F.coalesce(theirs, mine)
        if c in fill:
            return F.coalesce(mine, theirs)
        return F.when(F.col("_old").isNull(), theirs).otherwise(mine)

    return both.select(key, *[merged(c).alias(c) for c in old.columns if c != key]).select(*existing.columns)


def fresh_rows(existing: DataFrame | None, new: DataFrame, key: list[str]) -> DataFrame:
    """Rows of a pull whose key was never stored."""
    return new if existing is None else new.join(existing.select(*key).distinct(), key, "left_anti")


def latest_snapshot(snapshots: DataFrame, *, day: str = "snapshot_date", before: str | None = None, on_or_before: str | None = None) -> DataFrame:
    """All rows of the newest day (strictly before, or up to, a date). The day is a scalar subquery: no window, one extra scan of one column."""
    scope = snapshots
    if before is not None:
        scope = scope.where(F.col(day) < F.lit(before).cast("date"))
    if on_or_before is not None:
        scope = scope.where(F.col(day) <= F.lit(on_or_before).cast("date"))
    return scope.where(F.col(day) == scope.agg(F.max(day)).scalar())


def latest_per_key(rows: DataFrame, key: list[str], order: str, *, seen: str | None = None) -> DataFrame:
    """Newest row per key, optionally only among rows still in the latest pull. An aggregate: hot keys combine on the map side."""
    scope = rows if seen is None else rows.where(F.col(seen) == rows.agg(F.max(seen)).scalar())
    rest = [c for c in rows.columns if c not in key]
    best = scope.groupBy(*key).agg(F.max_by(F.struct(*rest), F.struct(F.col(order), *[F.col(c) for c in sorted(rest)])).alias("_r"))
    return best.select(*key, *[F.col("_r").getField(c).alias(c) for c in rest])


def as_of_latest(events: DataFrame, key: list[str], day: str, columns: list[str], as_of: str) -> DataFrame:
    """State of each key as of a date: columns of its newest event on or before it."""
    past = events.where(F.to_date(day) <= F.lit(as_of).cast("date"))
    return past.groupBy(*key).agg(*[F.max_by(c, F.struct(F.col(day), F.col(c))).alias(c) for c in columns], F.max(day).alias(day))


def refine_within(rows: DataFrame, other: DataFrame, key: list[str], column: str, tolerance: float) -> DataFrame:
    """Take the second source's finer value where it agrees within the tolerance."""
    j = rows.join(other.select(*key, F.col(column).alias("_fine")), key, "left")
    return j.withColumn(column, F.when(F.abs(F.col(column) - F.col("_fine")) <= tolerance, F.col("_fine")).otherwise(F.col(column))).drop("_fine")


def split_final(pulled: DataFrame, team_totals: DataFrame, entity_totals: DataFrame, *, event: str = "game_id", group: str = "team_id", value: str = "pts",
                groups_per_event: int = 2) -> tuple[DataFrame, DataFrame]:
    """(final, pending) event ids: final when both groups are present with a score and their entity rows add up to it."""
    parts = entity_totals.groupBy(event, group).agg(F.sum(value).alias("_parts"))
    sides = team_totals.select(event, group, F.col(value).alias("_score")).join(parts, [event, group], "left")
    agrees = F.coalesce(F.col("_score") == F.col("_parts"), F.lit(False))
    ok = sides.groupBy(event).agg(F.bool_and(agrees).alias("_ok"), F.countDistinct(group).alias("_n")).where(F.col("_ok") & (F.col("_n") == groups_per_event)).select(event)
    ids = pulled.select(event).distinct()
    return ids.join(ok, event, "left_semi"), ids.join(ok, event, "left_anti")


class ShrinkRefused(RuntimeError):
    """A merge would leave fewer rows than are stored."""


def guarded(existing: DataFrame, merged: DataFrame, *, allow: int = 0) -> DataFrame:
    """``merged``, unless it holds fewer rows than ``existing`` by more than ``allow``."""
    before, after = existing.count(), merged.count()
    if after < before - allow:
        raise ShrinkRefused(f"{before} stored rows would become {after}")
    return merged


def date_chunks(first: Column, last: Column, days: int) -> Column:
    """Generator of (start, end) pieces of a date range."""
    starts = F.sequence(first, last, F.expr(f"INTERVAL {days} DAYS"))
    return F.explode(F.transform(starts, lambda s: F.struct(s.alias("start"), F.least(F.date_add(s, days - 1), last).alias("end"))))


def selected_window(ledger: DataFrame, *, watermark: str | None = None, since: str | None = None, days: int | None = None, today: str | None = None,
                    seen: str = "first_seen", dated: str = "txn_date") -> DataFrame:
    """Rows first seen after a watermark, dated since a day, or dated within the last ``days``."""
    if watermark is not None:
        return ledger.where(F.col(seen) > F.lit(watermark).cast("timestamp"))
    if since is not None:
        return ledger.where(F.col(dated) >= F.lit(since).cast("date"))
    if days is not None:
        return ledger.where(F.col(dated) >= F.date_sub(F.lit(today).cast("date") if today else F.current_date(), days))
    return ledger

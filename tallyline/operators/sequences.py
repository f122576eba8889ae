"""Runs, gaps and absence shapes over a group's schedule.

Absence has no row: it is read off the gaps between an entity's consecutive appearances in its group's numbered schedule, so
no dense entity x date grid is built. Windows here hold one entity's appearances within one period, at most one per schedule
entry, which bounds them by the calendar; inputs are reduced to distinct (entity, schedule entry) rows before any window.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F


@dataclass(frozen=True)
class Roles:
    """Column names of an event table."""

    entity: str = "player_id"
    group: str = "team_id"
    period: str = "s"
    event: str = "game_id"
    day: str = "game_date"


def numbered_schedule(schedule: DataFrame, r: Roles = Roles()) -> DataFrame:
    """One row per (group, period, event) with ``idx`` from 0, ``n_events``, ``b2b`` (the day after the previous event) and
    ``prev_b2b`` (that flag of the event before)."""
    named = [F.col(c) for c in (r.group, r.period, r.event) if c != r.day]
    rows = schedule.select(*named, F.to_date(r.day).alias(r.day)).distinct()
    w = Window.partitionBy(r.group, r.period).orderBy(r.day, r.event)
    gap = F.datediff(F.col(r.day), F.lag(r.day).over(w))
    rows = rows.select("*", (F.row_number().over(w) - 1).alias("idx"), F.coalesce(gap == 1, F.lit(False)).alias("b2b"),
                       F.count(F.lit(1)).over(Window.partitionBy(r.group, r.period)).alias("n_events"))
    return rows.withColumn("prev_b2b", F.coalesce(F.lag("b2b").over(w), F.lit(False)))


def flag_back_to_backs(events: DataFrame, group: list[str], day: str, event: str) -> DataFrame:
    w = Window.partitionBy(*group).orderBy(day, event)
    return events.withColumn("b2b", F.coalesce(F.datediff(F.col(day), F.lag(day).over(w)) == 1, F.lit(False)))


def primary_group(presence: DataFrame, r: Roles = Roles()) -> DataFrame:
    """(entity, period): the group with the most events, ties to the lower group id; ``n_groups`` counts all of them."""
    counts = presence.groupBy(r.entity, r.period, r.group).agg(F.count(F.lit(1)).alias("_n"))
    return counts.groupBy(r.entity, r.period).agg(
        F.min_by(r.group, F.struct(-F.col("_n"), F.col(r.group))).alias(r.group), F.count(F.lit(1)).alias("n_groups"))


def placed_presence(presence: DataFrame, schedule: DataFrame, r: Roles = Roles()) -> DataFrame:
    """Appearances of each entity for its primary group, numbered on that group's schedule."""
    seen = presence.select(r.entity, r.period, r.group, r.event).distinct()
    mine = seen.join(primary_group(seen, r), [r.entity, r.period, r.group])
    return mine.join(numbered_schedule(schedule, r), [r.group, r.period, r.event])


def absence_profile(presence: DataFrame, schedule: DataFrame, r: Roles = Roles(), *, short: int = 2) -> DataFrame:
    """One row per (entity, period) that appears at all.

    ``n_events`` schedule length, ``gp`` appearances, ``missed``; ``first_idx`` events missed before the first appearance,
    ``tail_len`` events from it on; ``n_runs`` and ``longest_run`` over all missed runs; ``block_start``, ``block_len`` and
    ``block_tail`` of the longest interior run (the earliest of equals); ``iso_n``, ``iso_runs`` the events and runs of
    interior runs of at most ``short`` events; ``rest_n`` the one-event interior misses that were a back-to-back.
    """
    placed = placed_presence(presence, schedule, r)
    w = Window.partitionBy(r.entity, r.period).orderBy("idx")
    gap = F.col("idx") - F.lag("idx").over(w) - 1
    rows = placed.withColumn("gap", F.when(gap > 0, gap))
    interior = F.col("gap").isNotNull()
    is_short = F.col("gap") <= short
    longest = F.struct(F.col("gap").alias("len"), (F.col("gap") - F.col("idx")).alias("neg_start"))
    out = rows.groupBy(r.entity, r.period).agg(
        F.first(r.group).alias(r.group), F.first("n_groups").alias("n_groups"), F.first("n_events").alias("n_events"),
        F.count(F.lit(1)).alias("gp"), F.min("idx").alias("first_idx"), F.max("idx").alias("last_idx"),
        F.count("gap").alias("_inner_runs"), F.max(F.when(interior, longest)).alias("_block"),
        F.coalesce(F.sum(F.when(is_short, F.col("gap"))), F.lit(0)).cast("long").alias("iso_n"),
        F.count_if(F.coalesce(is_short, F.lit(False))).alias("iso_runs"),
        F.count_if(F.coalesce((F.col("gap") == 1) & F.col("prev_b2b"), F.lit(False))).alias("rest_n"))
    tail_gap = F.col("n_events") - 1 - F.col("last_idx")
    block_len = F.coalesce(F.col("_block.len"), F.lit(0))
    block_start = F.coalesce(-F.col("_block.neg_start"), F.lit(0))
    return out.select(
        r.entity, r.period, r.group, "n_groups", "n_events", "gp", (F.col("n_events") - F.col("gp")).alias("missed"), "first_idx",
        (F.col("n_events") - F.col("first_idx")).alias("tail_len"),
        (F.col("_inner_runs") + (F.col("first_idx") > 0).cast("long") + (tail_gap > 0).cast("long")).alias("n_runs"),
        F.greatest(block_len, F.col("first_idx"), tail_gap).alias("longest_run"),
        block_start.alias("block_start"), block_len.alias("block_len"),
        F.when(block_len > 0, F.col("n_events") - block_start - block_len).otherwise(F.lit(0)).alias("block_tail"),
        "iso_n", "iso_runs", "rest_n")


def true_runs(df: DataFrame, key: list[str], idx: str, flag: str) -> DataFrame:
    """(key, start, length) of each run of consecutive ``idx`` values whose flag is true."""
    w = Window.partitionBy(*key).orderBy(idx)
    on = df.where(F.col(flag)).withColumn("_island", F.col(idx) - F.row_number().over(w))
    return on.groupBy(*key, "_island").agg(F.min(idx).alias("start"), F.count(F.lit(1)).alias("length")).drop("_island")


def run_stats(df: DataFrame, key: list[str], idx: str, flag: str) -> DataFrame:
    """(key, longest, n_runs, n_true) over every key of ``df``; a key with no true row has zeros."""
    runs = true_runs(df, key, idx, flag).groupBy(*key).agg(
        F.max("length").alias("longest"), F.count(F.lit(1)).alias("n_runs"), F.sum("length").alias("n_true"))
    zero = {c: 0 for c in ("longest", "n_runs", "n_true")}
    return df.select(*key).distinct().join(runs, key, "left").na.fill(zero)


def trailing_run(df: DataFrame, key: list[str], order: str, flag: str) -> DataFrame:
    """(key, trailing): how many of the newest rows in a row have the flag set. Two partially aggregated maxima, no window."""
    return df.groupBy(*key).agg(
        F.max(F.when(~F.col(flag), F.col(order))).alias("_last_false"), F.count(F.lit(1)).alias("_n")).join(
        df.select(*key, order, flag), key).where(F.col(flag) & (F.col("_last_false").isNull() | (F.col(order) > F.col("_last_false")))
                                                 ).groupBy(*key).agg(F.count(F.lit(1)).alias("trailing"))


def share_since_first(presence: DataFrame, schedule: DataFrame, r: Roles = Roles()) -> DataFrame:
    """(entity, group, period): share of the group's events, from the entity's first one on, that it took part in."""
    mine = presence.groupBy(r.entity, r.group, r.period).agg(
        F.min(F.to_date(r.day)).alias("first_day"), F.countDistinct(r.event).alias("n_in"))
    sched = numbered_schedule(schedule, r).groupBy(r.group, r.period, F.col(r.day).alias("_day")).agg(F.count(F.lit(1)).alias("_n"))
    n = mine.join(sched, [r.group, r.period]).where(F.col("_day") >= F.col("first_day")).groupBy(r.entity, r.group, r.period).agg(
        F.first("n_in").alias("n_in"), F.sum("_n").alias("n_group"))
    return n.withColumn("share", F.least(F.lit(1.0), F.col("n_in") / F.col("n_group")))


def anchored_dedupe(df: DataFrame, key: list[str], day: str, prefer: str, row_id: str, *, window_days: int = 7) -> DataFrame:
    """Keep one of the reports of the same event: a row within ``window_days`` of the row kept last is dropped, unless it is
    preferred (lower ``prefer``), when it takes that row's place and becomes the new anchor.

    The window hangs on the row kept, so this is a fold in date order. Before folding, rows are reduced to the best of each
    (key, day), which bounds each fold by the calendar whatever the size of the group. Rows without a day are kept.
    """
    dated = df.where(F.col(day).isNotNull())
    daily = dated.groupBy(*key, F.col(day)).agg(F.min(F.struct(F.col(prefer), F.col(row_id))).alias("_best"))
    folded = daily.groupBy(*key).agg(F.sort_array(F.collect_list(F.struct(
        F.col(day).alias("day"), F.col("_best").getField(prefer).alias("prefer"), F.col("_best").getField(row_id).alias("id")))).alias("_days"))
    kinds = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    item = f"struct<day:{kinds[day]},prefer:{kinds[prefer]},id:{kinds[row_id]}>"

    def step(kept: Column, x: Column) -> Column:
        last = F.try_element_at(kept, F.lit(-1))
        near = last.isNotNull() & (F.datediff(x["day"], last["day"]) <= window_days)
        takes_over = near & (last["prefer"] > x["prefer"])
        return (F.when(takes_over, F.concat(F.slice(kept, F.lit(1), F.size(kept) - 1), F.array(x)))
                .when(near, kept).otherwise(F.concat(kept, F.array(x))))

    kept = folded.select(F.explode(F.aggregate("_days", F.array().cast(f"array<{item}>"), step)).alias("k")).select(F.col("k.id").alias(row_id))
    return df.join(kept, row_id, "left_semi").unionByName(df.where(F.col(day).isNull()))


def roll_yearless_days(df: DataFrame, section: list[str], order: str, day: str, source: str, cited: str, last_allowed: str, *,
                       gap_days: int = 120, slack_days: int = 30) -> DataFrame:
    """Move a day whose year was only inferred to the next year when it falls far behind the latest day above it in the same
    page section, unless its citation is older than that. A section is one table of one page, so it is bounded."""
    kind = df.schema[order].dataType.simpleString()
    items = df.groupBy(*section).agg(F.sort_array(F.collect_list(F.struct(
        F.col(order).alias("o"), F.col(day).cast("date").alias("d"), F.col(source).alias("src"), F.col(cited).cast("date").alias("cite"),
        F.col(last_allowed).cast("date").alias("cap")))).alias("_rows"))
    state = F.struct(F.lit(None).cast("date").alias("top"), F.array().cast(f"array<struct<o:{kind},d:date>>").alias("out"))

    def step(acc: Column, x: Column) -> Column:
        usable = x["d"].isNotNull() & x["src"].isin("cell", "cell_no_year")
        loose = x["src"] == "cell_no_year"
        behind = F.coalesce(F.datediff(acc["top"], x["d"]) > gap_days, F.lit(False))
        rolled = F.add_months(x["d"], 12)
        believable = (x["cite"].isNull() | (x["cite"] >= F.date_sub(rolled, slack_days))) & F.coalesce(rolled <= x["cap"], F.lit(True))
        now = F.when(usable & loose & behind & believable, rolled).otherwise(x["d"])
        contradicted = loose & ~behind & F.coalesce(x["cite"] < F.date_sub(x["d"], slack_days), F.lit(False))
        top = F.when(usable & ~contradicted, F.greatest(acc["top"], now)).otherwise(acc["top"])
        return F.struct(top.alias("top"), F.concat(acc["out"], F.array(F.struct(x["o"].alias("o"), now.alias("d")))).alias("out"))

    done = items.select(*section, F.explode(F.aggregate("_rows", state, step, lambda acc: acc["out"])).alias("_r"))
    done = done.select(*section, F.col("_r.o").alias(order), F.col("_r.d").alias("_rolled"))
    return df.join(done, section + [order], "left").withColumn(day, F.col("_rolled")).drop("_rolled")

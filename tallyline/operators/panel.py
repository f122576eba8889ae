"""Entity-period panels: totals, rates, lags that respect gaps, consecutive pairs and age."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window, functions as F

from tallyline.functions.periods import age_on_october_first, season_year_fast
from tallyline.functions.positions import position_group
from tallyline.functions.scoring import STAT_COLUMNS, weighted_score
from tallyline.operators.ranking import exact_quantiles

SUM_COLUMNS = ("min", "fgm", "fga", "fg3m", "fg3a", "ftm", "fta", "reb", "ast", "stl", "blk", "tov", "pts")


def period_lengths(team_games: DataFrame, *, group: str = "team_id", period: str = "s") -> DataFrame:
    """(period, season_len): median number of events over the groups of the period."""
    per_group = team_games.groupBy(period, group).agg(F.count(F.lit(1)).alias("_n"))
    return per_group.groupBy(period).agg(F.percentile("_n", F.lit(0.5)).alias("season_len"))


def target_period_length(lengths: DataFrame, *, period: str = "s", n_recent: int = 3) -> DataFrame:
    """(period, target_len): the longest of the ``n_recent`` completed periods before each period. One row per period."""
    w = Window.orderBy(period).rowsBetween(-n_recent, -1)
    return lengths.select(period, F.round(F.max("season_len").over(w)).cast("int").alias("target_len"))


def entity_period_panel(events: DataFrame, *, entity: str, period: str, score: str, sums: list[str], event: str | None = None) -> DataFrame:
    """Count, totals, score total, mean and sample deviation per (entity, period): one map-side combined aggregate."""
    return events.groupBy(entity, period).agg(
        F.count(F.lit(1)).alias("gp"), *[F.sum(F.col(c).cast("double")).alias(c) for c in sums],
        F.sum(score).alias("fp_sum"), F.avg(score).alias("fppg"), F.stddev_samp(score).alias("fp_sd"))


def attach_lags(rows: DataFrame, panel: DataFrame, *, entity: str, period: str, n_lags: int, columns: list[str]) -> DataFrame:
    """``<column>_lag<k>`` of the same entity k periods earlier; a period the entity missed stays null.

    The panel's rows of an entity become one map from period to values, and each row looks up its k earlier periods in it: one
    shuffle on the entity instead of k self-joins, and no row is copied. An entity has one row per period (of several, the greatest
    values count), so nothing here grows with the event table.
    """
    known = panel.where(F.col(entity).isNotNull() & F.col(period).isNotNull()).select(entity, period, *columns).repartition(F.col(entity))
    known = known.groupBy(entity, period).agg(*[F.max(c).alias(c) for c in columns])
    values = known.groupBy(entity).agg(F.map_from_entries(F.collect_list(F.struct(F.col(period), F.struct(*columns)))).alias("_periods"))
    kept = [entity, period, *[c for c in rows.columns if c not in (entity, period)]]
    found = rows.join(values, entity, "left").select(*kept, *[F.try_element_at("_periods", F.col(period) - k).alias(f"_back{k}") for k in range(1, n_lags + 1)])
    return found.select(*kept, *[F.col(f"_back{k}")[c].alias(f"{c}_lag{k}") for c in columns for k in range(1, n_lags + 1)])


def lags(column: str, n_lags: int) -> list[Column]:
    return [F.col(f"{column}_lag{k}") for k in range(1, n_lags + 1)]


def consecutive_pairs(panel: DataFrame, num: str, den: str, *, entity: str = "player_id", period: str = "s", age: str | None = "age") -> DataFrame:
    """(entity, period, age, delta, weight): change of num/den to the next period, weighted by the harmonic exposure."""
    base = panel.where(F.col(den) > 0).select(entity, period, *([age] if age else []), (F.col(num) / F.col(den)).alias("rate"), F.col(den).alias("expo"))
    later = base.select(F.col(entity), (F.col(period) - 1).alias(period), F.col("rate").alias("rate_next"), F.col("expo").alias("expo_next"))
    out = base.join(later, [entity, period])
    if age:
        out = out.where(F.col(age).isNotNull())
    return out.select(entity, period, *([age] if age else []), (F.col("rate_next") - F.col("rate")).alias("delta"),
                      (F.col("expo") * F.col("expo_next") / (F.col("expo") + F.col("expo_next"))).alias("weight"))


def ages_at(rows: DataFrame, players: DataFrame, bio: DataFrame, *, entity: str = "player_id", period: str = "s") -> DataFrame:
    """``age`` on 1 October of the period: from the birthdate, else the last known age rolled forward."""
    last = bio.groupBy(entity).agg(F.max_by(F.col("age_at_season_start") - season_year_fast(F.col("season")), season_year_fast(F.col("season"))).alias("_offset"))
    births = players.select(entity, "birthdate").dropDuplicates([entity])
    out = rows.join(births, entity, "left").join(last, entity, "left")
    return out.withColumn("age", F.coalesce(age_on_october_first(F.col("birthdate"), F.col(period)), F.col("_offset") + F.col(period))).drop("birthdate", "_offset")


def build_panel(game_logs: DataFrame, team_games: DataFrame, players: DataFrame, bio: DataFrame, scoring: Mapping[str, float]) -> DataFrame:
    """The projection panel: one row per (player_id, s)."""
    logs = game_logs.withColumn("s", season_year_fast(F.col("season")))
    logs = logs.withColumn("fp", weighted_score(logs, scoring, columns=STAT_COLUMNS))
    panel = entity_period_panel(logs, entity="player_id", period="s", score="fp", sums=list(SUM_COLUMNS))
    lengths = period_lengths(team_games.withColumn("s", season_year_fast(F.col("season"))))
    panel = panel.join(F.broadcast(lengths), "s", "left")            # one row per season
    panel = panel.withColumn("mpg", F.col("min") / F.col("gp")).withColumn("f", F.least(F.col("gp") / F.col("season_len"), F.lit(1.0)))
    panel = ages_at(panel, players, bio)
    groups = players.select("player_id", position_group(F.col("position")).alias("pos_group")).dropDuplicates(["player_id"])
    return panel.join(groups, "player_id", "left").na.fill({"pos_group": "U"})


def nearest_period_value(rows: DataFrame, known: DataFrame, *, entity: str, period: str, value: str, name: str) -> DataFrame:
    """``name``: the value of the same period, else of the nearest other period (earlier one of equals), else null."""
    offered = known.where(F.col(value).isNotNull()).select(F.col(entity), F.col(period).alias("_p"), F.col(value).alias("_v"))
    pairs = rows.select(entity, period).distinct().join(offered, entity)      # an entity has one row per period on each side
    best = pairs.groupBy(entity, period).agg(F.min_by("_v", F.struct(F.abs(F.col("_p") - F.col(period)), F.col("_p"))).alias(name))
    return rows.join(best, [entity, period], "left")


def last_group_of_period(events: DataFrame, *, entity: str, period: str, group: str, day: str, event: str) -> DataFrame:
    """(entity, period, group): group of the newest event."""
    return events.groupBy(entity, period).agg(F.max_by(group, F.struct(F.col(day), F.col(event))).alias(group))


def period_actuals(events: DataFrame, *, entity: str, period: str, group: str, day: str, event: str, score: str, minutes: str | None = None) -> DataFrame:
    """Totals, means, number of groups and newest group per (entity, period)."""
    extra = [F.sum(minutes).alias("minutes")] if minutes else []
    out = events.groupBy(entity, period).agg(
        F.count(F.lit(1)).alias("gp"), F.sum(score).alias("total_fp"), *extra, F.countDistinct(group).alias("n_groups"),
        F.max_by(group, F.struct(F.col(day), F.col(event))).alias("last_group"))
    return out.withColumn("fppg", F.col("total_fp") / F.col("gp"))


def split_by_date(events: DataFrame, day: str, as_of: str) -> tuple[DataFrame, DataFrame]:
    """Events up to and including a date, and those after it."""
    cut = F.lit(as_of).cast("date")
    return events.where(F.to_date(day) <= cut), events.where(F.to_date(day) > cut)


def median_event_date(schedule: DataFrame, *, group: str, period: str, day: str, event: str, nth: list[int]) -> DataFrame:
    """(period, nth, cutoff): median over groups of the day of each group's nth event."""
    numbered = schedule.select(group, period, event, F.to_date(day).alias("_d")).distinct().withColumn(
        "nth", F.row_number().over(Window.partitionBy(group, period).orderBy("_d", event)))
    picked = numbered.where(F.col("nth").isin(*nth))
    return picked.groupBy(period, "nth").agg(F.date_from_unix_date(F.floor(F.percentile(F.unix_date("_d"), F.lit(0.5))).cast("int")).alias("cutoff"))


def first_timers(events: DataFrame, *, entity: str, period: str) -> DataFrame:
    """(entity, period): the first period of each entity."""
    return events.groupBy(entity).agg(F.min(period).alias(period))


def veteran_flag(rows: DataFrame, events: DataFrame, *, entity: str = "player_id", period: str = "s", players: DataFrame | None = None) -> DataFrame:
    """``veteran``: an event, or a listed first year, before the row's period."""
    out = rows.join(events.groupBy(entity).agg(F.min(period).alias("_first")), entity, "left")
    if players is not None:
        out = out.join(players.select(entity, F.col("from_year").alias("_listed")).dropDuplicates([entity]), entity, "left")
    else:
        out = out.withColumn("_listed", F.lit(None).cast("int"))
    before = F.coalesce(F.col("_first") < F.col(period), F.lit(False)) | F.coalesce(F.col("_listed") < F.col(period), F.lit(False))
    return out.withColumn("veteran", before).drop("_first", "_listed")


def naive_last_period(events: DataFrame, *, entity: str, period: str, score: str, min_events: int = 10) -> DataFrame:
    """(entity, period + 1): last period's count, mean and 10/50/90 percent band; no band below ``min_events``."""
    means = events.groupBy(entity, period).agg(F.count(F.lit(1)).alias("proj_gp"), F.avg(score).alias("proj_fppg"))
    bands = exact_quantiles(events, [entity, period], score, {"fppg_p10": 0.1, "fppg_p50": 0.5, "fppg_p90": 0.9})
    out = means.join(bands, [entity, period], "left")
    enough = F.col("proj_gp") >= min_events
    return out.select(entity, (F.col(period) + 1).alias(period), "proj_gp", "proj_fppg", (F.col("proj_gp") * F.col("proj_fppg")).alias("proj_total_fp"),
                      *[F.when(enough, F.col(n)).alias(n) for n in ("fppg_p10", "fppg_p50", "fppg_p90")])

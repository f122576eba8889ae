"""Weeks and days: interval tables, assignment of events to weeks, dense group x week counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

DAYS_PER_WEEK = 7


def even_weeks(events: DataFrame, day: str, *, days: int = DAYS_PER_WEEK) -> DataFrame:
    """(week, start, end, n_days): equal pieces from the first to the last day, the last one cut short."""
    span = events.agg(F.min(F.to_date(day)).alias("lo"), F.max(F.to_date(day)).alias("hi"))
    starts = F.sequence("lo", "hi", F.expr(f"INTERVAL {days} DAYS"))
    return _sized(span.select("hi", F.posexplode(starts).alias("i", "start")).select(
        (F.col("i") + 1).alias("week"), "start", F.least(F.date_add("start", days - 1), F.col("hi")).alias("end")))


def _sized(weeks: DataFrame) -> DataFrame:
    return weeks.withColumn("n_days", F.datediff("end", "start") + 1)


def monday_weeks(daily: DataFrame, *, day: str = "d", n: str = "n", n_periods: int, regular_periods: int | None = None, low_share: float = 0.75) -> DataFrame:
    """Monday-to-Sunday weeks from the first day; the interior week with clearly the fewest events joins the week before it.

    ``daily`` has one row per calendar day, so the few weeks are worked out with small windows.
    """
    span = daily.agg(F.min(day).alias("lo"), F.max(day).alias("hi"))
    mondays = F.sequence(F.date_trunc("week", "lo").cast("date"), F.col("hi"), F.expr("INTERVAL 7 DAYS"))
    cal = span.select("lo", "hi", F.posexplode(mondays).alias("i", "m")).select(
        "i", F.greatest("m", "lo").alias("start"), F.least(F.date_add("m", 6), F.col("hi")).alias("end"))
    in_week = daily.select(F.floor(F.datediff(F.col(day), F.date_trunc("week", span.agg(F.min("lo")).scalar()).cast("date")) / 7).alias("i"), F.col(n).alias("_n"))
    total = in_week.groupBy("i").agg(F.sum("_n").alias("total"))
    cal = cal.join(total, "i", "left").na.fill({"total": 0})
    size = F.count(F.lit(1)).over(Window.partitionBy(F.lit(1)))
    interior = (F.col("i") >= F.greatest(F.floor(F.lit(0.45) * F.col("_k")), F.lit(1))) & (F.col("i") < F.least(F.floor(F.lit(0.85) * F.col("_k")), F.col("_k") - 1)) & (F.datediff("end", "start") == 6)
    cal = cal.withColumn("_k", size).withColumn("_in", interior)
    mid = cal.where("_in").agg(F.struct(F.percentile("total", F.lit(0.5)).alias("med"), F.min(F.struct("total", "i")).alias("low")).alias("m")).scalar()
    merged_at = F.when((F.col("_k") > n_periods) & (mid["low"]["total"] < low_share * mid["med"]), mid["low"]["i"])
    slot = F.when(F.col("i") >= F.coalesce(merged_at, F.lit(1 << 30)), F.col("i") - 1).otherwise(F.col("i"))
    weeks = cal.withColumn("_slot", slot).groupBy("_slot").agg(F.min("start").alias("start"), F.max("end").alias("end"))
    weeks = weeks.where(F.col("_slot") < n_periods).select((F.col("_slot") + 1).cast("int").alias("week"), "start", "end")
    return _sized(with_kind(weeks, regular_periods))


def with_kind(weeks: DataFrame, regular_periods: int | None) -> DataFrame:
    late = F.lit(False) if regular_periods is None else F.col("week") > regular_periods
    return weeks.withColumn("kind", F.when(late, "playoff").otherwise("regular"))


def weeks_from_periods(periods: DataFrame, day_one: str, *, regular_periods: int | None = None) -> DataFrame:
    """Weeks from (week, scoring_period) rows; scoring period 1 falls on ``day_one``."""
    first = F.lit(day_one).cast("date")
    weeks = periods.groupBy("week").agg(F.date_add(first, F.min("scoring_period") - 1).alias("start"), F.date_add(first, F.max("scoring_period") - 1).alias("end"))
    return _sized(with_kind(weeks, regular_periods))


def periods_look_real(periods: DataFrame, *, final_period: int | None = None, min_days: int = 100) -> bool:
    """False for a placeholder that lists too few scoring periods."""
    top, n = periods.agg(F.max("scoring_period"), F.count("scoring_period")).first()
    if not n:
        return False
    return bool(top >= final_period - 1) if final_period else bool(n >= min_days)


def week_days(weeks: DataFrame) -> DataFrame:
    """(day, week, ...): every calendar day of every week. A range join becomes an equi-join on the day."""
    return weeks.withColumn("day", F.explode(F.sequence("start", "end")))


def assign_weeks(events: DataFrame, weeks: DataFrame, day: str) -> DataFrame:
    """Events with the week that holds their day; the calendar (at most one row per day) is broadcast."""
    days = week_days(weeks)
    return events.withColumn("day", F.to_date(day)).join(F.broadcast(days), "day")


def week_of(weeks: DataFrame, day: Column) -> DataFrame:
    return weeks.where((F.col("start") <= day) & (F.col("end") >= day))


def current_week(weeks: DataFrame, as_of: str, *, offset: int = 0) -> DataFrame:
    """The week of a date (the first one before it all starts, none after it ends), or the one ``offset`` later."""
    d = F.lit(as_of).cast("date")
    now = weeks.where(F.col("end") >= d).agg(F.min(F.when((F.col("start") <= d) | (F.col("week") == 1), F.col("week")))).scalar()
    return weeks.where(F.col("week") == now + offset)


def weekly_counts(events: DataFrame, weeks: DataFrame, *, group: str, day: str, flags: dict[str, Column] | None = None, as_of: str | None = None) -> DataFrame:
    """Dense (week, group) grid with ``games``, ``games_left`` after ``as_of``, ``per7`` and one count per flag; zeros where nothing happened.

    Events are counted first; the grid of zeros comes from the distinct groups, each exploded over the few weeks.
    """
    placed = assign_weeks(events, weeks, day)
    left = F.lit(True) if as_of is None else F.to_date(day) > F.lit(as_of).cast("date")
    names = list(flags or {})
    counts = placed.groupBy("week", group).agg(F.count(F.lit(1)).alias("games"), F.count_if(left).alias("games_left"), *[F.count_if(c).alias(n) for n, c in (flags or {}).items()])
    all_weeks = weeks.agg(F.collect_list(F.struct(*weeks.columns))).scalar()             # calendar-sized
    grid = events.select(group).distinct().withColumn("_w", F.explode(all_weeks)).select(group, "_w.*")
    out = grid.join(counts, ["week", group], "left").na.fill(0, ["games", "games_left", *names])
    return out.withColumn("per7", F.col("games") * 7.0 / F.col("n_days"))


def week_flags(weekly: DataFrame, *, heavy: float = 3.75, light: float = 2.5) -> DataFrame:
    mean = weekly.groupBy("week").agg(F.avg("games").alias("week_mean"))
    return weekly.join(F.broadcast(mean), "week").withColumn("heavy", F.col("per7") >= heavy).withColumn("light", F.col("per7") <= light)   # one row per week


def expected_week_games(members: DataFrame, weekly: DataFrame, week: int, *, group: str, availability: Column | float = 1.0, remaining_only: bool = True) -> DataFrame:
    w = weekly.where(F.col("week") == week).select(group, F.col("games_left" if remaining_only else "games").alias("_g"))
    share = availability if isinstance(availability, Column) else F.lit(float(availability))
    return members.join(w, group, "left").withColumn("exp_games", F.coalesce("_g", F.lit(0)) * share).drop("_g")


def weeks_wide(weekly: DataFrame, weeks: list[int], *, group: str) -> DataFrame:
    """One row per group with the named weeks as columns and their total."""
    out = weekly.where(F.col("week").isin(*weeks)).groupBy(group).agg(*[F.coalesce(F.sum(F.when(F.col("week") == w, F.col("games"))), F.lit(0)).alias(f"wk{w}") for w in weeks])
    total = F.lit(0)
    for w in weeks:
        total = total + F.col(f"wk{w}")
    return out.withColumn("total", total)


def events_per_day(events: DataFrame, day: str, event: str) -> DataFrame:
    return events.groupBy(F.to_date(day).alias("d")).agg(F.countDistinct(event).alias("n"))


def small_day_limit(per_day: DataFrame, quantile: float = 0.35) -> DataFrame:
    """Largest day that still counts as a small one. One row per calendar day goes in."""
    return per_day.agg(F.coalesce(F.floor(F.percentile("n", F.lit(quantile))), F.lit(0)).alias("limit"))


def two_sided(schedule: DataFrame) -> DataFrame:
    """One row per (team, game) from home/away rows."""
    side = lambda a, b, home: F.struct(F.col(a).alias("team_id"), F.col(b).alias("opp_team_id"), F.lit(home).alias("is_home"))
    sides = F.array(side("home_team_id", "away_team_id", True), side("away_team_id", "home_team_id", False))
    return schedule.select("game_id", F.to_date("game_date").alias("game_date"), F.explode(sides).alias("s")).select("game_id", "game_date", "s.*")


def home_away(team_games: DataFrame) -> DataFrame:
    """Home/away rows from the two team rows of a game; other row counts are dropped. Without exactly one home flag the lower id is home."""
    side = F.struct(F.when(F.col("is_home"), 0).otherwise(1).alias("o"), F.col("team_id"), F.col("team_abbr"))
    g = team_games.groupBy("season", "game_id").agg(F.count(F.lit(1)).alias("_n"), F.count_if("is_home").alias("_h"), F.min("game_date").alias("game_date"),
                                                    F.min(side).alias("_first"), F.max(side).alias("_last"),
                                                    F.min(F.struct("team_id", "team_abbr")).alias("_low"), F.max(F.struct("team_id", "team_abbr")).alias("_high"))
    g = g.where((F.col("_n") == 2) & (F.col("_low.team_id") != F.col("_high.team_id")))
    one = F.col("_h") == 1
    pick = lambda flagged, plain, f: F.when(one, F.col(f"{flagged}.{f}")).otherwise(F.col(f"{plain}.{f}"))     # noqa: E731
    return g.select("season", "game_id", "game_date", pick("_first", "_low", "team_id").alias("home_team_id"), pick("_last", "_high", "team_id").alias("away_team_id"),
                    pick("_first", "_low", "team_abbr").alias("home_abbr"), pick("_last", "_high", "team_abbr").alias("away_abbr"))

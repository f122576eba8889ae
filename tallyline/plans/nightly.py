"""The nightly job as batch steps: merge the pulled window, rebuild the in-season tables, compare with the previous run."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from tallyline.functions.scoring import STAT_COLUMNS, usage_per_36, weighted_score
from tallyline.operators import diffs, inseason, merge, quality, trends
from tallyline.operators.panel import split_by_date
from tallyline.operators.ranking import asc, desc, top_k
from tallyline.operators.sequences import Roles, share_since_first

LOGS = Roles("player_id", "team_id", "season", "game_id", "game_date")


@dataclass
class LiveMerge:
    """Merged tables and what was held back."""

    game_logs: DataFrame
    team_games: DataFrame
    pending: DataFrame
    new_entities: DataFrame


def live_merge(stored: Mapping[str, DataFrame], pulled: Mapping[str, DataFrame], season: str, *, date_from: str, date_to: str | None = None) -> LiveMerge:
    """Replace the overlap window of the season with the fresh pull: games that are not final keep their stored copy, a table never
    shrinks without an error, ids never seen before are reported so that dimensions can be refreshed."""
    final, pending = merge.split_final(pulled["team_games"], pulled["team_games"].select("game_id", "team_id", F.col("pts_for").alias("pts")), pulled["game_logs"])
    day = F.to_date("game_date")
    window = (F.col("season") == season) & (day >= F.lit(date_from).cast("date"))
    if date_to is not None:
        window = window & (day <= F.lit(date_to).cast("date"))
    # a stored game that vanished from the pull is kept as well: only games seen as final are replaced
    vanished = stored["team_games"].where(window).select("game_id").distinct().join(final, "game_id", "left_anti")
    keep = pending.unionByName(vanished).distinct()
    out = {}
    for name in ("game_logs", "team_games"):
        fresh = pulled[name].join(final, "game_id", "left_semi")
        merged = merge.replace_window_keep(stored[name], fresh, in_window=window, key=["game_id"], keep=keep)
        out[name] = merge.guarded(stored[name], merged)
    known = stored["players"].select("player_id")
    return LiveMerge(out["game_logs"], out["team_games"], pending, pulled["game_logs"].select("player_id").distinct().join(known, "player_id", "left_anti"))


def alerts(game_logs: DataFrame, team_games: DataFrame, classes: DataFrame, scoring: Mapping[str, float], season: str, as_of: str, *, statuses: DataFrame | None = None) -> dict[str, DataFrame]:
    """Rising entities, current absences and who gains from them, as of a date."""
    logs, _ = split_by_date(game_logs.where(F.col("season") == season), "game_date", as_of)
    games, _ = split_by_date(team_games.where(F.col("season") == season), "game_date", as_of)
    logs = logs.withColumn("fp", weighted_score(logs, scoring, columns=STAT_COLUMNS)).withColumn("usg", usage_per_36(F.col("fga"), F.col("fta"), F.col("tov"), F.col("min")))
    absent = trends.absent_entities(logs, games, LOGS, statuses=statuses)
    rate = logs.groupBy("player_id").agg((F.sum("fp") / F.sum("min")).alias("fp_per_min"))
    return {"rising": trends.trend_signals(logs).where(F.col("rising_min") | F.col("rising_usg")), "absent": absent,
            "beneficiaries": trends.beneficiaries(logs, games, absent, classes, LOGS, score_per_minute=rate)}


def next_event_boost(game_logs: DataFrame, team_games: DataFrame, statuses: DataFrame, classes: DataFrame, form: DataFrame, *, as_of: str, taken: str, beta: float = 0.727, max_age: int = 3) -> DataFrame:
    """Score to add to a mate's next event while a regular is out; empty unless the status snapshot is fresh."""
    fresh = trends.snapshot_is_fresh(F.lit(taken).cast("date"), F.lit(as_of).cast("date"), days=max_age)
    listed = statuses.where(fresh)
    absent = trends.status_absences(game_logs, listed, LOGS)
    gains = trends.beneficiaries(game_logs, team_games, absent, classes, LOGS)
    shares = share_since_first(game_logs, team_games, LOGS).groupBy(F.col("player_id").alias("out_id")).agg(F.max("share").alias("share"))
    return trends.absence_adjustment(gains, shares, form, beta=beta)


def top_rows(ros: DataFrame, n: int, *, exclude: DataFrame | None = None) -> DataFrame:
    """First ``n`` rows by remaining value, rostered ones left out on request."""
    rows = ros if exclude is None else ros.join(exclude.select("player_id").distinct(), "player_id", "left_anti")
    return top_k(rows, [], [desc("ros_total_fp"), asc("player_id")], n, "place")


def ownership(rosters: DataFrame, mine: int) -> DataFrame:
    return rosters.select("player_id", F.when(F.col("team_id") == mine, "mine").otherwise("theirs").alias("owner"))


def run_diffs(prev: Mapping[str, DataFrame], cur: Mapping[str, DataFrame]) -> DataFrame:
    """Every state's change since the previous run as one (section, row) table; sections missing on either side are skipped."""
    both = lambda k: k in prev and k in cur       # noqa: E731
    parts: dict[str, DataFrame] = {}
    if both("roster"):
        parts["roster"] = diffs.membership_moves(prev["roster"], cur["roster"])
    if both("statuses"):
        parts["injuries"] = diffs.changed_values(prev["statuses"], cur["statuses"], ["source_id"], "injury_status")
    if both("adp"):
        parts["adp"] = diffs.rank_moves(prev["adp"], cur["adp"], entity="player_id", rank="adp", min_move=2.0, top=12)
    if both("watchlist"):
        parts["watchlist"] = diffs.list_changes(prev["watchlist"], cur["watchlist"], entity="player_id", rank="rank")
    if both("ros"):
        parts["ros"] = diffs.rank_moves(prev["ros"], cur["ros"], entity="player_id", rank="rank", min_move=8, top=10)
    for k in ("rising", "beneficiaries", "transactions"):
        if both(k):
            parts[k] = diffs.key_changes(prev[k], cur[k], ["id" if k == "transactions" else "player_id"])
    if both("games"):
        parts["games"] = diffs.count_delta(prev["games"], cur["games"], ["context"])
    if not parts:
        raise ValueError("no state is present in both runs")
    return diffs.union_report(parts)


def freshness(tables: Mapping[str, tuple[DataFrame, str, int]], today: str) -> DataFrame:
    return quality.freshness({n: (df, F.to_date(c), limit) for n, (df, c, limit) in tables.items()}, F.lit(today).cast("date"))


def rest_of_season_table(prior: DataFrame, game_logs: DataFrame, team_games: DataFrame, scoring: Mapping[str, float], season: str, as_of: str, *, season_games: float, params=inseason.RosParams()) -> DataFrame:
    """Rest-of-season rows as of a date from a preseason projection and the events up to that date."""
    logs, _ = split_by_date(game_logs.where(F.col("season") == season), "game_date", as_of)
    games, rest = split_by_date(team_games.where(F.col("season") == season), "game_date", as_of)
    logs = logs.withColumn("fp", weighted_score(logs, scoring, columns=STAT_COLUMNS))
    to_date = logs.groupBy("player_id").agg(F.count(F.lit(1)).alias("gp"), F.sum("min").alias("min"), F.sum("fp").alias("fp"), F.max_by("team_id", F.struct("game_date", "game_id")).alias("team_id"))
    played = games.groupBy("team_id").agg(F.count(F.lit(1)).alias("n_events"))
    teams = team_games.where(F.col("season") == season).select("team_id").distinct()
    left = teams.join(rest.groupBy("team_id").agg(F.count(F.lit(1)).alias("events_left")), "team_id", "left").na.fill({"events_left": 0})
    return inseason.rest_of_season(prior, to_date, played, season_games=season_games, params=params, left=left)

"""Feature layers a projector may add: each takes the history and rows keyed on (player_id, s) and returns them with ``x_`` columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, functions as F

from tallyline.functions.periods import season_year_fast
from tallyline.functions.positions import position_group
from tallyline.functions.rules import INJURY_KINDS, OTHER_KINDS, REST_KINDS, classify_reason
from tallyline.functions.scoring import recency_weighted
from tallyline.operators import rosters
from tallyline.operators.fit import wls
from tallyline.operators.panel import ages_at, attach_lags, lags, period_lengths, veteran_flag
from tallyline.operators.sequences import Roles, absence_profile, primary_group, run_stats
from tallyline.operators.views import History, assert_no_future, before_period

KEY = Roles("player_id", "team_id", "s", "game_id", "game_date")
LONG_ABSENCE, LEAD_MIN, FLAG_BLOCK, FLAG_TAIL, FLAG_HEALTH, NEUTRAL_HEALTH, HEALTH_K = 0.15, 0.10, 0.25, 15, 0.75, 0.75, 10.0
MIN_COVERAGE = 0.4


def _with_year(df: DataFrame) -> DataFrame:
    return df if "s" in df.columns else df.withColumn("s", season_year_fast(F.col("season")))


def history_profile(history: History) -> DataFrame:
    """Absence profile of every (player_id, s) of the history."""
    logs, games = _with_year(history["game_logs"]), _with_year(history["team_games"])
    return absence_profile(logs.select("player_id", "team_id", "s", "game_id"), games, KEY)


def _zero(c: Column, default: float = 0.0) -> Column:
    return F.coalesce(c, F.lit(default))


def absence_features(n_lags: int = 4, decay: float = 0.6, *, min_rows: int = 60) -> Callable[[History, DataFrame], DataFrame]:
    """Longest run, number of runs, a long absence last period, and absence beyond what age explains."""
    def build(history: History, rows: DataFrame) -> DataFrame:
        p = history_profile(history).select("player_id", "s", (F.col("longest_run") / F.col("n_events")).alias("streak"), F.col("n_runs").cast("double").alias("freq"),
                                            (F.col("missed") / F.col("n_events")).alias("missed_frac"), "n_events")
        aged = ages_at(p, history["players"], history["player_season_bio"]).select(F.col("missed_frac"), F.col("age"), (F.col("age") * F.col("age")).alias("age2"), "n_events").where(F.col("age").isNotNull())
        enough = aged.limit(min_rows).count() >= min_rows
        mean = p.agg(F.avg("missed_frac")).first()[0] or 0.15
        curve = [float(v) for v in wls(aged, ["age", "age2"], "missed_frac", "n_events", ridge=0.0)] if enough else [float(mean), 0.0, 0.0]
        wide = attach_lags(rows.select("player_id", "s"), p, entity="player_id", period="s", n_lags=n_lags, columns=["streak", "freq", "missed_frac"])
        expected = F.lit(curve[0]) + F.lit(curve[1]) * F.col("age") + F.lit(curve[2]) * F.col("age") * F.col("age")
        out = rows.join(wide, ["player_id", "s"], "left")
        return out.select(*rows.columns, recency_weighted(lags("streak", n_lags), decay).alias("x_streak"), recency_weighted(lags("freq", n_lags), decay).alias("x_freq"),
                          (_zero(F.col("streak_lag1")) >= LONG_ABSENCE).cast("double").alias("x_long"), (recency_weighted(lags("missed_frac", n_lags), decay) - expected).alias("x_age_resid"))
    return build


def return_features(n_lags: int = 4, decay: float = 0.6) -> Callable[[History, DataFrame], DataFrame]:
    """Lead-block share and health after it, decayed over lags, and the same for last period alone."""
    def build(history: History, rows: DataFrame) -> DataFrame:
        p = veteran_flag(history_profile(history), _with_year(history["game_logs"]), players=history["players"])
        usable = F.col("veteran") & (F.col("n_groups") == 1) & (F.col("n_events") > 0)
        lead = F.when(usable, F.col("first_idx") / F.col("n_events")).otherwise(0.0)
        health = (F.col("gp") + HEALTH_K * NEUTRAL_HEALTH) / (F.col("tail_len") + HEALTH_K)
        raw = F.when(F.col("tail_len") > 0, F.col("gp") / F.col("tail_len")).otherwise(0.0)
        flag = usable & (lead >= FLAG_BLOCK) & (F.col("tail_len") >= FLAG_TAIL) & (raw >= FLAG_HEALTH)
        p = p.select("player_id", "s", lead.alias("lead"), health.alias("health"), (usable & (lead >= LEAD_MIN)).cast("double").alias("is_lead"),
                     F.when(usable, F.col("tail_len") / F.col("n_events")).otherwise(0.0).alias("tail"), flag.cast("double").alias("flag"))
        wide = attach_lags(rows.select("player_id", "s"), p, entity="player_id", period="s", n_lags=n_lags, columns=["lead", "health", "is_lead", "tail", "flag"])
        out = rows.join(wide, ["player_id", "s"], "left")
        among = [F.when(F.col(f"is_lead_lag{k}") > 0, F.col(f"health_lag{k}")) for k in range(1, n_lags + 1)]
        tails = [F.col(f"is_lead_lag{k}") * F.col(f"tail_lag{k}") for k in range(1, n_lags + 1)]
        return out.select(*rows.columns, _zero(recency_weighted(lags("lead", n_lags), decay)).alias("x_lead"), _zero(recency_weighted(among, decay), NEUTRAL_HEALTH).alias("x_health"),
                          _zero(recency_weighted(tails, decay)).alias("x_tail"), _zero(recency_weighted(lags("flag", n_lags), decay)).alias("x_flag"), _zero(F.col("lead_lag1")).alias("x_lead1"),
                          F.when(F.col("is_lead_lag1") > 0, F.col("health_lag1")).otherwise(NEUTRAL_HEALTH).alias("x_health1"), _zero(F.col("flag_lag1")).alias("x_flag1"))
    return build


def label_panel(reports: DataFrame, team_games: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(panel, coverage): shares of covered group dates an entity was out, by kind, and the covered share of each season.

    A report row is one (entity, date); dates are matched to the covered schedule of the entity's most frequent group.
    """
    games = _with_year(team_games).select("s", "team_abbr", F.to_date("game_date").alias("d")).distinct()
    seen = reports.select(F.to_date("game_date").alias("d")).distinct().withColumn("_seen", F.lit(True))
    marked = games.join(seen, "d", "left").na.fill({"_seen": False})
    coverage = marked.groupBy("s").agg(F.avg(F.col("_seen").cast("double")).alias("share"))
    out = _with_year(reports).where(F.col("player_id").isNotNull() & (F.col("status") == "Out")).select("player_id", "s", "team_abbr", F.to_date("game_date").alias("d"),
                                                                                                       classify_reason(F.col("category"), F.col("detail"))["kind"].alias("kind"))
    n = out.groupBy("player_id", "s", "team_abbr").agg(F.count(F.lit(1)).alias("n"))
    home = n.groupBy("player_id", "s").agg(F.min_by("team_abbr", F.struct(-F.col("n"), F.col("team_abbr"))).alias("team_abbr"))
    first = out.groupBy("player_id", "s", "d").agg(F.min("kind").alias("kind"))
    grid = home.join(marked.where("_seen").select("s", "team_abbr", "d"), ["s", "team_abbr"]).join(first, ["player_id", "s", "d"], "left")
    grid = grid.withColumn("i", F.row_number().over(Window.partitionBy("player_id", "s").orderBy("d"))).withColumn("hurt", F.coalesce(F.col("kind").isin(*INJURY_KINDS), F.lit(False)))
    share = lambda kinds: F.avg(F.coalesce(F.col("kind").isin(*kinds), F.lit(False)).cast("double"))     # noqa: E731
    sums = grid.groupBy("player_id", "s").agg(share(INJURY_KINDS).alias("inj_out"), share(REST_KINDS).alias("rest_out"), share(OTHER_KINDS).alias("other_out"), F.count(F.lit(1)).alias("n"))
    runs = run_stats(grid, ["player_id", "s"], "i", "hurt")
    panel = sums.join(runs, ["player_id", "s"]).select("player_id", "s", "inj_out", "rest_out", "other_out", (F.col("longest") / F.col("n")).alias("longest"), F.col("n_runs").cast("double").alias("n_spells"))
    return panel, coverage


def label_features(reports: DataFrame, n_lags: int = 4, decay: float = 0.6) -> Callable[[History, DataFrame], DataFrame]:
    """Labelled absence shares; a covered season without a row means zero, an uncovered one stays unknown."""
    cols = ["inj_out", "rest_out", "other_out", "longest", "n_spells"]

    def build(history: History, rows: DataFrame) -> DataFrame:
        known = before_period(reports, history.target)
        assert_no_future(known, history.target, "reports")
        panel, coverage = label_panel(known, history["team_games"])
        covered = [int(r["s"]) for r in coverage.where(F.col("share") >= MIN_COVERAGE).collect()]                 # one row per season
        wide = attach_lags(rows.select("player_id", "s"), panel, entity="player_id", period="s", n_lags=n_lags, columns=cols)
        out = rows.join(wide, ["player_id", "s"], "left")
        is_cov = [(F.col("s") - k).isin(*covered) if covered else F.lit(False) for k in range(1, n_lags + 1)]
        value = lambda c: [F.when(is_cov[k - 1], _zero(F.col(f"{c}_lag{k}"))) for k in range(1, n_lags + 1)]       # noqa: E731
        any_cov = is_cov[0]
        for c in is_cov[1:]:
            any_cov = any_cov | c
        return out.select(*rows.columns, any_cov.cast("double").alias("x_covered"), *[_zero(recency_weighted(value(c), decay)).alias("x_" + c) for c in cols])
    return build


def roster_features(n_lags: int = 1) -> Callable[[History, DataFrame], DataFrame]:
    """Last period's pace, role share and crowding."""
    def build(history: History, rows: DataFrame) -> DataFrame:
        groups = history["players"].select("player_id", position_group(F.col("position")).alias("pos_group"))
        p = rosters.roster_panel(_with_year(history["game_logs"]), groups, KEY).select("player_id", "s", "pace", "role_share", F.col("pos_crowding").cast("double").alias("crowd"))
        wide = attach_lags(rows.select("player_id", "s"), p, entity="player_id", period="s", n_lags=n_lags, columns=["pace", "role_share", "crowd"])
        mean = p.agg(F.avg("pace")).scalar()
        out = rows.join(wide, ["player_id", "s"], "left")
        return out.select(*rows.columns, _zero((F.col("pace_lag1") - mean) / 10).alias("x_pace"), _zero(F.col("role_share_lag1")).alias("x_role"), _zero(F.col("crowd_lag1")).alias("x_crowd"))
    return build


def transaction_features(transactions: DataFrame) -> Callable[[History, DataFrame], DataFrame]:
    def build(history: History, rows: DataFrame) -> DataFrame:
        groups = history["players"].select("player_id", position_group(F.col("position")).alias("pos_group"))
        shares = rosters.roster_panel(_with_year(history["game_logs"]), groups, KEY).select("player_id", "s", "team_id", "role_share")
        known = _with_year(transactions).where(F.col("s") <= history.target)
        out = rosters.transaction_features(rows, shares, known, KEY)
        return out.withColumnRenamed("changed_team", "x_changed").withColumnRenamed("team_departures_lost", "x_lost")
    return build


def prior_minutes(history: History) -> DataFrame:
    """(player_id, s, team_id, mpg): minutes per group event, with the primary group."""
    logs = _with_year(history["game_logs"])
    lengths = period_lengths(_with_year(history["team_games"]))
    tot = logs.groupBy("player_id", "s").agg(F.sum("min").alias("m")).join(F.broadcast(lengths), "s").select("player_id", "s", (F.col("m") / F.col("season_len")).alias("mpg"))   # one row per season
    return tot.join(primary_group(logs.select("player_id", "team_id", "s", "game_id").distinct(), KEY), ["player_id", "s"]).drop("n_groups")


def depth_features(transactions: DataFrame, playoffs: DataFrame) -> Callable[[History, DataFrame], DataFrame]:
    def build(history: History, rows: DataFrame) -> DataFrame:
        closing = _with_year(before_period(playoffs, history.target))
        uplift = rosters.closing_uplift(closing, _with_year(history["game_logs"]), KEY)
        known = _with_year(transactions).where(F.col("s") <= history.target)
        out = rosters.depth_features(rows, prior_minutes(history), known, uplift, KEY)
        return out.withColumnRenamed("open_net", "x_open").withColumnRenamed("po_uplift", "x_uplift")
    return build


def coach_features(leaders: DataFrame, *, high: float = 24.0) -> Callable[[History, DataFrame], DataFrame]:
    """Expected change of style where the leader is new, split by how big the member's role was."""
    def build(history: History, rows: DataFrame) -> DataFrame:
        table = _with_year(leaders).where(F.col("s") <= history.target)
        opening, closing = rosters.opening_leaders(table), rosters.closing_leaders(table)
        style = rosters.group_style(_with_year(history["game_logs"]), KEY)
        shift = rosters.leader_shift(opening, closing, style, ["star", "top5", "depth10"])
        last = prior_minutes(history).select("player_id", (F.col("s") + 1).alias("s"), "team_id", "mpg")
        j = rows.join(last.withColumnRenamed("mpg", "_mpg"), ["player_id", "s"], "left").join(shift, ["team_id", "s"], "left")
        big = F.coalesce(F.col("_mpg") >= high, F.lit(False))
        on = lambda c, cond: F.when(cond, _zero(F.col(c))).otherwise(0.0)          # noqa: E731
        return j.select(*rows.columns, on("shift_top5_x", big).alias("x_top5_high"), on("shift_top5_x", ~big).alias("x_top5_low"), on("shift_star_x", big).alias("x_star_high"),
                        on("shift_depth10_x", ~big).alias("x_depth_low"), F.coalesce(F.col("is_new").cast("double"), F.lit(0.0)).alias("x_new_leader"))
    return build


def adp_features(adp: DataFrame, *, center: float = 4.0) -> Callable[[History, DataFrame], DataFrame]:
    """Whether the period is covered by a market ranking, whether the entity is listed, and its centred log pick."""
    def build(history: History, rows: DataFrame) -> DataFrame:
        known = _with_year(adp).where(F.col("s") <= history.target).groupBy("player_id", "s").agg(F.min("adp").alias("_adp"))
        covered = known.select("s").distinct().withColumn("_cov", F.lit(1.0))
        j = rows.join(known, ["player_id", "s"], "left").join(F.broadcast(covered), "s", "left")                # one row per season
        return j.select(*rows.columns, _zero(F.col("_cov")).alias("x_adp_covered"), F.col("_adp").isNotNull().cast("double").alias("x_adp_listed"), _zero(F.log("_adp") - center).alias("x_adp_log"))
    return build

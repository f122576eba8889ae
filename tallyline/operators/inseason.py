"""Within a period: posterior blends, remaining value, rosters, additions and swaps for many groups at once."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from tallyline.functions.flags import confidence_bucket
from tallyline.functions.scoring import clip, posterior_mean
from tallyline.operators.ranking import asc, desc, top_k, with_row_number
from tallyline.operators.value import LeagueShape, availability_of_top, bench_weight, compute_vorp, group_value


def blend(prior_rows: DataFrame, to_date: DataFrame, key: list[str], *, prior: str, sample: str, n: str, pseudo: float, weak_prior: float, name: str) -> DataFrame:
    """``name``: (pseudo * prior + n * sample) / (pseudo + n) over everyone with a prior or a sample, and the sample's weight."""
    j = prior_rows.join(to_date, key, "full").na.fill({n: 0})
    base = F.coalesce(F.col(prior), F.lit(weak_prior))
    seen = F.coalesce(F.col(sample), base)
    return (j.withColumn(name, posterior_mean(base, seen, F.col(n), pseudo)).withColumn("w_sample", F.col(n) / (F.lit(pseudo) + F.col(n))))


@dataclass(frozen=True)
class RosParams:
    """Pseudo-counts behind the priors, and the prior of an entity without one."""

    minutes_pseudo: float = 300.0
    games_pseudo: float = 3.0
    avail_pseudo: float = 5.0
    fppg_pseudo: float = 5.0
    mode: str = "blend"
    weak_fppm: float = 0.45
    weak_mpg: float = 12.0
    weak_avail: float = 0.55


MODES = ("blend", "blend_fppg", "prior", "sample")


def rest_of_season(prior: DataFrame, to_date: DataFrame, group_events: DataFrame, *, season_games: float, params: RosParams = RosParams(), left: DataFrame | None = None,
                   teams: DataFrame | None = None, entity: str = "player_id", group: str = "team_id") -> DataFrame:
    """Posterior rate, minutes and availability of everyone with a projection or an event, times the events left.

    ``prior``: proj_mpg, proj_fppg, proj_gp. ``to_date``: gp, min, fp, group. ``group_events``: (group, n_events) played so far.
    ``left``: (group, events_left); without it what is missing from ``season_games``. ``teams``: group of entities yet to appear.
    """
    if params.mode not in MODES:
        raise ValueError(f"mode must be one of {MODES}")
    p = prior.select(entity, "proj_mpg", "proj_fppg", "proj_gp", F.lit(True).alias("has_prior"))
    df = p.join(to_date.select(entity, F.col("gp").cast("double").alias("gp"), F.col("min").alias("minutes"), "fp", group), entity, "full")
    df = df.na.fill({"has_prior": False, "gp": 0.0, "minutes": 0.0, "fp": 0.0})
    if teams is not None:
        df = df.join(teams.select(entity, F.col(group).alias("_placed")).dropDuplicates([entity]), entity, "left").withColumn(group, F.coalesce(group, "_placed")).drop("_placed")
    df = df.join(group_events.select(group, F.col("n_events").cast("double").alias("_tgp")), group, "left")
    most = group_events.agg(F.max("n_events").cast("double")).scalar()
    if left is not None:
        df = df.join(left.select(group, F.col("events_left").cast("double").alias("_left")), group, "left")
    else:
        df = df.withColumn("_left", F.greatest(F.lit(season_games) - F.col("_tgp"), F.lit(0.0)))
    has = F.col("has_prior")
    prior_mpg = F.when(has, F.col("proj_mpg")).otherwise(params.weak_mpg)
    ratio = F.when(F.col("proj_mpg") > 0, F.col("proj_fppg") / F.col("proj_mpg"))
    prior_fppm = F.coalesce(F.when(has, ratio), F.lit(params.weak_fppm))
    prior_fppg = F.when(has, F.col("proj_fppg")).otherwise(prior_fppm * prior_mpg)
    prior_avail = F.when(has, clip(F.col("proj_gp") / season_games, 0.0, 1.0)).otherwise(params.weak_avail)
    df = df.withColumn("prior_mpg", prior_mpg).withColumn("_pfppm", prior_fppm).withColumn("prior_fppg", prior_fppg).withColumn("prior_avail", prior_avail)
    df = df.withColumn("_tgp", F.coalesce(F.col("_tgp"), most, F.lit(0.0)))
    df = df.withColumn("mpg", F.when(F.col("gp") > 0, F.col("minutes") / F.col("gp"))).withColumn("fppg_to_date", F.when(F.col("gp") > 0, F.col("fp") / F.col("gp")))
    df = df.withColumn("_fppm", F.when(F.col("minutes") > 0, F.col("fp") / F.col("minutes")))
    df = df.withColumn("_avail", F.when(F.col("_tgp") > 0, F.least(F.col("gp") / F.greatest(F.col("_tgp"), F.lit(1.0)), F.lit(1.0))))
    c = F.col
    if params.mode == "prior":
        fppg, mpg, avail = c("prior_fppg"), c("prior_mpg"), c("prior_avail")
    elif params.mode == "sample":
        fppg, mpg, avail = F.coalesce("fppg_to_date", "prior_fppg"), F.coalesce("mpg", "prior_mpg"), F.coalesce("_avail", "prior_avail")
    else:
        mpg = posterior_mean(c("prior_mpg"), F.coalesce("mpg", "prior_mpg"), c("gp"), params.games_pseudo)
        avail = posterior_mean(c("prior_avail"), F.coalesce("_avail", "prior_avail"), c("_tgp"), params.avail_pseudo)
        rate = posterior_mean(c("_pfppm"), F.coalesce("_fppm", "_pfppm"), c("minutes"), params.minutes_pseudo)
        fppg = rate * mpg if params.mode == "blend" else posterior_mean(c("prior_fppg"), F.coalesce("fppg_to_date", "prior_fppg"), c("gp"), params.fppg_pseudo)
    df = df.withColumn("ros_mpg", mpg).withColumn("avail", clip(avail, 0.0, 1.0)).withColumn("ros_fppg", fppg)
    typical = df.agg(F.percentile("_left", F.lit(0.5))).scalar()
    df = df.withColumn("team_games_left", F.coalesce(c("_left"), typical, F.lit(season_games)))
    df = df.withColumn("ros_games", c("avail") * c("team_games_left")).withColumn("ros_total_fp", c("ros_fppg") * c("ros_games"))
    df = df.withColumn("w_sample", F.when(c("minutes") > 0, c("minutes") / (F.lit(params.minutes_pseudo) + c("minutes"))).otherwise(0.0))
    return df.drop("_tgp", "_left", "_pfppm", "_fppm", "_avail", "proj_mpg", "proj_fppg", "proj_gp")


def add_remaining_value(ros: DataFrame, shape: LeagueShape, *, games_left: float, entity: str = "player_id") -> DataFrame:
    """Value over replacement on the remainder, ranked."""
    proj = ros.withColumn("proj_fppg", F.col("ros_fppg")).withColumn("proj_gp", F.col("ros_games")).withColumn("proj_total_fp", F.col("ros_total_fp"))
    if entity != "player_id":
        proj = proj.withColumn("player_id", F.col(entity))
    valued = compute_vorp(proj, shape, season_games=max(games_left, 1.0), positional="auto" if "position" in ros.columns else "off")
    valued = valued.withColumnRenamed("vorp", "ros_vorp").drop("vorp_per_game", "proj_fppg", "proj_gp", "proj_total_fp")
    return with_row_number(valued, [], [desc("ros_vorp"), desc("ros_total_fp"), asc(entity)], "ros_rank")


def roster_bench_weight(ros: DataFrame, shape: LeagueShape, *, entity: str = "player_id") -> float:
    top = availability_of_top(ros, total="ros_total_fp", games="avail", n=shape.teams * shape.starters, season_games=1.0, tie=entity).first()
    return bench_weight(shape, float(top[0]) if top and top[0] is not None else 1.0)


def fit_to_capacity(members: DataFrame, group: list[str], *, entity: str, value: str, capacity: int, filler_value: float) -> tuple[DataFrame, DataFrame]:
    """(members kept, (group, n_fillers)): the most valuable ``capacity`` rows of each group; free places count as fillers at
    replacement value. The ranked cut replaces one-by-one removal by marginal value."""
    kept = top_k(members, group, [desc(value), asc(entity)], capacity, "_rk").drop("_rk")
    free = kept.groupBy(*group).agg((F.lit(capacity) - F.count(F.lit(1))).alias("n_fillers")).withColumn("filler_value", F.col("n_fillers") * F.lit(filler_value))
    return kept, free


def roster_rows(ros: DataFrame, members: DataFrame, *, entity: str = "player_id") -> DataFrame:
    """Members with their projection; an id without one is an error."""
    if members.join(ros.select(entity), entity, "left_anti").limit(1).count():
        raise KeyError("members without a projection")
    return members.join(ros, entity)


def swap_values(rosters: DataFrame, proposals: DataFrame, *, entity: str, value: str, eligible: str, slots: list[tuple[str, int]], bench: int, weight: float,
                tolerance: float = 0.015) -> DataFrame:
    """Value of each group's roster before and after each proposed swap, all proposals at once.

    ``proposals``: (proposal, grp, gives array, gets array); ``rosters``: (grp, entity, value, eligible).
    """
    base = proposals.join(rosters, "grp")
    before = base.select("proposal", entity, value, eligible, F.lit("before").alias("side"))
    kept = base.where(~F.array_contains("gives", F.col(entity))).select("proposal", entity, value, eligible)
    wanted = proposals.select("proposal", F.explode("gets").alias(entity)).join(rosters.select(entity, value, eligible).dropDuplicates([entity]), entity)
    after = kept.unionByName(wanted.select("proposal", entity, value, eligible)).withColumn("side", F.lit("after"))
    v = group_value(before.unionByName(after), ["proposal", "side"], entity=entity, value=value, eligible=eligible, slots=slots, bench=bench, weight=weight)
    wide = v.groupBy("proposal").agg(F.max(F.when(F.col("side") == "before", F.col("lineup_value"))).alias("value_before"),
                                     F.max(F.when(F.col("side") == "after", F.col("lineup_value"))).alias("value_after"))
    wide = wide.withColumn("delta", F.col("value_after") - F.col("value_before"))
    tol = F.lit(tolerance) * F.col("value_before")
    verdict = F.when(F.abs("delta") <= tol, "roughly even").when(F.col("delta") > 0, "favours you").otherwise("favours the other side")
    return wide.withColumn("verdict", verdict).withColumn("bucket", confidence_bucket(F.col("delta"), tol))


def best_additions(rosters: DataFrame, free: DataFrame, *, entity: str, value: str, eligible: str, slots: list[tuple[str, int]], bench: int, weight: float,
                   candidates: int = 60, top: int = 25) -> DataFrame:
    """(grp, add_id, drop_id, gain): best replacement of one member by one free row, for every group.

    Free rows are first cut to the best ``candidates`` per slot class, which is the report's size; each (group, candidate, drop)
    variant is a roster valued by the batch fill.
    """
    pool = free.select(entity, value, eligible, F.explode(eligible).alias("_cls"))
    pool = top_k(pool, ["_cls"], [desc(value), asc(entity)], candidates, "_rk").select(entity, value, eligible).dropDuplicates([entity])
    listed = pool.agg(F.collect_list(F.struct(F.col(entity).alias("add_id"), F.col(value).alias("add_value"), F.col(eligible).alias("add_elig")))).scalar()
    drops = rosters.select("grp", F.col(entity).alias("drop_id")).withColumn("_a", F.explode(listed)).select("grp", "drop_id", "_a.*")
    variant = drops.select("grp", "drop_id", "add_id")
    kept = variant.join(rosters, "grp").where(F.col(entity) != F.col("drop_id")).select("grp", "drop_id", "add_id", entity, value, eligible)
    added = drops.select("grp", "drop_id", "add_id", F.col("add_id").alias(entity), F.col("add_value").alias(value), F.col("add_elig").alias(eligible))
    now = group_value(rosters, ["grp"], entity=entity, value=value, eligible=eligible, slots=slots, bench=bench, weight=weight).withColumnRenamed("lineup_value", "_base")
    new = group_value(kept.unionByName(added), ["grp", "drop_id", "add_id"], entity=entity, value=value, eligible=eligible, slots=slots, bench=bench, weight=weight)
    gains = new.join(now, "grp").withColumn("gain", F.col("lineup_value") - F.col("_base"))
    best = gains.groupBy("grp", "add_id").agg(F.max_by(F.struct("drop_id", "gain"), F.struct("gain", -F.col("drop_id"))).alias("b")).select("grp", "add_id", "b.*")
    return top_k(best, ["grp"], [desc("gain"), asc("add_id")], top, "place")


def late_weeks_value(board: DataFrame, team_of: DataFrame, late_events: DataFrame, *, season_games: float, entity: str = "player_id", group: str = "team_id") -> DataFrame:
    """``playoff_fp``: group events in the late weeks times availability times rate."""
    b = board.select(entity, "proj_gp", "proj_fppg").join(team_of.select(entity, group), entity, "left").join(late_events.select(group, F.col("games").cast("double").alias("playoff_games")), group, "left")
    avail = clip(F.col("proj_gp") / season_games, 0.0, 1.0)
    return b.select(entity, group, "playoff_games", avail.alias("playoff_avail"), (F.col("proj_fppg") * F.col("playoff_games") * avail).alias("playoff_fp"))


def current_groups(last: DataFrame, snapshot: DataFrame | None, *, entity: str = "player_id", group: str = "team_id") -> DataFrame:
    """Group from the newest snapshot, else the one of last period."""
    if snapshot is None:
        return last.select(entity, group)
    j = last.select(entity, F.col(group).alias("_last")).join(snapshot.select(entity, F.col(group).alias("_now")).dropDuplicates([entity]), entity, "full")
    return j.select(entity, F.coalesce("_now", "_last").alias(group))


def active_universe(events: DataFrame, snapshot: DataFrame, projected: DataFrame, everyone: DataFrame, *, entity: str = "player_id") -> DataFrame:
    """Entities with an event this period, plus projected ones on the newest snapshot; everyone when that is empty."""
    seen = events.select(entity).union(snapshot.select(entity).join(projected.select(entity), entity, "left_semi")).distinct()
    return seen if seen.limit(1).count() else everyone.select(entity).distinct()


def free_entities(active: DataFrame, rostered: DataFrame, *, entity: str = "player_id") -> DataFrame:
    return active.select(entity).distinct().join(rostered.select(entity).distinct(), entity, "left_anti")


def member_week(members: DataFrame, weekly: DataFrame, week: int, *, group: str = "team_id", statuses: DataFrame | None = None, entity: str = "player_id") -> DataFrame:
    """Per member: events and expected score of the week, with a hint."""
    w = weekly.where(F.col("week") == week).select(group, F.col("games_left").alias("week_games"), F.col("b2b").alias("week_b2b"))
    out = members.join(w, group, "left").na.fill({"week_games": 0, "week_b2b": 0})
    if statuses is not None:
        out = out.join(statuses.select(entity, "status").dropDuplicates([entity]), entity, "left")
    else:
        out = out.withColumn("status", F.lit(None).cast("string"))
    exp = F.col("week_games") * F.coalesce("avail", F.lit(1.0))
    hint = F.when(F.upper("status") == "OUT", "out").when(F.col("week_games") == 0, "no games").when(F.col("week_games") >= 4, "four games").otherwise("")
    return out.withColumn("week_exp_games", exp).withColumn("week_exp_fp", exp * F.col("ros_fppg")).withColumn("hint", hint)


def score_blends(rows: DataFrame, arms: dict[str, Column], actual: str, group: list[str]) -> DataFrame:
    """(group, arm, n, mae, bias): every configuration scored in one pass."""
    named = F.array(*[F.struct(F.lit(n).alias("arm"), c.cast("double").alias("pred")) for n, c in arms.items()])
    long = rows.withColumn("_x", F.explode(named)).select(*group, "_x.arm", "_x.pred", actual)
    return long.groupBy(*group, "arm").agg(F.count(F.lit(1)).alias("n"), F.avg(F.abs(F.col("pred") - F.col(actual))).alias("mae"), F.avg(F.col("pred") - F.col(actual)).alias("bias"))


def choose_arm(scores: DataFrame, *, metric: str = "mae") -> DataFrame:
    """The arm with the lowest mean metric over all groups."""
    mean = scores.groupBy("arm").agg(F.avg(metric).alias(metric))
    return mean.agg(F.min_by("arm", F.struct(metric, "arm")).alias("arm"), F.min(metric).alias(metric))


def paired_by_period(scores: DataFrame, a: str, b: str, *, metric: str = "mae", period: str = "season") -> DataFrame:
    """(period, improvement) of arm b over arm a."""
    w = scores.groupBy(period).agg(F.avg(F.when(F.col("arm") == a, F.col(metric))).alias("_a"), F.avg(F.when(F.col("arm") == b, F.col(metric))).alias("_b"))
    return w.select(period, (F.col("_a") - F.col("_b")).alias("improvement"))


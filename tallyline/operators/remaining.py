"""The rest of a period as seen from every cutoff of every period, under every setting of a blend, and which setting earlier periods speak for.

Events are read once: an event meets its own period's cutoffs (a handful) and is summed before and after each. Settings are exploded on rows of one
per (period, cutoff, entity), and scored by one grouping; choosing and comparing settings works on that result, one row per period, cutoff and setting.
"""

from __future__ import annotations

import itertools
from dataclasses import asdict, dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

from tallyline.functions.scoring import clip, posterior_mean
from tallyline.operators.metrics import correlation
from tallyline.operators.ranking import By, asc, desc, with_row_number, with_tied_rank
from tallyline.session import cut_lineage

PRIOR, SAMPLE, BLEND, DIRECT = "prior", "sample", "blend", "direct"


@dataclass(frozen=True)
class Setting:
    """How prior and sample are weighed: 'blend' takes rate per minute, minutes and share apart, 'direct' the rate per event as one."""

    name: str
    mode: str = BLEND
    minutes_pseudo: float = 300.0
    games_pseudo: float = 3.0
    share_pseudo: float = 5.0
    rate_pseudo: float = 5.0


@dataclass(frozen=True)
class Weak:
    """The prior of an entity without one."""

    per_minute: float = 0.45
    minutes: float = 12.0
    share: float = 0.55


def grid_settings(minutes: tuple[float, ...], games: tuple[float, ...], shares: tuple[float, ...], rates: tuple[float, ...] = ()) -> list[Setting]:
    """Prior only, sample only, every blend of the grid, and a direct one for each of ``rates``."""
    blends = [Setting(f"blend m{m:g} g{g:g} s{s:g}", BLEND, m, g, s) for m, g, s in itertools.product(minutes, games, shares)]
    return [Setting("prior only", PRIOR), Setting("sample only", SAMPLE), *blends, *[Setting(f"direct r{k:g}", DIRECT, rate_pseudo=k) for k in rates]]


def cutoff_days(events: DataFrame, cutoffs: list[int], *, period: str, group: str, day: str) -> DataFrame:
    """(period, cutoff, cut_day): the day on which the median group had had ``cutoff`` days with events. A cutoff that some group never reaches, or reaches
    on its last day, is left out. Groups' days are numbered in windows that the calendar bounds."""
    days = events.where(F.col(group).isNotNull() & F.col(day).isNotNull()).select(period, group, day).distinct()
    mine = Window.partitionBy(period, group)
    placed = days.withColumn("_k", F.row_number().over(mine.orderBy(day))).withColumn("_n", F.count(F.lit(1)).over(mine))
    least = placed.groupBy(period).agg(F.min("_n").alias("_least"))
    at = placed.where(F.col("_k").isin(cutoffs)).groupBy(period, F.col("_k").alias("cutoff")).agg(F.floor(F.median(F.unix_date(day))).cast("int").alias("_d"))
    return at.join(least, period).where(F.col("cutoff") < F.col("_least")).select(period, F.col("cutoff").cast("int").alias("cutoff"), F.date_from_unix_date("_d").alias("cut_day"))


def _with_cuts(rows: DataFrame, cuts: DataFrame, period: str) -> DataFrame:
    """Each row once for every cutoff of its period. One row per period on the other side."""
    listed = cuts.groupBy(period).agg(F.collect_list(F.struct("cutoff", "cut_day")).alias("_cuts"))          # the cutoffs asked for
    return rows.join(F.broadcast(listed), period).withColumn("_cut", F.explode("_cuts")).withColumns({"cutoff": F.col("_cut.cutoff"), "cut_day": F.col("_cut.cut_day")}).drop("_cuts", "_cut")


def before_and_after(events: DataFrame, cuts: DataFrame, *, period: str, entity: str, group: str, day: str, event: str, minutes: str, value: str) -> DataFrame:
    """(period, cutoff, entity, gp, minutes, fp, group, after_games, after_total): what each entity had done by each cutoff, in its latest group, and did later."""
    met = _with_cuts(events.where(F.col(entity).isNotNull()), cuts, period)
    old = F.col(day) <= F.col("cut_day")
    return met.groupBy(period, "cutoff", entity).agg(
        F.count_if(old).cast("double").alias("gp"), F.coalesce(F.sum(F.when(old, F.col(minutes))), F.lit(0.0)).alias("minutes"), F.coalesce(F.sum(F.when(old, F.col(value))), F.lit(0.0)).alias("fp"),
        F.max_by(group, F.when(old, F.struct(day, event))).alias(group), F.count_if(~old).cast("double").alias("after_games"), F.coalesce(F.sum(F.when(~old, F.col(value))), F.lit(0.0)).alias("after_total"))


def group_progress(events: DataFrame, cuts: DataFrame, *, period: str, group: str, day: str) -> DataFrame:
    """(period, cutoff, group, played, left): days with events of each group up to each cutoff and after it."""
    met = _with_cuts(events.where(F.col(group).isNotNull()).select(period, group, day).distinct(), cuts, period)
    old = F.col(day) <= F.col("cut_day")
    return met.groupBy(period, "cutoff", group).agg(F.count_if(old).cast("double").alias("played"), F.count_if(~old).cast("double").alias("left"))


def with_priors(seen: DataFrame, prior: DataFrame, placed: DataFrame, progress: DataFrame, *, period: str, entity: str, group: str, length: float, weak: Weak = Weak()) -> DataFrame:
    """Everyone with a prior or an event at each cutoff, with prior and sample values and the group's days played and left.

    ``prior``: (period, entity, prior_minutes, prior_rate, prior_games); ``placed``: (period, entity, group) of entities that have yet to appear. An unknown group
    counts as having played as much as the one that has played most, with as much left as the median group.
    """
    cuts = progress.select(period, "cutoff").distinct()
    listed = prior.join(F.broadcast(cuts), period).select(period, "cutoff", entity, "prior_minutes", "prior_rate", "prior_games", F.lit(True).alias("has_prior"))      # a few rows per period
    df = seen.join(listed, [period, "cutoff", entity], "full_outer").join(placed.select(period, entity, F.col(group).alias("_placed")).dropDuplicates([period, entity]), [period, entity], "left")
    df = df.withColumn(group, F.coalesce(group, "_placed")).drop("_placed").na.fill({"gp": 0.0, "minutes": 0.0, "fp": 0.0, "after_games": 0.0, "after_total": 0.0, "has_prior": False})
    usual = progress.groupBy(period, "cutoff").agg(F.max("played").alias("_most"), F.median("left").alias("_usual"))
    df = df.join(progress, [period, "cutoff", group], "left").join(F.broadcast(usual), [period, "cutoff"])         # one row per period and cutoff
    has = F.col("has_prior")
    per_minute = F.coalesce(F.when(has & (F.col("prior_minutes") > 0), F.col("prior_rate") / F.col("prior_minutes")), F.lit(weak.per_minute))
    df = df.withColumns({"played": F.coalesce("played", "_most"), "left": F.coalesce("left", "_usual"), "p_per_minute": per_minute, "p_minutes": F.when(has, F.col("prior_minutes")).otherwise(F.lit(weak.minutes)),
                         "p_share": F.when(has, clip(F.col("prior_games") / F.lit(length), 0.0, 1.0)).otherwise(F.lit(weak.share))})
    df = df.withColumn("p_rate", F.when(has, F.col("prior_rate")).otherwise(F.col("p_per_minute") * F.col("p_minutes")))
    return df.withColumns({"s_per_minute": F.when(F.col("minutes") > 0, F.col("fp") / F.col("minutes")), "s_minutes": F.when(F.col("gp") > 0, F.col("minutes") / F.col("gp")),
                           "s_rate": F.when(F.col("gp") > 0, F.col("fp") / F.col("gp")), "s_share": F.when(F.col("played") > 0, F.least(F.col("gp") / F.greatest(F.col("played"), F.lit(1.0)), F.lit(1.0)))}).drop("_most", "_usual")


def in_universe(df: DataFrame, *, period: str, entity: str, length: float, top: int, min_games: int, **kw) -> DataFrame:
    """``df`` with ``scored``: the ``top`` of each cutoff by prior total, and everyone with ``min_games`` events by then."""
    ranked = with_row_number(df.withColumn("_total", F.when(F.col("has_prior"), F.col("p_rate") * F.col("p_share") * F.lit(length))), [period, "cutoff"], [desc("_total"), asc(entity)], "_place", **kw)
    return ranked.withColumn("scored", (F.col("has_prior") & (F.col("_place") <= top)) | (F.col("gp") >= min_games)).drop("_total", "_place")


def remaining(df: DataFrame, settings: list[Setting]) -> DataFrame:
    """``df`` once for each setting, with ``setting``, ``rest_rate``, ``rest_games`` and ``rest_total``."""
    each = F.explode(F.array(*[F.struct(*[F.lit(v).alias(k) for k, v in asdict(s).items()]) for s in settings])).alias("_s")
    rows = df.select("*", each)
    c = lambda k: F.col("_s." + k)                                                        # noqa: E731
    mixed = lambda k, n, pseudo: posterior_mean(F.col("p_" + k), F.coalesce(F.col("s_" + k), F.col("p_" + k)), F.col(n), pseudo)     # noqa: E731
    seen = lambda k: F.coalesce(F.col("s_" + k), F.col("p_" + k))                           # noqa: E731
    mode: Column = c("mode")
    blended = mixed("per_minute", "minutes", c("minutes_pseudo")) * mixed("minutes", "gp", c("games_pseudo"))
    rate = F.when(mode == PRIOR, F.col("p_rate")).when(mode == SAMPLE, seen("rate")).when(mode == BLEND, blended).otherwise(mixed("rate", "gp", c("rate_pseudo")))
    share = F.when(mode == PRIOR, F.col("p_share")).when(mode == SAMPLE, seen("share")).otherwise(mixed("share", "played", c("share_pseudo")))
    rows = rows.withColumns({"setting": c("name"), "rest_rate": rate, "rest_games": clip(share, 0.0, 1.0) * F.col("left")})
    return rows.withColumn("rest_total", F.col("rest_rate") * F.col("rest_games")).drop("_s")


def score_settings(rows: DataFrame, *, period: str, entity: str, top: int, min_after: int = 10, **kw) -> DataFrame:
    """(period, cutoff, setting, n, mae_total, mae_rate, spearman, top_share): errors, agreement of ranks, and how many of the real ``top`` are in the predicted one.
    ``spearman`` is null where all totals of a cell are equal."""
    cell = [period, "cutoff", "setting"]
    r = cut_lineage(rows.where("scored").select(*cell, entity, "rest_total", "rest_rate", "after_total", "after_games"))      # ranked four times
    r = with_tied_rank(with_tied_rank(r, cell, By("rest_total"), "_a", **kw), cell, By("after_total"), "_b", **kw)
    r = with_row_number(with_row_number(r, cell, [desc("rest_total"), asc(entity)], "_p", **kw), cell, [desc("after_total"), asc(entity)], "_q", **kw)
    enough = F.col("after_games") >= min_after
    return r.groupBy(*cell).agg(
        F.count(F.lit(1)).alias("n"), F.avg(F.abs(F.col("rest_total") - F.col("after_total"))).alias("mae_total"), F.avg(F.when(enough, F.abs(F.col("rest_rate") - F.col("after_total") / F.col("after_games")))).alias("mae_rate"),
        correlation("_a", "_b").alias("spearman"), (F.count_if((F.col("_p") <= top) & (F.col("_q") <= top)) / F.least(F.lit(top), F.count(F.lit(1)))).alias("top_share"))


def chosen_settings(scores: DataFrame, names: list[str], *, period: str, metric: str = "mae_total") -> DataFrame:
    """(period, setting, earlier): for every period the one of ``names`` with the least mean ``metric`` over the periods before it, ties to the first name; none without such periods.
    ``scores`` has a row per period, cutoff and setting."""
    per = scores.where(F.col("setting").isin(names)).groupBy(period, "setting").agg(F.sum(metric).alias("_s"), F.count(metric).alias("_n"))
    before = Window.partitionBy("setting").orderBy(period).rowsBetween(Window.unboundedPreceding, -1)
    run = per.select(period, "setting", F.sum("_s").over(before).alias("_s"), F.sum("_n").over(before).alias("_n"), F.count(F.lit(1)).over(before).alias("earlier")).where(F.col("_n") > 0)
    return run.groupBy(period).agg(F.min_by("setting", F.struct(F.round(F.col("_s") / F.col("_n"), 9), "setting")).alias("setting"), F.max("earlier").alias("earlier"))


def paired_settings(scores: DataFrame, mine: DataFrame, other: str, *, period: str, metric: str, lower_is_better: bool = True) -> DataFrame:
    """(periods, mean_gain, won): the settings ``mine`` (period, setting) against ``other``, cutoffs averaged within a period."""
    means = scores.groupBy(period, "setting").agg(F.avg(metric).alias("_m"))
    a = means.join(F.broadcast(mine.select(period, "setting")), [period, "setting"]).select(period, F.col("_m").alias("_a"))       # one row per period
    b = means.where(F.col("setting") == other).select(period, F.col("_m").alias("_b"))
    gain = (F.col("_b") - F.col("_a")) if lower_is_better else (F.col("_a") - F.col("_b"))
    return a.join(b, period).select(gain.alias("_g")).agg(F.count("_g").alias("periods"), F.avg("_g").alias("mean_gain"), F.count_if(F.col("_g") > 0).alias("won"))


def with_value(rows: DataFrame, *, period: str, entity: str, pool: int, **kw) -> DataFrame:
    """``rows`` with ``value``, the rest's total over that of place ``pool`` of its period and cutoff (0 where there are fewer), and ``place``."""
    # rounded: the order of a sum's parts must not break ties
    ranked = with_row_number(rows.withColumn("_rounded", F.round("rest_total", 6)), [period, "cutoff"], [desc("_rounded"), asc(entity)], "place", **kw).drop("_rounded")
    level = ranked.where(F.col("place") == pool).select(period, "cutoff", F.col("rest_total").alias("_level"))                 # one row per period and cutoff
    return ranked.join(F.broadcast(level), [period, "cutoff"], "left").withColumn("value", F.col("rest_total") - F.coalesce("_level", F.lit(0.0))).drop("_level")

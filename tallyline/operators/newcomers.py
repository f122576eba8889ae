"""Entities without history: evidence from the run-up to a period, class multipliers, play probability and their rows in a projection.

Everything is fitted for all target periods at once and only from earlier ones: what a period contributes is summed once, and each
target takes the running total of the periods before it. Tables of one row per period (times a short grid) are all that windows run on.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, Window, functions as F

from tallyline.functions.scoring import clip
from tallyline.operators.fit import by_period
from tallyline.session import cut_lineage

DECAYS = (0.5, 0.6, 0.7, 0.8, 0.9, 1.0)
#: The slot that an entity without one counts as.
NO_SLOT = 61.0


def _running(period: str, *keys: str):
    """All earlier periods: over tables of one row per period and key."""
    return Window.partitionBy(*keys).orderBy(period).rowsBetween(Window.unboundedPreceding, -1)


# ------------------------------------------------------------------------------------------------ evidence

def day_ranks(logs: DataFrame, period: str, day: str) -> DataFrame:
    """(period, day, place, days): the place of each day among its period's distinct days. One row per day of the calendar."""
    days = logs.where(F.col(day).isNotNull()).select(period, day).distinct()
    w = Window.partitionBy(period)
    return days.withColumn("place", F.row_number().over(w.orderBy(day))).withColumn("days", F.count(F.lit(1)).over(w))


def evidence_at_shares(logs: DataFrame, shares: list[float], *, period: str, entity: str, day: str, game: str, minutes: str, context: str, cut: str, whole: str) -> DataFrame:
    """(share, period, entity, cut_games, cut_mean, whole_games, whole_mean): what is known of an entity after each share of a period's days.

    Rows whose ``context`` is ``cut`` count up to the share of the period's distinct days in that context, rounded up, one day at least (share 0: none);
    rows of the context ``whole`` always count. All shares come from one grouping: games are reduced to one row per entity and day's place first, then
    each share is a conditional sum. An entity with nothing left at a share has no row there; means of no games are null.
    """
    ranked = day_ranks(logs.where(F.col(context) == cut), period, day)
    kept = logs.where(F.col(context).isin(cut, whole) & F.col(entity).isNotNull())
    games = kept.groupBy(period, entity, context, day, game).agg(F.sum(minutes).alias("_m"))
    placed = games.join(F.broadcast(ranked), [period, day], "left")                     # one row per day
    is_cut = F.col(context) == cut

    def within(share: float) -> Column:
        return is_cut & (F.col("place") <= F.greatest(F.ceil(F.lit(share) * F.col("days")), F.lit(1))) if share > 0 else F.lit(False)

    sums = [F.count_if(~is_cut).alias("_wn"), F.sum(F.when(~is_cut, F.col("_m"))).alias("_wm")]
    for i, share in enumerate(shares):
        sums += [F.count_if(within(share)).alias(f"_n{i}"), F.sum(F.when(within(share), F.col("_m"))).alias(f"_m{i}")]
    per = placed.groupBy(period, entity).agg(*sums)
    each = F.explode(F.array(*[F.struct(F.lit(float(s)).alias("share"), F.col(f"_n{i}").alias("n"), F.col(f"_m{i}").alias("m")) for i, s in enumerate(shares)]))
    rows = per.select(period, entity, "_wn", "_wm", each.alias("_s")).where((F.col("_s.n") > 0) | (F.col("_wn") > 0))
    return rows.select("_s.share", period, entity, F.col("_s.n").alias("cut_games"), F.try_divide("_s.m", "_s.n").alias("cut_mean"),
                       F.col("_wn").alias("whole_games"), F.try_divide("_wm", "_wn").alias("whole_mean"))


def share_seen(logs: DataFrame, period: str, day: str, *, recent: int = 3) -> DataFrame:
    """(period, days, usual_days, share): how much of its usual length each period shows, the usual one being the median of the ``recent`` periods before it."""
    n = logs.where(F.col(day).isNotNull()).groupBy(period).agg(F.countDistinct(day).alias("days"))
    # one row per period
    last = Window.orderBy(period).rowsBetween(-recent, -1)
    n = n.withColumn("_last", F.sort_array(F.collect_list("days").over(last))).withColumn("_k", F.size("_last"))
    middle = (F.try_element_at("_last", F.floor((F.col("_k") + 1) / 2).cast("int")) + F.try_element_at("_last", F.floor(F.col("_k") / 2).cast("int") + 1)) / 2
    usual = n.withColumn("usual_days", F.when(F.col("_k") > 0, middle)).drop("_last", "_k")
    return usual.withColumn("share", F.when(F.col("usual_days").isNull(), F.lit(1.0)).otherwise(F.least(F.lit(1.0), F.col("days") / F.col("usual_days"))))


# ------------------------------------------------------------------------------------------------ logits of all targets

@dataclass
class FoldLogits:
    """A logit per target period, each from the periods before it. Targets with too few rows are off."""

    columns: list[str]
    n: dict[int, int]
    positive: dict[int, int]
    mean: dict[int, np.ndarray]
    scale: dict[int, np.ndarray]
    beta: dict[int, np.ndarray]
    steps: int

    def probability(self, period: Column, *, low: float = 0.0, high: float = 1.0, off: float = 1.0) -> Column:
        """Of a row at ``period``; a missing feature counts as its training mean, a target that is off gives ``off``."""
        z = by_period({p: float(b[0]) for p, b in self.beta.items()}, period)
        for i, c in enumerate(self.columns):
            unit = {p: float(b[i + 1] / self.scale[p][i]) for p, b in self.beta.items()}
            mean = by_period({p: float(self.mean[p][i]) for p in self.beta}, period)
            z = z + by_period(unit, period) * (F.coalesce(F.col(c).cast("double"), mean) - mean)
        # greatest and least pass nulls over, so a target without a fit is told first
        fitted, z = z.isNotNull(), F.greatest(F.least(z, F.lit(30.0)), F.lit(-30.0))
        return F.when(~fitted, F.lit(float(off))).otherwise(clip(F.lit(1.0) / (F.lit(1.0) + F.exp(-z)), low, high))


def fold_logits(rows: DataFrame, xs: list[str], label: str, period: str, targets: list[int], *, ridge: float = 1.0, min_rows: int = 100, min_class: int = 10,
                max_steps: int = 50, tolerance: float = 1e-8) -> FoldLogits:
    """Ridge logits of ``label`` (0/1) on standardised ``xs`` for every period of ``targets``, each on the rows of earlier periods.

    A Newton step of all targets is one grouped pass: a row meets each later target's coefficients, and gradients and Hessians are combined on the map side. The
    driver gets (p + 1)(p + 4) / 2 numbers per target. Rows with a null in ``xs`` or ``label`` are left out of the fit.
    """
    p = len(xs)
    data = rows.select(F.col(period).cast("long").alias("_p"), F.col(label).cast("double").alias("_y"), *[F.col(x).cast("double").alias(f"_x{i}") for i, x in enumerate(xs)]).dropna()
    data = cut_lineage(data)
    sums = data.groupBy("_p").agg(F.count(F.lit(1)).alias("n"), F.sum("_y").alias("y"), *[F.sum(f"_x{i}").alias(f"s{i}") for i in range(p)], *[F.sum(F.col(f"_x{i}") ** 2).alias(f"q{i}") for i in range(p)]).collect()   # a row per period
    out = FoldLogits(list(xs), {}, {}, {}, {}, {}, 0)
    for t in sorted(targets):
        before = [r for r in sums if r["_p"] < t]
        n, y = sum(r["n"] for r in before), sum(r["y"] for r in before)
        out.n[t], out.positive[t] = int(n), int(y)
        if n < min_rows or min(y, n - y) < min_class:
            continue
        mean = np.array([sum(r[f"s{i}"] for r in before) / n for i in range(p)])
        spread = np.sqrt(np.maximum(np.array([sum(r[f"q{i}"] for r in before) / n for i in range(p)]) - mean ** 2, 0.0))
        out.mean[t], out.scale[t], out.beta[t] = mean, np.where(spread < 1e-9, 1.0, spread), np.zeros(p + 1)
    penalty = np.eye(p + 1) * ridge
    penalty[0, 0] = 0.0
    open_targets = sorted(out.beta)
    while open_targets and out.steps < max_steps:
        out.steps += 1
        later = F.filter(F.array(*[F.lit(int(t)) for t in open_targets]), lambda t: t > F.col("_p"))
        met = data.withColumn("_t", F.explode(later))
        z = [F.lit(1.0)] + [(F.col(f"_x{i}") - by_period({t: float(out.mean[t][i]) for t in open_targets}, F.col("_t"))) / by_period({t: float(out.scale[t][i]) for t in open_targets}, F.col("_t")) for i in range(p)]
        named = met.select("_t", "_y", *[c.alias(f"z{i}") for i, c in enumerate(z)])
        eta = sum((by_period({t: float(out.beta[t][i]) for t in open_targets}, F.col("_t")) * F.col(f"z{i}") for i in range(p + 1)), F.lit(0.0))
        scored = named.withColumn("_f", F.lit(1.0) / (F.lit(1.0) + F.exp(-F.greatest(F.least(eta, F.lit(30.0)), F.lit(-30.0)))))
        w = F.col("_f") * (F.lit(1.0) - F.col("_f"))
        passes = scored.groupBy("_t").agg(*[F.sum(F.col(f"z{i}") * (F.col("_y") - F.col("_f"))).alias(f"g{i}") for i in range(p + 1)],
                                          *[F.sum(w * F.col(f"z{i}") * F.col(f"z{j}")).alias(f"h{i}_{j}") for i in range(p + 1) for j in range(i, p + 1)]).collect()   # a row per target
        moving = []
        for r in passes:
            t = int(r["_t"])
            hessian = np.array([[r[f"h{min(i, j)}_{max(i, j)}"] for j in range(p + 1)] for i in range(p + 1)]) + penalty + 1e-9 * np.eye(p + 1)
            step = np.linalg.solve(hessian, np.array([r[f"g{i}"] for i in range(p + 1)]) - penalty @ out.beta[t])
            out.beta[t] = out.beta[t] + step
            if np.max(np.abs(step)) >= tolerance:
                moving.append(t)
        open_targets = sorted(moving)
    return out


# ------------------------------------------------------------------------------------------------ class multipliers

def effective_slot(slot: Column, years: Column, decay: Column | float) -> Column:
    """An old slot counts for less: it is pulled toward ``NO_SLOT`` with every year."""
    d = F.lit(float(decay)) if isinstance(decay, (int, float)) else decay
    return F.lit(NO_SLOT) - (F.lit(NO_SLOT) - slot) * F.pow(d, F.coalesce(years, F.lit(0)).cast("double"))


def slot_curves(rows: DataFrame, periods: DataFrame, *, period: str, slot: str, y: str, w: str) -> DataFrame:
    """(period, at_one, per_log): the weighted line of ``y`` on log ``slot`` for every period of ``periods`` from earlier rows only; null without two slots."""
    x, k = F.log(F.col(slot).cast("double")), F.col(w).cast("double")
    ok = rows.where(F.col(slot).isNotNull() & F.col(y).isNotNull() & (F.col(w) > 0))
    sums = ok.groupBy(period).agg(F.sum(k).alias("_w"), F.sum(k * x).alias("_x"), F.sum(k * F.col(y)).alias("_y"), F.sum(k * x * x).alias("_xx"), F.sum(k * x * F.col(y)).alias("_xy"))
    before = _running(period)
    run = periods.join(sums, period, "left").select(period, *[F.sum(c).over(before).alias(c) for c in ("_w", "_x", "_y", "_xx", "_xy")])
    spread = F.col("_w") * F.col("_xx") - F.col("_x") * F.col("_x")
    slope = F.when(spread > 1e-9 * F.col("_w") * F.col("_w"), (F.col("_w") * F.col("_xy") - F.col("_x") * F.col("_y")) / spread)
    return run.select(period, ((F.col("_y") - slope * F.col("_x")) / F.col("_w")).alias("at_one"), slope.alias("per_log"))


def prior_at(slot: Column) -> Column:
    return F.col("at_one") + F.col("per_log") * F.log(slot)


def class_multipliers(rows: DataFrame, curves: DataFrame, *, period: str, length: float, decays: tuple[float, ...] = DECAYS, min_played: int = 10, min_gain: float = 0.01,
                      shrink: float = 25.0, weight_cap: float = 30.0, default_share: float = 0.25) -> DataFrame:
    """What earlier newcomers teach each period: (period, n_stash, decay, loss_plain, loss_best, foreign_scale, n_undrafted, scale, game_share, played_share).

    ``rows``: period, klass ('stash' or 'undrafted'), slot, years, foreign, played, games, rate. A newcomer is judged by the curve of its own period, which hasn't seen
    it, so its error does not depend on the target: the losses of the whole decay grid come from one grouped pass, and each target adds up the periods before it.
    The decay of least loss counts if it beats no decay by ``min_gain``; multipliers are shrunk toward 1 by ``shrink`` rows; classes with fewer
    than ``min_played`` rows keep their defaults.
    """
    w = F.least(F.col("games").cast("double"), F.lit(weight_cap))
    known = rows.join(F.broadcast(curves), period)                                     # one row per period
    grid = F.explode(F.array(*[F.lit(float(d)) for d in decays])).alias("decay")
    stash = known.where((F.col("klass") == "stash") & F.col("played")).select("*", grid)
    prior = prior_at(effective_slot(F.col("slot"), F.col("years"), F.col("decay")))
    stash = stash.withColumn("_prior", prior).where(F.col("_prior").isNotNull())
    is_foreign = F.col("foreign").cast("boolean")
    losses = stash.groupBy(period, "decay").agg(F.count(F.lit(1)).alias("n"), F.sum(F.abs(F.col("_prior") - F.col("rate"))).alias("err"), F.count_if(is_foreign).alias("nf"),
                                                F.sum(F.when(is_foreign, w * F.col("rate"))).alias("fy"), F.sum(F.when(is_foreign, w * F.col("_prior"))).alias("fp"))
    periods = curves.select(period)
    cells = periods.select(period, grid)
    before = _running(period, "decay")
    run = cells.join(losses, [period, "decay"], "left").select(period, "decay", *[F.coalesce(F.sum(c).over(before), F.lit(0)).alias(c) for c in ("n", "err", "nf", "fy", "fp")])
    run = run.withColumn("loss", F.try_divide("err", "n"))
    plain = F.max(F.when(F.col("decay") == 1.0, F.col("loss")))
    best = F.min(F.struct(F.col("loss"), (-F.col("decay")).alias("less")))
    picked = run.groupBy(period).agg(F.max("n").alias("n_stash"), plain.alias("loss_plain"), best.alias("_best"))
    gain = F.try_divide(F.col("loss_plain") - F.col("_best.loss"), F.col("loss_plain"))
    picked = picked.withColumn("decay", F.when((F.col("n_stash") >= min_played) & (gain >= min_gain), -F.col("_best.less")).otherwise(F.lit(1.0)))
    at = run.select(period, "decay", "nf", "fy", "fp")
    picked = picked.join(at, [period, "decay"], "left")
    ratio = F.try_divide("fy", "fp")
    foreign = F.when((F.col("n_stash") >= min_played) & (F.col("nf") >= 3), (F.col("nf") * ratio + shrink) / (F.col("nf") + shrink)).otherwise(F.lit(1.0))
    und = known.where(F.col("klass") == "undrafted").withColumn("_prior", prior_at(F.lit(NO_SLOT)))
    on = F.col("played") & F.col("_prior").isNotNull()
    sums = und.groupBy(period).agg(F.count(F.lit(1)).alias("camp"), F.count_if("played").alias("ever"), F.count_if(on).alias("m"), F.sum(F.when(on, w)).alias("w"), F.sum(F.when(on, w * F.col("rate"))).alias("wy"),
                                   F.sum(F.when(on, w * F.col("_prior"))).alias("wp"), F.sum(F.when(on, F.col("_prior"))).alias("p"), F.sum(F.when(on, F.col("games") / F.lit(float(length)))).alias("g"))
    earlier = _running(period)
    u = periods.join(sums, period, "left").select(period, *[F.coalesce(F.sum(c).over(earlier), F.lit(0)).alias(c) for c in ("camp", "ever", "m", "w", "wy", "wp", "p", "g")])
    k = F.lit(shrink) * F.col("p") / F.col("m")
    enough = F.col("m") >= min_played
    u = u.select(period, F.col("m").alias("n_undrafted"), F.when(enough, (F.col("wy") / F.col("w") * F.col("m") + k) / (F.col("wp") / F.col("w") * F.col("m") + k)).otherwise(F.lit(1.0)).alias("scale"),
                 F.when(enough, (F.col("g") + shrink * default_share) / (F.col("m") + shrink)).otherwise(F.lit(default_share)).alias("game_share"), F.try_divide("ever", "camp").alias("played_share"))
    return picked.select(period, "n_stash", "decay", "loss_plain", F.col("_best.loss").alias("loss_best"), foreign.alias("foreign_scale")).join(u, period)


def newcomer_rows(candidates: DataFrame, curves: DataFrame, multipliers: DataFrame, *, period: str, entity: str, length: float, stash_play: float = 0.5,
                  play_clip: tuple[float, float] = (0.02, 0.98), share_clip: tuple[float, float] = (0.005, 0.985), default_played: float = 0.3, play: Column | None = None) -> DataFrame:
    """(period, entity, klass, rate, games, total, p_play) of ``candidates`` (period, entity, klass, slot, years, foreign, share): the slot's prior times its
    class's multiplier, games from the chance to play and the class's share of games. ``play`` overrides the undrafted's chance."""
    known = candidates.join(F.broadcast(curves), period).join(F.broadcast(multipliers), period)          # one row per period
    stash = F.col("klass") == "stash"
    slot = F.when(stash, effective_slot(F.col("slot"), F.col("years"), F.col("decay"))).otherwise(F.lit(NO_SLOT))
    scale = F.when(stash, F.when(F.col("foreign").cast("boolean"), F.col("foreign_scale")).otherwise(F.lit(1.0))).otherwise(F.col("scale"))
    usual = F.coalesce("played_share", F.lit(default_played))
    chance = clip(F.when(stash, F.lit(stash_play)).otherwise(usual if play is None else F.coalesce(play, usual)), *play_clip)
    share = F.when(stash, clip(F.col("share"), 0.02, 0.985)).otherwise(F.col("game_share"))
    rate = F.greatest(prior_at(slot) * scale, F.lit(0.0))
    made = known.select(period, entity, "klass", rate.alias("rate"), (clip(chance * share, *share_clip) * F.lit(float(length))).alias("games"), chance.alias("p_play"))
    return made.withColumn("total", F.col("rate") * F.col("games"))


def with_newcomers(projected: DataFrame, newcomers: DataFrame, *, period: str, entity: str) -> DataFrame:
    """``projected`` (period, entity, rate, games, total), unchanged and marked 'veteran', with the newcomers' rows that it doesn't have."""
    new = newcomers.join(projected.select(period, entity), [period, entity], "left_anti")
    marked = projected.select(period, entity, F.lit("veteran").alias("projection_class"), "rate", "games", "total", F.lit(None).cast("double").alias("p_play"))
    return marked.unionByName(new.select(period, entity, F.col("klass").alias("projection_class"), "rate", "games", "total", "p_play"))

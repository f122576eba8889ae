"""Evaluation studies: bins, shares over grouping sets, effects within periods, cohorts, decompositions."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column, DataFrame, Window, functions as F

from tallyline.operators.ranking import By, asc, desc, exact_quantiles, top_k, with_row_number
from tallyline.operators.resample import mean_interval


def equal_bins(rows: DataFrame, order: list[By], n_bins: int, name: str = "bin") -> DataFrame:
    """Bins of equal size in an order that ends in a unique key; the first ones take the remainder. Ranked by value ranges, not in one task."""
    ranked = with_row_number(rows, [], order, "_rn")
    total = rows.agg(F.count(F.lit(1))).scalar()
    small, extra = F.floor(total / n_bins), total % n_bins
    edge = extra * (small + 1)
    i = F.col("_rn") - 1
    return ranked.withColumn(name, (F.when(i < edge, F.floor(i / (small + 1))).otherwise(extra + F.floor((i - edge) / F.greatest(small, F.lit(1)))) + 1).cast("long")).drop("_rn")


def win_shares(rows: DataFrame, columns: list[str], sets: list[list[str]], won: str) -> DataFrame:
    """(columns, n, win_share) over grouping sets; a column outside a set reads 'all'. One pass, expanded on the map side."""
    cols = [F.col(c) for c in columns]
    out = rows.groupingSets([[F.col(c) for c in s] for s in sets], *cols).agg(
        F.count(F.lit(1)).alias("n"), F.avg(F.col(won).cast("double")).alias("win_share"), *[F.grouping(c).alias("_g_" + c) for c in columns])
    return out.select(*[F.when(F.col("_g_" + c) == 1, F.lit("all")).otherwise(F.col(c)).alias(c) for c in columns], "n", "win_share")


def slope_within(rows: DataFrame, group: list[str], x: str, y: str) -> DataFrame:
    """(group, n, slope): least squares inside each group from one aggregate of sums (demeaning is algebra, not a join)."""
    s = rows.where(F.col(x).isNotNull() & F.col(y).isNotNull()).groupBy(*group).agg(
        F.count(F.lit(1)).alias("n"), F.covar_pop(x, y).alias("_c"), F.var_pop(x).alias("_v"))
    return s.select(*group, "n", F.when(F.col("_v") > 0, F.col("_c") / F.col("_v")).alias("slope"))


def pooled_slope_within(rows: DataFrame, group: list[str], x: str, y: str) -> DataFrame:
    """(slope, n): one slope after removing each group's means."""
    s = rows.where(F.col(x).isNotNull() & F.col(y).isNotNull()).groupBy(*group).agg(
        F.count(F.lit(1)).alias("n"), F.covar_pop(x, y).alias("_c"), F.var_pop(x).alias("_v"))
    return s.agg((F.sum(F.col("n") * F.col("_c")) / F.sum(F.col("n") * F.col("_v"))).alias("slope"), F.sum("n").alias("n"))


def sign_agreement(per_period: DataFrame, value: str, pooled: Column) -> DataFrame:
    """(n_same_sign, n): periods whose effect has the sign of the pooled one."""
    return per_period.agg(F.count_if(F.signum(value) == F.signum(pooled)).alias("n_same_sign"), F.count(value).alias("n"))


def robust_spread(rows: DataFrame, group: list[str], value: str) -> DataFrame:
    """(group, n, median, robust_sd): 1.4826 times the median distance from the median."""
    med = exact_quantiles(rows, group, value, {"median": 0.5})
    away = rows.join(F.broadcast(med), group).withColumn("_d", F.abs(F.col(value) - F.col("median")))      # one row per bucket
    spread = exact_quantiles(away, group, "_d", {"_mad": 0.5})
    n = rows.groupBy(*group).agg(F.count(value).alias("n"))
    return n.join(med, group).join(spread, group).select(*group, "n", "median", (F.lit(1.4826) * F.col("_mad")).alias("robust_sd"))


def largest_misses(rows: DataFrame, *, period: str, entity: str, err: str, n: int) -> DataFrame:
    """The ``n`` largest absolute errors of each period with their share of the period's total error."""
    total = rows.groupBy(period).agg(F.sum(F.abs(err)).alias("_total"))
    head = top_k(rows.withColumn("_size", F.round(F.abs(err), 2)), [period], [desc("_size"), asc(entity)], n, "place")
    return head.join(F.broadcast(total), period).withColumn("share", F.abs(err) / F.col("_total")).drop("_size", "_total")     # one row per period


def miss_tags(rows: DataFrame, *, gp_gap: float = 20.0, mpg_gap: float = 5.0) -> DataFrame:
    """Why a projection missed: games, minutes or rate, from the size of each part of the error."""
    d_gp, d_mpg = F.col("actual_gp") - F.col("proj_gp"), F.col("actual_mpg") - F.col("proj_mpg")
    games_part = d_gp * F.col("proj_fppg")
    rate_part = F.col("actual_gp") * (F.col("actual_fppg") - F.col("proj_fppg"))
    tags = F.array_compact(F.array(F.when(d_gp <= -gp_gap, "missed games"), F.when(d_gp >= gp_gap, "extra games"), F.when(d_mpg <= -mpg_gap, "lost minutes"),
                                   F.when(d_mpg >= mpg_gap, "gained minutes"), F.when(F.abs(rate_part) > F.abs(games_part), "rate")))
    return rows.withColumn("err_from_games", games_part).withColumn("err_from_rate", rate_part).withColumn("tags", F.array_join(tags, ", "))


def binned_error(rows: DataFrame, edges: list[float], by: str, err: str, unit: list[str], strata: list[str], *, n_boot: int = 200) -> DataFrame:
    """(bin, estimate, lo, hi): signed error by fixed bands of a measure with bootstrap intervals."""
    band = F.lit(0)
    for i, e in enumerate(edges, 1):
        band = F.when(F.col(by) >= e, F.lit(i)).otherwise(band)
    return mean_interval(rows.where(F.col(by).isNotNull()).withColumn("bin", band), err, unit, strata=strata, group=["bin"], n_boot=n_boot)


def label_accuracy(rows: DataFrame, labels: dict[str, Column], err: str) -> DataFrame:
    """(label, n, mae, bias) over overlapping subgroups."""
    tags = F.array_compact(F.array(*[F.when(F.coalesce(c, F.lit(False)), F.lit(n)) for n, c in labels.items()]))
    long = rows.withColumn("label", F.explode(tags))
    return long.groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.avg(F.abs(err)).alias("mae"), F.avg(err).alias("bias"))


def sensitivity_grid(rows: DataFrame, cells: dict[str, Column], outcome: str) -> DataFrame:
    """(cell, n, mean): a mean per threshold configuration, all cells in one pass over the rows."""
    aggs = list(chain.from_iterable((F.count_if(F.coalesce(c, F.lit(False))).alias("n_" + n), F.avg(F.when(c, F.col(outcome))).alias("m_" + n)) for n, c in cells.items()))
    one = rows.agg(*aggs)
    out = F.array(*[F.struct(F.lit(n).alias("cell"), F.col(f"`n_{n}`").alias("n"), F.col(f"`m_{n}`").alias("mean")) for n in cells])
    return one.select(F.explode(out).alias("x")).select("x.*")


def compare_matched(pairs: DataFrame, outcomes: DataFrame, *, entity: str, outcome: str, strata: str, n_boot: int = 200) -> DataFrame:
    """Cohort minus the mean of its matched controls, with an interval."""
    o = outcomes.select(F.col(entity), F.col(outcome), F.col(strata))
    case = pairs.join(o.withColumnRenamed(entity, "case_id").withColumnRenamed(outcome, "_case"), "case_id")
    both = case.join(o.select(F.col(entity).alias("control_id"), F.col(outcome).alias("_ctl")), "control_id")
    per = both.groupBy("case_id", strata).agg((F.first("_case") - F.avg("_ctl")).alias("diff"))
    return mean_interval(per, "diff", ["case_id"], strata=[strata], n_boot=n_boot)


def earlier_mean_correction(rows: DataFrame, *, flag: str, period: str, err: str, min_rows: int = 8) -> DataFrame:
    """``correction``: mean error of the same flag over strictly earlier periods, once there are enough rows.

    Errors are summed per (flag, period) first, so the window runs over periods.
    """
    per = rows.groupBy(flag, period).agg(F.sum(err).alias("_s"), F.count(err).alias("_n"))
    w = Window.partitionBy(flag).orderBy(period).rangeBetween(Window.unboundedPreceding, -1)
    per = per.withColumn("_cs", F.sum("_s").over(w)).withColumn("_cn", F.sum("_n").over(w))
    per = per.select(flag, period, F.when(F.col("_cn") >= min_rows, F.col("_cs") / F.col("_cn")).otherwise(0.0).alias("correction"))
    return rows.join(per, [flag, period], "left")


def segment_rates(rows: DataFrame, segments: list[tuple[str, Column]], outcome: str, *, default: str = "other") -> DataFrame:
    """(segment, n, rate): the first rule that holds names the segment."""
    name = F.lit(default)
    for n, c in reversed(segments):
        name = F.when(F.coalesce(c, F.lit(False)), F.lit(n)).otherwise(name)
    return rows.groupBy(name.alias("segment")).agg(F.count(F.lit(1)).alias("n"), F.avg(F.col(outcome).cast("double")).alias("rate"))


def shrink_weights(rows: DataFrame, cell: str, *, ours: str, theirs: str, actual: str, grid: list[float]) -> DataFrame:
    """(cell, weight, error): the blend of two ranks with the lowest mean error per cell, over a grid exploded per row."""
    long = rows.withColumn("weight", F.explode(F.array(*[F.lit(float(g)) for g in grid])))
    err = F.abs(F.col("weight") * F.col(ours) + (1 - F.col("weight")) * F.col(theirs) - F.col(actual))
    per = long.groupBy(cell, "weight").agg(F.avg(err).alias("error"))
    return per.groupBy(cell).agg(F.min_by("weight", F.struct("error", "weight")).alias("weight"), F.min("error").alias("error"))


def totals_by_rank(rows: DataFrame, period: list[str], *, new_rank: str, total: str, entity: str, name: str = "new_total") -> DataFrame:
    """Give each row the total that stands at its new rank among the period's sorted totals."""
    a = with_row_number(rows, period, [asc(new_rank), asc(entity)], "_place")
    b = with_row_number(rows.select(*period, total, entity), period, [desc(total), asc(entity)], "_place").select(*period, "_place", F.col(total).alias(name))
    return a.join(b, period + ["_place"]).drop("_place")


def never_occurred_share(listed: DataFrame, occurred: DataFrame, *, entity: str, order: list[By], n: int) -> DataFrame:
    """(n, share): part of the first ``n`` listed that never occurred."""
    head = listed.orderBy(*[k.sort() for k in order]).limit(n)
    seen = occurred.select(entity).distinct().withColumn("_seen", F.lit(True))
    return head.join(seen, entity, "left").agg(F.count(F.lit(1)).alias("n"), F.avg(F.col("_seen").isNull().cast("double")).alias("share"))


def decide(low: Column, wins: Column, n: Column, *, min_share: float = 0.6) -> Column:
    """'adopt' when the interval is above zero and enough periods are won, 'reject' otherwise."""
    return F.when((low > 0) & (wins >= F.lit(min_share) * n), "adopt").otherwise("reject")


def two_window_shares(events: DataFrame, schedule: DataFrame, *, entity: str, group: str, period: str, in_late: Column, event: str) -> DataFrame:
    """(entity, group, period, early_share, late_share, gap): share of the group's events an entity took part in, early and late.

    ``in_late`` is a predicate on the day columns that both tables carry; counts are combined on the map side.
    """
    own = events.groupBy(entity, group, period).agg(F.countDistinct(F.when(~in_late, F.col(event))).alias("_e"), F.countDistinct(F.when(in_late, F.col(event))).alias("_l"))
    all_ = schedule.groupBy(group, period).agg(F.countDistinct(F.when(~in_late, F.col(event))).alias("_te"), F.countDistinct(F.when(in_late, F.col(event))).alias("_tl"))
    j = own.join(all_, [group, period])
    early, late = F.try_divide(F.col("_e"), F.col("_te")), F.try_divide(F.col("_l"), F.col("_tl"))
    return j.select(entity, group, period, early.alias("early_share"), late.alias("late_share"), (late - early).alias("gap"))


def win_share(rows: DataFrame, group: list[str], own: str, other: str) -> DataFrame:
    """(group, n, win_pct) over rows where both scores are known."""
    ok = rows.where(F.col(own).isNotNull() & F.col(other).isNotNull())
    return ok.groupBy(*group).agg(F.count(F.lit(1)).alias("n"), F.avg((F.col(own) > F.col(other)).cast("double")).alias("win_pct"))


def newcomer_candidates(listed: DataFrame, known: DataFrame, *, entity: str = "player_id", season: int) -> DataFrame:
    """Entities never seen before, with their class: this year's draft, an earlier draft ('stash') or undrafted."""
    new = listed.join(known.select(entity).distinct(), entity, "left_anti").dropDuplicates([entity])
    cls = F.when(F.col("draft_year") == season, "rookie").when(F.col("draft_year") < season, "stash").otherwise("undrafted")
    return new.withColumn("newcomer_class", cls)


def breakout_label(actual: Column, base: Column, *, min_gain: float = 5.0, min_ratio: float = 0.15) -> Column:
    """An uplift that is large both absolutely and against the base."""
    return (actual - base >= min_gain) & (actual >= base * (1 + min_ratio))

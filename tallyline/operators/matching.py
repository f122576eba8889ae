"""Cohorts and controls: weighted cohort scores, nearest controls inside a caliper."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from tallyline.operators.ranking import asc, top_k, with_row_number, with_running_sum


def cohort_z(rows: DataFrame, cohort: list[str], values: dict[str, str], weight: str, *, min_weight: float = 0.0, min_rows: int = 5, clip_at: float = 3.0) -> DataFrame:
    """One score per entry of ``values`` (score name -> measure): distance from the weighted cohort mean in weighted deviations, clipped;
    null for a cohort that is too small or flat.

    Weighted means of all measures come from one aggregate with a row per cohort, deviations from them of a second one, both joined back:
    no window, no hot task, and large values with small deviations keep their digits.
    """
    w = F.col(weight).cast("double")
    known = {name: (F.col(weight) >= min_weight) & F.col(x).isNotNull() for name, x in values.items()}
    means, deviations, scores = [], [], []
    for name, x in values.items():
        v, mu = F.col(x).cast("double"), F.col("_m_" + name)
        means += [F.count_if(known[name]).alias("_n_" + name), (F.sum(F.when(known[name], w * v)) / F.sum(F.when(known[name], w))).alias("_m_" + name)]
        deviations.append(F.sqrt(F.sum(F.when(known[name], w * (v - mu) * (v - mu))) / F.sum(F.when(known[name], w))).alias("_d_" + name))
        z = F.greatest(F.lit(-clip_at), F.least(F.lit(clip_at), (v - mu) / F.col("_d_" + name)))
        scores.append(F.when((F.col("_n_" + name) >= min_rows) & (F.col("_d_" + name) > 1e-9) & F.col(x).isNotNull(), z).alias(name))
    placed = rows.join(rows.groupBy(*cohort).agg(*means), cohort, "left")
    out = placed.join(placed.groupBy(*cohort).agg(*deviations), cohort, "left")
    return out.select(*rows.columns, *scores)


def in_universe(*, veteran: str = "veteran", mpg: str = "mpg", n_groups: str = "n_groups", games: str = "n_events", min_mpg: float = 15.0, single_group: bool = True) -> Column:
    ok = F.col(veteran) & (F.col(mpg) >= min_mpg) & (F.col(games) > 0)
    return ok & (F.col(n_groups) == 1) if single_group else ok


def in_cohort(kind: str = "lead", *, block: float = 0.25, health: float = 0.75, min_tail: int = 15, universe: Column | None = None) -> Column:
    """A long absence block and then a healthy tail, on the columns of ``absence_profile``."""
    n, gp = F.col("n_events"), F.col("gp")
    if kind == "lead":
        length, tail, outside, shape = F.col("first_idx"), n - F.col("first_idx"), n - F.col("first_idx"), gp > 0
    elif kind == "mid":
        length, tail, outside = F.col("block_len"), F.col("block_tail"), n - F.col("block_len")
        shape = (F.col("block_len") > 0) & (F.col("first_idx") < F.col("block_start"))
    else:
        raise ValueError(f"unknown cohort kind {kind!r}")
    share = F.when(outside > 0, gp / outside).otherwise(0.0)
    return (universe if universe is not None else F.lit(True)) & shape & (length >= block * n) & (tail >= min_tail) & (share >= health)


def control_pool(universe: Column, cohort: Column, *, spread_share: float | None = 0.60) -> Column:
    pool = universe & ~cohort
    return pool if spread_share is None else pool & (F.col("missed") > 0) & (F.col("longest_run") <= spread_share * F.col("missed"))


def nearest_controls(cases: DataFrame, pool: DataFrame, *, group: list[str], value: str, entity: str, k: int, caliper: float) -> DataFrame:
    """(case_id, control_id, dist): up to ``k`` nearest controls of each case by one measure, within the caliper, with replacement.

    No case is paired with its whole group. Distinct control values are numbered in order; a case looks up the k values on either
    side of its own place. Controls that share a value are limited to the k lowest ids, the most a case can use. Exact.
    """
    ctl = pool.where(F.col(value).isNotNull()).select(*group, F.col(entity).alias("control_id"), F.col(value).alias("_v"))
    ctl = top_k(ctl, group + ["_v"], [asc("control_id")], k, "_same")
    values = with_row_number(ctl.select(*group, "_v").distinct(), group, [asc("_v")], "_place")
    own = cases.where(F.col(value).isNotNull()).select(*group, F.col(entity).alias("case_id"), F.col(value).alias("_v"))
    # number of distinct control values at or below each case value, by a running count over both lists
    marks = values.select(*group, "_v", F.lit(1).alias("_is"), F.lit(0).alias("_k")).unionByName(own.select(*group, "_v").distinct().select(*group, "_v", F.lit(0).alias("_is"), F.lit(1).alias("_k")))
    places = with_running_sum(marks, group, [asc("_v"), asc("_k")], F.col("_is"), "_at").where(F.col("_k") == 1).select(*group, "_v", "_at")
    near = own.join(places, group + ["_v"]).withColumn("_place", F.explode(F.sequence(F.col("_at") - (k - 1), F.col("_at") + k)))
    found = near.join(values.select(*group, "_place", F.col("_v").alias("_cv")), group + ["_place"])
    found = found.withColumn("dist", F.abs(F.col("_v") - F.col("_cv"))).where(F.col("dist") <= caliper)
    pairs = found.join(ctl.select(*group, F.col("_v").alias("_cv"), "control_id"), group + ["_cv"])
    return top_k(pairs.withColumn("_d", F.round("dist", 6)), ["case_id"], [asc("_d"), asc("control_id")], k, "_rk").select("case_id", "control_id", "dist")


def nearest_controls_multi(cases: DataFrame, pool: DataFrame, *, group: list[str], calipers: dict[str, float], entity: str, k: int) -> DataFrame:
    """The same with several measures: distance is the sum of squared caliper-scaled differences, each within its caliper.

    Both sides are placed in cells one caliper wide; a case looks at its own cell and the cells around it, so pairs form only
    inside that neighbourhood. Controls equal in every measure are limited to the k lowest ids.
    """
    names = list(calipers)
    scaled = lambda df, p: df.select(*group, F.col(entity).alias(p + "id"), *[(F.col(c) / F.lit(w)).alias(p + c) for c, w in calipers.items()]).dropna()     # noqa: E731
    ctl = top_k(scaled(pool, "c_"), group + ["c_" + c for c in names], [asc("c_id")], k, "_same").drop("_same")
    ctl = ctl.select("*", *[F.floor("c_" + c).alias("_cell_" + c) for c in names])
    own = scaled(cases, "a_")
    for c in names:
        own = own.withColumn("_cell_" + c, F.explode(F.sequence(F.floor("a_" + c) - 1, F.floor("a_" + c) + 1)))
    pairs = own.join(ctl, group + ["_cell_" + c for c in names])
    diffs = [F.col("a_" + c) - F.col("c_" + c) for c in names]
    inside = reduce(lambda x, y: x & y, [F.abs(d) <= 1.0 for d in diffs])
    dist = reduce(lambda x, y: x + y, [d * d for d in diffs])
    near = pairs.where(inside).select(F.col("a_id").alias("case_id"), F.col("c_id").alias("control_id"), dist.alias("dist"))
    return top_k(near, ["case_id"], [asc("dist"), asc("control_id")], k, "_rk").drop("_rk")

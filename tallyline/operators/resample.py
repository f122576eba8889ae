"""Bootstrap intervals from hashed Poisson(1) weights: every row draws its weight for replicate b on its own, so replicates are
weighted sums that combine on the map side and repeat exactly, whatever the partitioning. Intervals agree with multinomial
resampling in distribution, not draw by draw."""

from __future__ import annotations

from math import exp, factorial

from pyspark.sql import Column, DataFrame, functions as F

from tallyline.operators.ranking import asc, with_row_number

MAX_WEIGHT = 8
_CUMULATIVE = [sum(exp(-1) / factorial(j) for j in range(k + 1)) for k in range(MAX_WEIGHT)]
_UNIT = float(1 << 53)


def uniform(seed: Column | int, *key: Column) -> Column:
    """A number in [0, 1) fixed by seed and key."""
    s = seed if isinstance(seed, Column) else F.lit(int(seed))
    return F.pmod(F.xxhash64(s, *key), F.lit(1 << 53)) / F.lit(_UNIT)


def poisson_weight(u: Column) -> Column:
    """Poisson(1) count for a uniform draw."""
    out = F.lit(MAX_WEIGHT)
    for k in range(MAX_WEIGHT - 1, -1, -1):
        out = F.when(u < _CUMULATIVE[k], F.lit(k)).otherwise(out)
    return out


def weighted_replicates(df: DataFrame, unit: list[str], *, n_boot: int, seed: int = 0) -> DataFrame:
    """Every row once per replicate ``b`` with its unit's weight ``w``; zero weights are dropped. Aggregate by ``b`` right away."""
    if n_boot < 1:
        raise ValueError("n_boot must be at least 1")
    out = df.withColumn("b", F.explode(F.sequence(F.lit(1), F.lit(n_boot))))
    return out.withColumn("w", poisson_weight(uniform(seed, F.col("b"), *[F.col(c) for c in unit]))).where(F.col("w") > 0)


def percentile_interval(reps: DataFrame, group: list[str], value: str, *, level: float = 0.95) -> DataFrame:
    """(group, lo, hi, se, p_le_zero, n_reps). One row per replicate goes in, so the percentile is over n_boot numbers."""
    if not 0 < level < 1:
        raise ValueError("level must be between 0 and 1")
    alpha = (1 - level) / 2
    ok = reps.where(F.col(value).isNotNull())
    return ok.groupBy(*group).agg(F.percentile(value, F.lit(alpha)).alias("lo"), F.percentile(value, F.lit(1 - alpha)).alias("hi"),
                                  F.stddev_samp(value).alias("se"), ((1 + F.count_if(F.col(value) <= 0)) / (F.count(F.lit(1)) + 1)).alias("p_le_zero"),
                                  F.count(F.lit(1)).alias("n_reps"))


def _with_estimate(estimate: DataFrame, interval: DataFrame, group: list[str]) -> DataFrame:
    if group:
        return estimate.join(interval, group, "left")
    box = interval.select(F.struct(*interval.columns).alias("i")).scalar()
    return estimate.select("*", *[box[c].alias(c) for c in interval.columns])


def mean_interval(df: DataFrame, value: str, unit: list[str], *, strata: list[str] | None = None, group: list[str] | None = None, n_boot: int = 1000,
                  seed: int = 0, level: float = 0.95) -> DataFrame:
    """(group, estimate, lo, hi, ...): mean over strata of the stratum means of ``value``, resampling ``unit`` within strata."""
    group, strata = group or [], strata or []
    base = df.where(F.col(value).isNotNull()).groupBy(*group, *strata, *[u for u in unit if u not in strata + group]).agg(
        F.sum(value).alias("_s"), F.count(F.lit(1)).alias("_n"))
    per = base.groupBy(*group, *strata).agg((F.sum("_s") / F.sum("_n")).alias("_m"))
    estimate = per.groupBy(*group).agg(F.avg("_m").alias("estimate"))
    reps = weighted_replicates(base, [*strata, *unit], n_boot=n_boot, seed=seed)
    reps = reps.groupBy(*group, *strata, "b").agg((F.sum(F.col("w") * F.col("_s")) / F.sum(F.col("w") * F.col("_n"))).alias("_m"))
    reps = reps.groupBy(*group, "b").agg(F.avg("_m").alias("_stat"))
    return _with_estimate(estimate, percentile_interval(reps, group, "_stat", level=level), group)


def ratio_interval(df: DataFrame, num: str, den: str, cluster: list[str], *, strata: list[str] | None = None, n_boot: int = 1000, seed: int = 0,
                   level: float = 0.95) -> DataFrame:
    """Cluster bootstrap of sum(num)/sum(den), averaged over strata. Clusters are summed before they are resampled."""
    strata = strata or []
    clusters = df.groupBy(*strata, *[c for c in cluster if c not in strata]).agg(F.sum(num).alias("_num"), F.sum(den).alias("_den"))
    per = clusters.groupBy(*strata).agg((F.sum("_num") / F.sum("_den")).alias("_m"))
    estimate = per.agg(F.avg("_m").alias("estimate"))
    reps = weighted_replicates(clusters, [*strata, *cluster], n_boot=n_boot, seed=seed)
    reps = reps.groupBy(*strata, "b").agg(F.try_divide(F.sum(F.col("w") * F.col("_num")), F.sum(F.col("w") * F.col("_den"))).alias("_m"))
    reps = reps.groupBy("b").agg(F.avg("_m").alias("_stat"))
    return _with_estimate(estimate, percentile_interval(reps, [], "_stat", level=level), [])


def period_interval(metrics: DataFrame, period: str, value: str, *, n_boot: int = 1000, seed: int = 0, level: float = 0.95) -> DataFrame:
    """Resample whole periods (with replacement, as many as there are) and average their metric. For rank metrics, where an entity
    drawn twice would fill two of the k places. ``metrics`` has one row per period, so its periods fit an array."""
    box = metrics.where(F.col(value).isNotNull()).agg(F.sort_array(F.collect_list(F.struct(F.col(period).alias("p"), F.col(value).cast("double").alias("v")))).alias("m"))
    draws = box.select("m", F.size("m").alias("n"), F.explode(F.sequence(F.lit(1), F.lit(n_boot))).alias("b"))
    pick = F.transform(F.sequence(F.lit(1), F.col("n")), lambda j: F.element_at("m", (F.floor(uniform(seed, F.col("b"), j) * F.col("n")) + 1).cast("int"))["v"])
    reps = draws.where(F.col("n") > 0).select("b", (F.aggregate(pick, F.lit(0.0), lambda a, x: a + x) / F.col("n")).alias("_stat"))
    return _with_estimate(metrics.agg(F.avg(value).alias("estimate")), percentile_interval(reps, [], "_stat", level=level), [])


def paired_improvement(df: DataFrame, err_a: Column, err_b: Column, unit: list[str], *, strata: list[str] | None = None, n_boot: int = 1000, seed: int = 0,
                       level: float = 0.95) -> DataFrame:
    """Interval of mean(err_a - err_b): positive means B is better. Both errors of a row share its weight."""
    return mean_interval(df.withColumn("_gain", err_a - err_b), "_gain", unit, strata=strata, n_boot=n_boot, seed=seed, level=level)


def slope_replicates(df: DataFrame, x: str, y: str, unit: list[str], *, n_boot: int, seed: int = 0) -> DataFrame:
    """(b, slope): least-squares slope of every replicate from weighted sums."""
    reps = weighted_replicates(df, unit, n_boot=n_boot, seed=seed).groupBy("b").agg(
        F.sum("w").alias("n"), F.sum(F.col("w") * F.col(x)).alias("sx"), F.sum(F.col("w") * F.col(y)).alias("sy"),
        F.sum(F.col("w") * F.col(x) * F.col(x)).alias("sxx"), F.sum(F.col("w") * F.col(x) * F.col(y)).alias("sxy"))
    den = F.col("n") * F.col("sxx") - F.col("sx") * F.col("sx")
    return reps.select("b", F.when(den != 0, (F.col("n") * F.col("sxy") - F.col("sx") * F.col("sy")) / den).alias("slope"))


def shuffled_pairing(df: DataFrame, strata: list[str], value: str, unit: list[str], *, seed: int = 0, name: str = "shuffled") -> DataFrame:
    """``value`` permuted within strata by a hash order: both sides are numbered and joined on the number."""
    keyed = df.withColumn("_h1", uniform(seed, *[F.col(u) for u in unit])).withColumn("_h2", uniform(seed + 1, *[F.col(u) for u in unit]))
    order = [asc(u) for u in unit]
    left = with_row_number(keyed, strata, [asc("_h1"), *order], "_i")
    right = with_row_number(keyed, strata, [asc("_h2"), *order], "_i").select(*strata, "_i", F.col(value).alias(name))
    return left.join(right, strata + ["_i"]).drop("_i", "_h1", "_h2")


# 97.5% points of the t distribution for 1 to 30 degrees of freedom.
T_975 = (12.706, 4.303, 3.182, 2.776, 2.571, 2.447, 2.365, 2.306, 2.262, 2.228, 2.201, 2.179, 2.160, 2.145, 2.131, 2.120, 2.110, 2.101, 2.093, 2.086,
         2.080, 2.074, 2.069, 2.064, 2.060, 2.056, 2.052, 2.048, 2.045, 2.042)


def t_interval(df: DataFrame, value: str, group: list[str] | None = None) -> DataFrame:
    """(group, mean, lo, hi, n, n_positive): 95% t interval of a per-period difference; no interval below two periods."""
    n = F.count(value)
    t = F.element_at(F.array(*[F.lit(x) for x in T_975]), F.least(F.greatest(n - 1, F.lit(1)), F.lit(30)).cast("int"))
    half = F.when(n >= 2, t * F.stddev_samp(value) / F.sqrt(n))
    return df.groupBy(*(group or [])).agg(F.avg(value).alias("mean"), (F.avg(value) - half).alias("lo"), (F.avg(value) + half).alias("hi"),
                                          n.alias("n"), F.count_if(F.col(value) > 0).alias("n_positive"))

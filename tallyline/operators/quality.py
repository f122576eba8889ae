"""Data-quality audits, each one or two partially aggregated passes."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F


def _union(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


def inventory(tables: dict[str, tuple[DataFrame, Column | None]]) -> DataFrame:
    """(table_name, n_rows, n_periods, first_period, last_period)."""
    out = []
    for name, (df, period) in tables.items():
        p = F.lit(None).cast("int") if period is None else period
        out.append(df.agg(F.lit(name).alias("table_name"), F.count(F.lit(1)).alias("n_rows"), F.countDistinct(p).alias("n_periods"),
                          F.min(p).alias("first_period"), F.max(p).alias("last_period")))
    return _union(out)


def orphan_report(left: DataFrame, right: DataFrame, key: list[str], *, left_name: str, right_name: str, mismatches: dict[str, Column] | None = None) -> DataFrame:
    """(problem, n): keys on one side only, and matched rows that break a rule. One join feeds every count."""
    marked_l, marked_r = left.withColumn("_l", F.lit(True)), right.withColumn("_r", F.lit(True))
    both = marked_l.join(marked_r, key, "full")
    has_l, has_r = F.col("_l").isNotNull(), F.col("_r").isNotNull()
    counts = {left_name: has_l & ~has_r, right_name: has_r & ~has_l}
    counts |= {n: has_l & has_r & F.coalesce(c, F.lit(False)) for n, c in (mismatches or {}).items()}
    one = both.agg(*[F.count_if(c).alias(n) for n, c in counts.items()])
    rows = F.array(*[F.struct(F.lit(n).alias("problem"), F.col(f"`{n}`").alias("n")) for n in counts])
    return one.select(F.explode(rows).alias("x")).select("x.problem", "x.n")


def crosscheck(primary: DataFrame, secondary: DataFrame, key: list[str], tolerances: dict[str, float]) -> DataFrame:
    """(only_left, only_right, <column>_mismatch): two sources compared field by field."""
    a = primary.select(*key, F.lit(True).alias("_l"), *tolerances)
    b = secondary.select(*key, F.lit(True).alias("_r"), *[F.col(c).alias("_b_" + c) for c in tolerances])
    j = a.join(b, key, "full")
    both = F.col("_l").isNotNull() & F.col("_r").isNotNull()
    return j.agg(F.count_if(F.col("_r").isNull()).alias("only_left"), F.count_if(F.col("_l").isNull()).alias("only_right"),
                 *[F.count_if(both & F.coalesce(F.abs(F.col(c) - F.col("_b_" + c)) > tol, F.col(c).isNull() != F.col("_b_" + c).isNull())).alias(c + "_mismatch")
                   for c, tol in tolerances.items()])


def group_totals_mismatch(details: DataFrame, totals: DataFrame, key: list[str], value: str, *, period: str | None = None, tolerance: float = 0.0) -> DataFrame:
    """Keys whose detail rows do not add up to the total row."""
    s = details.groupBy(*key).agg(F.sum(value).alias("detail_sum"))
    j = totals.select(*key, *([period] if period and period not in key else []), F.col(value).alias("total")).join(s, key)
    return j.where(F.abs(F.col("detail_sum") - F.col("total")) > tolerance)


def key_collisions(df: DataFrame, id_col: str, name_col: str) -> DataFrame:
    """Names shared by several ids, and how many."""
    pairs = df.select(id_col, name_col).distinct()
    return pairs.groupBy(name_col).agg(F.count(F.lit(1)).alias("n_ids")).where(F.col("n_ids") > 1)


def group_size_violations(df: DataFrame, key: list[str], expected: int) -> DataFrame:
    """Keys without exactly ``expected`` rows."""
    return df.groupBy(*key).agg(F.count(F.lit(1)).alias("n_rows")).where(F.col("n_rows") != expected)


def null_shares(df: DataFrame, columns: list[str], *, weight: str | None = None) -> DataFrame:
    """(column_name, null_share, weighted_null_share) in one pass."""
    w = F.lit(1.0) if weight is None else F.col(weight).cast("double")
    one = df.agg(*[F.avg(F.col(c).isNull().cast("double")).alias("u_" + c) for c in columns],
                 *[(F.sum(F.when(F.col(c).isNull(), w).otherwise(0.0)) / F.sum(w)).alias("w_" + c) for c in columns])
    rows = F.array(*[F.struct(F.lit(c).alias("column_name"), F.col("u_" + c).alias("null_share"), F.col("w_" + c).alias("weighted_null_share")) for c in columns])
    return one.select(F.explode(rows).alias("x")).select("x.*")


def threshold_hits(df: DataFrame, rules: dict[str, tuple[str, float]]) -> DataFrame:
    """(rule, n_hits, highest) for implausibly high values."""
    one = df.agg(*[F.count_if(F.col(c) >= limit).alias("n_" + n) for n, (c, limit) in rules.items()], *[F.max(c).cast("double").alias("m_" + n) for n, (c, _) in rules.items()])
    rows = F.array(*[F.struct(F.lit(n).alias("rule"), F.col(f"`n_{n}`").alias("n_hits"), F.col(f"`m_{n}`").alias("highest")) for n in rules])
    return one.select(F.explode(rows).alias("x")).select("x.*")


def histogram(df: DataFrame, value: str, width: float) -> DataFrame:
    return df.where(F.col(value).isNotNull()).groupBy(F.floor(F.col(value) / width).alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def leaders(events: DataFrame, *, period: str, entity: str, value: str, min_events: int) -> DataFrame:
    """(period, leader, n, mean_value): best mean per period among entities with enough events, ties to the lower id."""
    per = events.groupBy(period, entity).agg(F.count(F.lit(1)).alias("n"), F.avg(value).alias("mean_value")).where(F.col("n") >= min_events)
    best = per.groupBy(period).agg(F.min_by(F.struct(entity, "n", "mean_value"), F.struct(-F.col("mean_value"), F.col(entity))).alias("b"))
    return best.select(period, F.col("b").getField(entity).alias("leader"), "b.n", "b.mean_value")


def check_facts(found: DataFrame, expected: dict[str, tuple[float, float]]) -> DataFrame:
    """(fact, expected, found, ok): a one-row frame of named numbers against expected values with a tolerance each."""
    rows = F.array(*[F.struct(F.lit(n).alias("fact"), F.lit(want).alias("expected"), F.col(f"`{n}`").alias("found"), (F.abs(F.col(f"`{n}`") - want) <= tol).alias("ok"))
                     for n, (want, tol) in expected.items()])
    return found.select(F.explode(rows).alias("x")).select("x.*")


def freshness(tables: dict[str, tuple[DataFrame, Column, int]], today: Column) -> DataFrame:
    """(table_name, age_days, stale) from each table's newest date and its allowed age."""
    return _union([df.agg(F.lit(n).alias("table_name"), F.datediff(today, F.max(day)).cast("long").alias("age_days"), (F.datediff(today, F.max(day)) > limit).alias("stale"))
                   for n, (df, day, limit) in tables.items()])


def wiped_partitions(df: DataFrame, partition: str, value: str, *, real: Column, min_real: int) -> DataFrame:
    """(partition, n_rows, n_real, lowest, wiped): partitions that hold too few real values to trust."""
    n_real = F.count_if(F.coalesce(real, F.lit(False)))
    return df.groupBy(partition).agg(F.count(F.lit(1)).alias("n_rows"), n_real.alias("n_real"), F.min(value).alias("lowest"), (n_real < min_real).alias("wiped"))


def estimate_calibration(rows: DataFrame, estimate: str, exact: str, group: list[str] | None = None) -> DataFrame:
    """Error of an estimate where the exact value is known too."""
    e = F.col(estimate) - F.col(exact)
    ok = rows.where(F.col(estimate).isNotNull() & F.col(exact).isNotNull())
    return ok.groupBy(*(group or [])).agg(F.count(F.lit(1)).alias("n"), F.avg(e).alias("mean_error"), F.avg(F.abs(e)).alias("mean_abs_error"), F.max(F.abs(e)).alias("max_abs_error"))


def pooled_mean(reports: DataFrame, value: str, n: str) -> DataFrame:
    return reports.agg((F.sum(F.col(value) * F.col(n)) / F.sum(n)).alias("pooled"), F.sum(n).alias("n"))


def coverage_counts(df: DataFrame, group: list[str], status: str, values: list[str]) -> DataFrame:
    """(group, <value>...): rows per status as columns."""
    return df.groupBy(*group).agg(*[F.count_if(F.col(status) == v).alias(v) for v in values])


def report(parts: dict[str, DataFrame]) -> DataFrame:
    """Named audit tables as one (check, row) table."""
    return _union([p.select(F.lit(n).alias("check"), F.to_json(F.struct(*p.columns)).alias("row")) for n, p in parts.items()])

"""Ranks, cumulative counts and levels that do not depend on one task holding a whole group.

A plain window sends a group to one task. Here a cheap probe first counts rows per group (partially aggregated on the map
side). Groups above ``rows_per_task`` are cut into value ranges, the more the larger the group is; each range is ranked by its own task and
the counts of the earlier ranges are added. Groups below the limit, and so the usual case, run as one plain window with no extra shuffle.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql import types as T

ROWS_PER_TASK = 4_000_000
SMALL_INPUT_BYTES = 32 << 20
#: Plan steps whose size estimate doesn't grow with the rows that they make.
ROW_MAKERS = ("Generate", "Expand", "MapIn", "FlatMap")
#: Ranges of an oversized group, for each ``rows_per_task`` rows that it has.
RANGES = 2
SLICE = "_slice"
_ORDERED_AS_NUMBER = (T.NumericType, T.DateType, T.TimestampType, T.TimestampNTZType, T.BooleanType)


@dataclass(frozen=True)
class By:
    """One sort key."""

    name: str
    desc: bool = False

    def sort(self) -> Column:
        return F.col(self.name).desc_nulls_last() if self.desc else F.col(self.name).asc_nulls_last()


def desc(name: str) -> By:
    return By(name, True)


def asc(name: str) -> By:
    return By(name, False)


def surely_small(df: DataFrame) -> bool:
    """Whether the probe isn't worth its job: the optimizer's size is small, and no step makes more rows than that size tells of."""
    plan = df._jdf.queryExecution().optimizedPlan()
    return int(str(plan.stats().sizeInBytes())) < SMALL_INPUT_BYTES and not any(step in plan.toString() for step in ROW_MAKERS)


def _as_number(df: DataFrame, key: By) -> Column | None:
    """A number that rises (not strictly) along the sort order, nulls last; None when the type has none."""
    kind = df.schema[key.name].dataType
    if not isinstance(kind, _ORDERED_AS_NUMBER):
        return None
    col = F.col(key.name)
    if isinstance(kind, T.DateType):
        col = F.unix_date(col)
    elif isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        col = F.unix_micros(col.cast("timestamp"))
    number = col.cast("double")
    return F.coalesce(-number if key.desc else number, F.lit(float("inf")))


def _cut(df: DataFrame, group: list[str], key: By, slice_name: str, rows_per_task: int) -> DataFrame | None:
    """``df`` with ``slice_name`` numbering the value ranges of ``key`` in oversized groups; None when no group is oversized."""
    number = _as_number(df, key)
    if number is None:
        return None
    sized = df.groupBy(*group).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > rows_per_task)
    largest = sized.agg(F.max("_n")).first()[0]                                       # one number
    if largest is None:
        return None
    cuts = max(2, -(-RANGES * largest // rows_per_task))
    points = ", ".join(f"{i / cuts!r}D" for i in range(1, cuts))
    hot = (df.withColumn("_num", number).groupBy(*group).agg(F.count(F.lit(1)).alias("_n"), F.expr(f"percentile_approx(_num, array({points}), {cuts * 20})").alias("_cuts"))
           .where(F.col("_n") > rows_per_task).withColumn("_of", F.ceil(F.col("_n") * RANGES / rows_per_task).cast("int"))
           .select(*group, F.array_distinct(F.expr(f"transform(sequence(1, greatest(_of, 2) - 1), i -> element_at(_cuts, greatest(1, cast(floor(i * {cuts}L / _of) as int))))")).alias("_cuts")))
    # RANGES * (all rows / rows_per_task) numbers at most, over all groups listed.
    rows = hot.collect()
    listed = df.sparkSession.createDataFrame(rows, hot.schema)
    at = F.when(F.col("_cuts").isNull(), F.lit(0)).otherwise(F.size(F.filter(F.col("_cuts"), lambda c: c < F.col("_num"))))
    joined = df.withColumn("_num", number)
    if group:
        on = [joined[g].eqNullSafe(listed[g]) for g in group]
        cond = on[0]
        for more in on[1:]:
            cond = cond & more
        joined = joined.join(F.broadcast(listed), cond, "left").select(*[joined[c] for c in joined.columns], listed["_cuts"])
    else:
        joined = joined.withColumn("_cuts", F.array(*[F.lit(c) for c in rows[0]["_cuts"]]))
    return joined.withColumn(slice_name, at.cast("int")).drop("_num", "_cuts")


def slice_groups(df: DataFrame, group: list[str], order: list[By], rows_per_task: int = ROWS_PER_TASK) -> tuple[DataFrame, list[str]]:
    """``df`` plus the slice columns that were needed: one for the first key, one more for ties of it split by the second."""
    if rows_per_task >= ROWS_PER_TASK and surely_small(df):
        return df, []
    sliced = _cut(df, group, order[0], SLICE, rows_per_task)
    if sliced is None:
        return df, []
    names = [SLICE]
    if len(order) > 1:
        # A slice that is still oversized holds ties of the first key: cut those by the second key.
        ties = _cut(sliced, group + [SLICE, order[0].name], order[1], SLICE + "_tie", rows_per_task)
        if ties is not None:
            return ties, names + [order[0].name, SLICE + "_tie"]
    return sliced, names


def _before(df: DataFrame, group: list[str], slices: list[str], order: list[By], total: Column, name: str) -> DataFrame:
    """Sum of ``total`` over the earlier slices of each group. One row per slice: bounded by groups and RANGES * (rows / rows_per_task)."""
    sums = df.groupBy(*group, *slices).agg(total.alias("_in_slice"))
    w = Window.partitionBy(*group).orderBy(*[_slice_sort(s, order) for s in slices]).rowsBetween(Window.unboundedPreceding, -1)
    return sums.select(*group, *slices, F.coalesce(F.sum("_in_slice").over(w), F.lit(0)).alias(name))


def _slice_sort(name: str, order: list[By]) -> Column:
    for key in order:
        if key.name == name:
            return key.sort()
    return F.col(name).asc()


def _join_slices(df: DataFrame, before: DataFrame, keys: list[str]) -> DataFrame:
    renamed = before.select(*[F.col(k).alias("_k_" + k) for k in keys], *[c for c in before.columns if c not in keys])
    cond = F.lit(True)
    for k in keys:
        cond = cond & df[k].eqNullSafe(renamed["_k_" + k])
    return df.join(renamed, cond, "left").drop(*["_k_" + k for k in keys])


def with_row_number(df: DataFrame, group: list[str], order: list[By], name: str = "rank", *, rows_per_task: int = ROWS_PER_TASK) -> DataFrame:
    """1-based position in ``order`` (which should end in a unique key) within each group."""
    sliced, slices = slice_groups(df, group, order, rows_per_task)
    w = Window.partitionBy(*group, *slices).orderBy(*[k.sort() for k in order])
    out = sliced.withColumn(name, F.row_number().over(w))
    if not slices:
        return out
    before = _before(sliced, group, slices, order, F.count(F.lit(1)), "_before")
    out = _join_slices(out, before, group + slices)
    return out.withColumn(name, (F.col(name) + F.col("_before")).cast("int")).drop("_before", *[s for s in slices if s.startswith(SLICE)])


def with_tied_rank(df: DataFrame, group: list[str], key: By, name: str = "rank", *, method: str = "average",
                   rows_per_task: int = ROWS_PER_TASK) -> DataFrame:
    """Rank of ``key`` with ties sharing their average ('average'), lowest ('min') or dense ('dense') rank; null keys stay null."""
    if method not in ("average", "min", "dense"):
        raise ValueError(f"unknown tie method {method!r}")
    known = F.col(key.name).isNotNull()
    sliced, slices = slice_groups(df.where(known).select(*group, key.name), group, [key], rows_per_task)
    if not slices:
        w = Window.partitionBy(*group).orderBy(key.sort())
        if method == "dense":
            value = F.dense_rank().over(w)
        elif method == "min":
            value = F.rank().over(w)
        else:
            # rank from the top and from the bottom of the same window: their mean is the average rank.
            up = Window.partitionBy(*group).orderBy(By(key.name, not key.desc).sort())
            total = F.count(F.col(key.name)).over(Window.partitionBy(*group))
            value = (F.rank().over(w) + total - F.rank().over(up) + 1) / F.lit(2.0)
        return df.withColumn(name, F.when(known, value))
    # Oversized group: rank its distinct values (ties collapse before the shuffle), then join the ranks back.
    counts = sliced.groupBy(*group, key.name, *slices).agg(F.count(F.lit(1)).alias("_ties"))
    w = Window.partitionBy(*group, *slices).orderBy(key.sort()).rowsBetween(Window.unboundedPreceding, -1)
    step = F.lit(1) if method == "dense" else F.col("_ties")
    counts = counts.withColumn("_local", F.coalesce(F.sum(step).over(w), F.lit(0)))
    before = _before(counts, group, slices, [key], F.sum(step), "_before")
    ranked = _join_slices(counts, before, group + slices)
    first = F.col("_before") + F.col("_local") + 1
    value = first + (F.col("_ties") - 1) / F.lit(2.0) if method == "average" else first
    ranked = ranked.select(*group, key.name, value.alias(name))
    return _join_slices(df, ranked, group + [key.name])


def with_running_sum(df: DataFrame, group: list[str], order: list[By], value: Column, name: str, *,
                     rows_per_task: int = ROWS_PER_TASK) -> DataFrame:
    """Sum of ``value`` up to and including each row."""
    sliced, slices = slice_groups(df, group, order, rows_per_task)
    w = Window.partitionBy(*group, *slices).orderBy(*[k.sort() for k in order]).rowsBetween(Window.unboundedPreceding, 0)
    out = sliced.withColumn(name, F.sum(value).over(w))
    if not slices:
        return out
    before = _before(sliced, group, slices, order, F.sum(value), "_before")
    out = _join_slices(out, before, group + slices)
    return out.withColumn(name, F.col(name) + F.col("_before")).drop("_before", *[s for s in slices if s.startswith(SLICE)])


def with_running_max(df: DataFrame, group: list[str], order: list[By], value: Column, name: str, *,
                     rows_per_task: int = ROWS_PER_TASK) -> DataFrame:
    """Greatest ``value`` up to and including each row; nulls are passed over."""
    sliced, slices = slice_groups(df, group, order, rows_per_task)
    w = Window.partitionBy(*group, *slices).orderBy(*[k.sort() for k in order]).rowsBetween(Window.unboundedPreceding, 0)
    out = sliced.withColumn(name, F.max(value).over(w))
    if not slices:
        return out
    earlier = Window.partitionBy(*group).orderBy(*[_slice_sort(s, order) for s in slices]).rowsBetween(Window.unboundedPreceding, -1)
    tops = sliced.groupBy(*group, *slices).agg(F.max(value).alias("_top"))                       # one row per slice
    out = _join_slices(out, tops.select(*group, *slices, F.max("_top").over(earlier).alias("_before")), group + slices)
    return out.withColumn(name, F.greatest(F.col(name), F.col("_before"))).drop("_before", *[s for s in slices if s.startswith(SLICE)])


def top_k(df: DataFrame, group: list[str], order: list[By], k: int, name: str = "rank") -> DataFrame:
    """First ``k`` rows of each group. Spark limits each map task to k rows per group before the shuffle, so a hot group is safe."""
    if k < 1:
        raise ValueError("k must be positive")
    if not group:
        head = df.orderBy(*[key.sort() for key in order]).limit(k)
        return head.withColumn(name, F.row_number().over(Window.orderBy(*[key.sort() for key in order])))
    w = Window.partitionBy(*group).orderBy(*[key.sort() for key in order])
    return df.withColumn(name, F.row_number().over(w)).where(F.col(name) <= k)


def keep_first(df: DataFrame, key: list[str], order: list[By]) -> DataFrame:
    """One row per key: the first in ``order``."""
    return top_k(df, key, order, 1, "_first").drop("_first")


def exact_quantiles(df: DataFrame, group: list[str], value: str, probs: dict[str, float], *,
                    rows_per_task: int = ROWS_PER_TASK) -> DataFrame:
    """Linearly interpolated quantiles per group, one column per entry of ``probs``."""
    rows = df.where(F.col(value).isNotNull()).select(*group, F.col(value).cast("double").alias(value))
    sliced, slices = slice_groups(rows, group, [asc(value)], rows_per_task)
    if not slices:
        return rows.groupBy(*group).agg(*[F.percentile(value, F.lit(p)).alias(n) for n, p in probs.items()])
    # Oversized group: positions from distinct values and their counts, ranges ranked by separate tasks.
    counts = sliced.groupBy(*group, value, *slices).agg(F.count(F.lit(1)).alias("_n"))
    w = Window.partitionBy(*group, *slices).orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    counts = counts.withColumn("_upto", F.sum("_n").over(w))
    before = _before(counts, group, slices, [asc(value)], F.sum("_n"), "_before")
    placed = _join_slices(counts, before, group + slices)
    placed = placed.withColumn("_last", F.col("_before") + F.col("_upto")).withColumn("_first", F.col("_last") - F.col("_n") + 1)
    if group:
        placed = _join_slices(placed, rows.groupBy(*group).agg(F.count(F.lit(1)).alias("_total")), group)
    else:
        placed = placed.withColumn("_total", F.lit(rows.count()))

    def at(position: Column) -> Column:
        return F.max(F.when((F.col("_first") <= position) & (F.col("_last") >= position), F.col(value)))

    aggs = []
    for name, p in probs.items():
        pos = (F.col("_total") - 1) * F.lit(float(p)) + 1
        aggs += [at(F.floor(pos)).alias("_lo_" + name), at(F.ceil(pos)).alias("_hi_" + name), F.max(pos - F.floor(pos)).alias("_w_" + name)]
    wide = placed.groupBy(*group).agg(*aggs)
    return wide.select(*group, *[(F.col("_lo_" + n) + (F.col("_hi_" + n) - F.col("_lo_" + n)) * F.col("_w_" + n)).alias(n) for n in probs])

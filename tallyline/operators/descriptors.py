"""What is known of an entity before a period, for all periods at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from tallyline.functions.scoring import clip


def period_summaries(events: DataFrame, *, entity: str, period: str, event: str, value: str, group: str, day: str) -> DataFrame:
    """(entity, period, games, rate, first_group, last_group): one row per entity and period with an event; the first and last group by day, then event."""
    at = F.struct(F.col(day), F.col(event))
    known = F.col(group).isNotNull()
    return events.where(F.col(entity).isNotNull() & F.col(period).isNotNull()).groupBy(entity, period).agg(
        F.countDistinct(event).alias("games"), F.sum(value).alias("_sum"), F.min_by(group, F.when(known, at)).alias("first_group"), F.max_by(group, F.when(known, at)).alias("last_group")
    ).withColumn("rate", F.try_divide("_sum", "games")).drop("_sum")


def period_descriptors(keys: DataFrame, summaries: DataFrame, *, entity: str, period: str, length: float, runup: DataFrame | None = None, min_runup: int = 2) -> DataFrame:
    """(entity, period, earlier, prior_share, prior_rate, changed_group, delta) for each of ``keys`` (entity, period).

    ``earlier`` counts the entity's earlier periods with an event; the prior ones are those of the period just before, null if it had none there. ``changed_group``: this
    period's first group is known and isn't the prior period's last. ``delta``: the rate of ``runup`` (entity, period, games, rate) over ``min_runup`` games or more, less
    the prior rate. Keys without any event of their own count too. Keys and summaries are merged in one window per entity, whose rows the calendar bounds: no join for each period.
    """
    mine = keys.select(entity, period).distinct().withColumn("_asked", F.lit(True))
    both = mine.join(summaries, [entity, period], "full_outer")
    has = F.col("games").isNotNull()
    before = Window.partitionBy(entity).orderBy(period).rowsBetween(Window.unboundedPreceding, -1)
    seen = both.withColumn("earlier", F.count_if(has).over(before)).withColumn(
        "_prior", F.last(F.when(has, F.struct(F.col(period).alias("at"), "games", "rate", "last_group")), ignorenulls=True).over(before))
    prior: Column = F.when(F.col("_prior.at") == F.col(period) - 1, F.col("_prior"))
    out = seen.where("_asked").withColumn("_prior", prior)
    if runup is not None:
        out = out.join(runup.select(entity, period, F.col("games").alias("_n"), F.col("rate").alias("_r")), [entity, period], "left")
    else:
        out = out.withColumn("_n", F.lit(None).cast("long")).withColumn("_r", F.lit(None).cast("double"))
    return out.select(entity, period, F.col("earlier").cast("long").alias("earlier"), clip(F.col("_prior.games") / F.lit(float(length)), 0.0, 1.0).alias("prior_share"), F.col("_prior.rate").alias("prior_rate"),
                      F.coalesce(F.col("first_group") != F.col("_prior.last_group"), F.lit(False)).alias("changed_group"), F.when(F.col("_n") >= min_runup, F.col("_r") - F.col("_prior.rate")).alias("delta"))

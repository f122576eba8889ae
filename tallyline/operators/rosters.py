"""Context of an entity inside its group: shares, crowding, moves between groups, leaders and playing style."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from tallyline.operators.ranking import desc, top_k
from tallyline.operators.sequences import Roles, primary_group


def roster_panel(logs: DataFrame, groups: DataFrame, r: Roles = Roles(), *, minutes: str = "min", crowd_mpg: float = 15.0) -> DataFrame:
    """(entity, period): ``pace`` of the primary group, ``role_share`` of its minutes, and ``pos_crowding``, the number of other
    members of the same class with at least ``crowd_mpg``. ``groups`` maps entity to class (``pos_group``)."""
    seen = logs.select(r.entity, r.period, r.group, r.event).distinct()
    primary = primary_group(seen, r)
    poss = F.col("fga") - F.col("oreb") + F.col("tov") + F.lit(0.44) * F.col("fta")
    per_event = logs.groupBy(r.group, r.period, r.event).agg(F.sum(poss).alias("_poss"), F.sum(minutes).alias("_min"))
    per_group = per_event.groupBy(r.group, r.period).agg(F.avg("_poss").alias("pace"), F.avg("_min").alias("_group_min"))
    member = logs.groupBy(r.entity, r.period, r.group).agg(F.sum(minutes).alias("_m"), F.count(F.lit(1)).alias("_n"))
    member = member.join(groups.select(r.entity, "pos_group").dropDuplicates([r.entity]), r.entity, "left").na.fill({"pos_group": "U"})
    regular = F.col("_m") / F.col("_n") >= crowd_mpg
    crowd = member.where(regular).groupBy(r.group, r.period, "pos_group").agg(F.count(F.lit(1)).alias("_regulars"))
    member = member.join(crowd, [r.group, r.period, "pos_group"], "left")
    member = member.select(r.entity, r.period, r.group, (F.coalesce(F.col("_regulars"), F.lit(0)) - regular.cast("long")).alias("pos_crowding"))
    own = logs.groupBy(r.entity, r.period).agg((F.sum(minutes) / F.count(F.lit(1))).alias("_mpg"))
    out = primary.join(per_group, [r.group, r.period], "left").join(own, [r.entity, r.period]).join(member, [r.entity, r.period, r.group], "left")
    return out.select(r.entity, r.period, r.group, "pace", (F.col("_mpg") / (F.col("_group_min") / 5)).alias("role_share"), "pos_crowding")


def dated_moves(transactions: DataFrame, *, period: str = "s") -> DataFrame:
    """Moves known before the season they count for: dated before 1 October of its start year."""
    return transactions.where(F.col("txn_date") < F.make_date(F.col(period), F.lit(10), F.lit(1)))


def incoming_group(transactions: DataFrame, *, entity: str = "player_id", period: str = "s", group: str = "team_id") -> DataFrame:
    """(entity, period, in_group): destination of the newest arrival, ties to the higher group id."""
    arrivals = dated_moves(transactions, period=period).where(F.col("direction") == "in")
    return arrivals.groupBy(entity, period).agg(F.max_by(group, F.struct("txn_date", group)).alias("in_group"))


def transaction_features(rows: DataFrame, shares: DataFrame, transactions: DataFrame, r: Roles = Roles()) -> DataFrame:
    """``changed_team`` and ``team_departures_lost`` (last period's share of everyone leaving the resolved group, self excluded).

    ``shares``: (entity, period, group, role_share). The self exclusion is a subtraction, not a pairwise join.
    """
    last = shares.select(F.col(r.entity), (F.col(r.period) + 1).alias(r.period), F.col(r.group).alias("_prev"), F.coalesce("role_share", F.lit(0.0)).alias("_w"))
    out_moves = dated_moves(transactions, period=r.period).where(F.col("direction") == "out").select(r.entity, r.period, r.group)
    weighted = out_moves.join(last.drop("_prev"), [r.entity, r.period], "left").na.fill({"_w": 0.0})
    lost = weighted.groupBy(F.col(r.group).alias("_team"), r.period).agg(F.sum("_w").alias("_lost"))
    own = weighted.groupBy(r.entity, r.period, F.col(r.group).alias("_team")).agg(F.sum("_w").alias("_own"))
    out = rows.join(last.drop("_w"), [r.entity, r.period], "left").join(incoming_group(transactions, entity=r.entity, period=r.period, group=r.group), [r.entity, r.period], "left")
    out = out.withColumn("_team", F.coalesce("in_group", "_prev"))
    changed = F.when(F.col("_prev").isNull(), F.col("in_group").isNotNull()).otherwise(F.col("_team") != F.col("_prev"))
    out = out.join(lost, ["_team", r.period], "left").join(own, [r.entity, r.period, "_team"], "left")
    return out.select(*rows.columns, changed.cast("double").alias("changed_team"),
                      (F.coalesce("_lost", F.lit(0.0)) - F.coalesce("_own", F.lit(0.0))).alias("team_departures_lost"))


def closing_uplift(closing: DataFrame, regular: DataFrame, r: Roles = Roles(), *, minutes: str = "min", last: int = 5, min_events: int = 5,
                   max_regular: float = 28.0) -> DataFrame:
    """(entity, period, uplift): mean minutes of the last events of the closing stage above the regular mean, for role players."""
    base = regular.groupBy(r.entity, r.period).agg(F.avg(minutes).alias("_base")).where(F.col("_base") < max_regular)
    n = closing.groupBy(r.entity, r.period).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= min_events)
    head = top_k(closing, [r.entity, r.period], [desc(r.day), desc(r.event)], last, "_k")
    late = head.groupBy(r.entity, r.period).agg(F.avg(minutes).alias("_late"))
    return late.join(n, [r.entity, r.period]).join(base, [r.entity, r.period]).select(
        r.entity, r.period, F.greatest(F.lit(0.0), F.col("_late") - F.col("_base")).alias("uplift"))


def depth_features(rows: DataFrame, prior_minutes: DataFrame, transactions: DataFrame, closing_uplift: DataFrame, r: Roles = Roles(), *,
                   low: float = 8.0, high: float = 30.0) -> DataFrame:
    """``open_net`` (minutes leaving minus arriving at the entity's group, self excluded) and ``po_uplift``, in tens of minutes.

    ``prior_minutes``: (entity, period, group, mpg) of the period before; ``closing_uplift``: (entity, period, uplift).
    """
    last = prior_minutes.select(F.col(r.entity), (F.col(r.period) + 1).alias(r.period), F.col(r.group).alias("_prev"), F.col("mpg").alias("_mpg"))
    moves = dated_moves(transactions, period=r.period).select(r.entity, r.period, F.col(r.group).alias("_team"), "direction")
    signed = moves.join(last.drop("_prev"), [r.entity, r.period], "left").select(
        r.entity, r.period, "_team", (F.coalesce("_mpg", F.lit(0.0)) * F.when(F.col("direction") == "out", 1.0).otherwise(-1.0)).alias("_w"))
    net = signed.groupBy("_team", r.period).agg(F.sum("_w").alias("_net"))
    own = signed.groupBy(r.entity, r.period, "_team").agg(F.sum("_w").alias("_own"))
    uplift = closing_uplift.select(F.col(r.entity), (F.col(r.period) + 1).alias(r.period), "uplift")
    out = rows.join(last, [r.entity, r.period], "left").join(incoming_group(transactions, entity=r.entity, period=r.period, group=r.group), [r.entity, r.period], "left")
    out = out.withColumn("_team", F.col("_prev")).join(net, ["_team", r.period], "left").join(own, [r.entity, r.period, "_team"], "left")
    out = out.join(uplift, [r.entity, r.period], "left")
    stays = F.col("in_group").isNull() | (F.col("in_group") == F.col("_prev"))
    applies = stays & F.col("_mpg").between(low, high)
    opened = F.when(applies, (F.coalesce("_net", F.lit(0.0)) - F.coalesce("_own", F.lit(0.0))) / 10).otherwise(F.lit(0.0))
    return out.select(*rows.columns, F.coalesce(opened, F.lit(0.0)).alias("open_net"),
                      F.when(F.col("_mpg").isNotNull(), F.coalesce(F.col("uplift") / 10, F.lit(0.0))).otherwise(F.lit(0.0)).alias("po_uplift"))


def group_style(logs: DataFrame, r: Roles = Roles(), *, minutes: str = "min", rotation: float = 10.0, min_events: int = 20, min_members: int = 5,
                extra: dict[str, Column] | None = None) -> DataFrame:
    """(period, group): mean top-1 minutes, mean of the top five, rotation size, and each relative to the period's mean.

    The top five of an event come from an ordered array of its members' minutes; an event is one game, so the array is short.
    """
    per_event = logs.groupBy(r.period, r.group, r.event).agg(
        F.sort_array(F.collect_list(F.col(minutes).cast("double")), asc=False).alias("_m"), F.count(F.lit(1)).alias("_n"))
    top5 = F.slice("_m", 1, 5)
    per_event = per_event.where(F.col("_n") >= min_members).select(
        r.period, r.group, F.element_at("_m", 1).alias("star"),
        (F.aggregate(top5, F.lit(0.0), lambda a, x: a + x) / F.size(top5)).alias("top5"),
        F.size(F.filter("_m", lambda x: x >= rotation)).alias("depth10"))
    style = per_event.groupBy(r.period, r.group).agg(F.count(F.lit(1)).alias("games"), *[F.avg(c).alias(c) for c in ("star", "top5", "depth10")])
    if extra:
        style = style.join(logs.groupBy(r.period, r.group).agg(*[e.alias(n) for n, e in extra.items()]), [r.period, r.group])
    style = style.where(F.col("games") >= min_events)
    league = Window.partitionBy(r.period)                                # one row per group of a period
    return style.select("*", *[(F.col(c) - F.avg(c).over(league)).alias(c + "_x") for c in ("star", "top5", "depth10", *(extra or {}))])


def opening_leaders(leaders: DataFrame, *, through: int | None = None, period: str = "s") -> DataFrame:
    out = leaders.where(F.col("is_opening")).withColumn("single", F.col("n_coaches") == 1)
    return out.where(F.col(period) <= through) if through is not None else out


def closing_leaders(leaders: DataFrame, *, period: str = "s", group: str = "team_id") -> DataFrame:
    return leaders.groupBy(period, group).agg(F.max_by("coach_key", "seq").alias("closing_key"), F.max_by("status", "seq").alias("closing_status"))


def prior_leader_mean(styled: DataFrame, columns: list[str], *, leader: str = "coach_key", period: str = "s") -> DataFrame:
    """Mean of each column over the same leader's strictly earlier periods, and their number. A leader has few periods."""
    w = Window.partitionBy(leader).orderBy(period).rangeBetween(Window.unboundedPreceding, -1)
    return styled.select("*", F.count(F.lit(1)).over(w).alias("n_prior"), *[F.avg(c).over(w).alias("prior_" + c) for c in columns])


def leader_change(opening: DataFrame, closing: DataFrame, *, period: str = "s", group: str = "team_id") -> DataFrame:
    """(period, group, coach_key, is_new): new when the opening leader is not the one who closed the period before."""
    last = closing.select((F.col(period) + 1).alias(period), group, F.col("closing_key").alias("_before"))
    out = opening.join(last, [period, group], "left")
    return out.withColumn("is_new", F.coalesce(F.col("coach_key") != F.col("_before"), F.lit(False))).drop("_before")


def leader_shift(opening: DataFrame, closing: DataFrame, style: DataFrame, columns: list[str], *, period: str = "s", group: str = "team_id",
                 pseudo_periods: float = 1.0) -> DataFrame:
    """Expected style change of a new leader: own earlier style minus the group's last style, damped by how often it was seen."""
    rel = [c + "_x" for c in columns]
    seen = style.join(opening.where(F.col("single")).select(period, group, "coach_key"), [period, group])
    # an opening row of the target period has no style of its own yet; it still needs the earlier mean
    grid = opening.select(period, group, "coach_key").join(seen.select(period, group, *rel), [period, group], "left")
    earlier = prior_leader_mean(grid.groupBy("coach_key", period).agg(*[F.avg(c).alias(c) for c in rel]), rel, period=period)
    w = Window.partitionBy("coach_key").orderBy(period).rangeBetween(Window.unboundedPreceding, -1)
    earlier = earlier.withColumn("n_seen", F.count(rel[0]).over(w))
    prev = style.select((F.col(period) + 1).alias(period), group, *[F.col(c).alias("_prev_" + c) for c in rel])
    out = leader_change(opening, closing, period=period, group=group)
    out = out.join(earlier.select("coach_key", period, "n_seen", *["prior_" + c for c in rel]), ["coach_key", period], "left").join(prev, [period, group], "left")
    damp = F.col("n_seen") / (F.col("n_seen") + pseudo_periods)
    usable = F.col("is_new") & (F.col("n_seen") > 0)
    return out.select(period, group, "coach_key", "is_new", (F.col("is_new") & (F.coalesce("n_seen", F.lit(0)) == 0)).alias("debut"),
                      *[F.coalesce(F.when(usable, damp * (F.col("prior_" + c) - F.col("_prev_" + c))), F.lit(0.0)).alias("shift_" + c) for c in rel])


def minutes_opened(last_minutes: DataFrame, current: DataFrame, *, entity: str = "player_id", group: str = "team_id", minutes: str = "minutes", period: str | None = None) -> DataFrame:
    """(group, opened, incoming, net): last period's minutes of members who left, and of members who came from elsewhere. With ``period``,
    for each value of it; ``last_minutes`` then has the period that it is the last one before."""
    by = [period] if period else []
    left = last_minutes.select(entity, *by, F.col(group).alias("_from"), minutes)
    now = current.select(entity, *by, F.col(group).alias("_to"))
    both = left.join(now, [entity, *by], "left").where(~F.col("_from").eqNullSafe(F.col("_to")))
    out = both.groupBy(*by, F.col("_from").alias(group)).agg(F.sum(minutes).alias("opened"))
    inc = both.where(F.col("_to").isNotNull()).groupBy(*by, F.col("_to").alias(group)).agg(F.sum(minutes).alias("incoming"))
    full = out.join(inc, [*by, group], "full").na.fill({"opened": 0.0, "incoming": 0.0})
    return full.withColumn("net", F.col("opened") - F.col("incoming"))


def sum_excluding_self(df: DataFrame, group: list[str], value: str, name: str) -> DataFrame:
    """``name``: sum of ``value`` over the row's group without the row itself: a joined aggregate, so no window holds the group."""
    totals = df.groupBy(*group).agg(F.sum(value).alias("_total"))
    return df.join(totals, group, "left").withColumn(name, F.col("_total") - F.coalesce(F.col(value), F.lit(0))).drop("_total")


def mean_excluding_self(df: DataFrame, group: list[str], value: str, name: str) -> DataFrame:
    """Leave-one-out mean of the group; null where the row is alone."""
    totals = df.groupBy(*group).agg(F.sum(value).alias("_total"), F.count(value).alias("_count"))
    out = df.join(totals, group, "left")
    return out.withColumn(name, F.when(F.col("_count") > 1, (F.col("_total") - F.col(value)) / (F.col("_count") - 1))).drop("_total", "_count")

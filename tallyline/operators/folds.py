"""States that depend on the order of dated events, computed without walking one entity's list in one place."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tallyline.functions.parsing import pick_slot
from tallyline.operators.ranking import By, asc, with_row_number, with_running_max, with_running_sum


def _previous(rows: DataFrame, key: str, place: str, columns: dict[str, str]) -> DataFrame:
    """Columns of the row one place earlier, by an equi-join on (key, place): as even as the places themselves."""
    before = rows.select(key, (F.col(place) + 1).alias(place), *[F.col(c).alias(n) for c, n in columns.items()])
    return rows.join(before, [key, place], "left")


def deal_state(events: DataFrame, entity: str, *, order: list[str], kind: str, start: str, length: str, at: int, **kw) -> DataFrame:
    """(entity, status, remaining, last_covered, new_deal, extension) at period ``at``, from dated events read in order.

    ``kind``: 'deal' sets the last covered period (start + length - 1), 'extension' continues a running one (max(last, start) +
    length), 'end' stops and 'resume' restarts it; a missing length leaves the end unknown. Status is known, no_length, lapsed or
    unknown.

    The walk has a closed form. Everything before the last reset (a deal, or an extension of nothing that is running) is forgotten.
    After it the end is the maximum over its rows j of start_j plus all lengths from j on. Places and sums come from the split
    ranking, so an entity with a third of all events is spread over tasks.
    """
    keys: list[By] = [asc(c) for c in order]
    rows = events.where(F.col(kind).isin("deal", "extension", "end", "resume")).select(
        entity, F.col(kind).alias("_k"), F.col(start).cast("long").alias("_s"), F.col(length).cast("long").alias("_l"), *order)
    placed = with_row_number(rows, [entity], keys, "_place", **kw)
    placed = _previous(placed, entity, "_place", {"_k": "_k_before"})
    deals = placed.where(F.col("_k").isin("deal", "extension"))
    deals = with_row_number(deals, [entity], [asc("_place")], "_deal_no", **kw)
    deals = _previous(deals, entity, "_deal_no", {"_l": "_l_before"})
    first = F.col("_deal_no") == 1
    reset = (F.col("_k") == "deal") | first | (F.col("_k_before") == "end") | F.col("_l_before").isNull()
    deals = deals.withColumn("_reset", reset)
    last_reset = deals.where("_reset").groupBy(entity).agg(F.max("_deal_no").alias("_from"))
    live = deals.join(last_reset, entity).where(F.col("_deal_no") >= F.col("_from"))
    gain = F.coalesce("_l", F.lit(0)) - F.when(F.col("_k") == "deal", 1).otherwise(0)
    live = with_running_sum(live.withColumn("_gain", gain), [entity], [asc("_deal_no")], F.col("_gain"), "_upto", **kw)
    totals = live.groupBy(entity).agg(F.sum("_gain").alias("_all"), F.max_by(F.struct("_k", "_s", "_l"), "_deal_no").alias("_last"))
    ends = live.join(totals, entity).groupBy(entity).agg(
        F.max(F.col("_s") + F.col("_all") - F.col("_upto") + F.col("_gain")).alias("_fin"), F.first("_last").alias("_last"))
    ends = ends.withColumn("_fin", F.when(F.col("_last._l").isNotNull(), F.col("_fin")))
    newest = rows.groupBy(entity).agg(F.max_by("_k", F.struct(*order)).alias("_newest"))
    out = events.select(entity).distinct().join(ends, entity, "left").join(newest, entity, "left")
    have = F.col("_last").isNotNull()
    status = (F.when(~have, "unknown").when((F.col("_newest") == "end") | F.coalesce(F.col("_fin") < at, F.lit(False)), "lapsed")
              .when(F.col("_fin").isNull(), "no_length").otherwise("known"))
    out = out.withColumn("status", status)
    current = F.col("status").isin("known", "no_length")
    cov, is_ext = F.col("_last._s"), F.col("_last._k") == "extension"
    return out.select(entity, "status", F.when(F.col("status") == "known", F.col("_fin") - at + 1).alias("remaining"), F.col("_fin").alias("last_covered"),
                      F.coalesce(current & (cov == at), F.lit(False)).alias("new_deal"), F.coalesce(current & is_ext, F.lit(False)).alias("extension"),
                      F.coalesce(current & is_ext & (cov >= at - 1), F.lit(False)).alias("recent_extension"))


def state_intervals(events: DataFrame, entity: str, *, order: list[str], kind: str, start: str, length: str, known: str, **kw) -> DataFrame:
    """The state after each event of ``deal_state``, with the periods in which it is the newest one known: (entity, _from, _to, _newest,
    _kind, _start, _fin), _to null for the last one.

    ``known`` is the first period in which an event counts; it must not fall along ``order``. Kinds, starts and lengths are those of
    ``deal_state``. All periods are served by one pass: the end after the i-th deal since a reset is the running sum of lengths plus the running
    maximum of what each start is ahead of it, and both come from the split ranking, so that an entity with a third of all events is spread over tasks. Of
    events known in the same period the last one holds. Events without entity, or of another kind, are left out.
    """
    keys: list[By] = [asc(c) for c in order]
    rows = events.where(F.col(kind).isin("deal", "extension", "end", "resume") & F.col(entity).isNotNull()).select(
        entity, F.col(kind).alias("_k"), F.col(start).cast("long").alias("_s"), F.col(length).cast("long").alias("_l"), F.col(known).cast("long").alias("_known"), *order)
    placed = with_row_number(rows, [entity], keys, "_place", **kw).drop(*order)
    placed = _previous(placed, entity, "_place", {"_k": "_k_before"})
    is_deal = F.col("_k").isin("deal", "extension")
    placed = with_running_sum(placed, [entity], [asc("_place")], is_deal.cast("long"), "_deal_no", **kw)
    deals = _previous(placed.where(is_deal).drop("_known"), entity, "_deal_no", {"_l": "_l_before"})
    reset = (F.col("_k") == "deal") | (F.col("_deal_no") == 1) | (F.col("_k_before") == "end") | F.col("_l_before").isNull()
    gain = F.coalesce("_l", F.lit(0)) - F.when(F.col("_k") == "deal", 1).otherwise(0)
    deals = with_running_sum(deals.withColumn("_gain", gain), [entity], [asc("_deal_no")], F.col("_gain"), "_upto", **kw)
    deals = with_running_sum(deals.withColumn("_reset", reset.cast("long")), [entity], [asc("_deal_no")], F.col("_reset"), "_run", **kw)
    ahead = F.col("_s") - F.col("_upto") + F.col("_gain")
    deals = with_running_max(deals, [entity, "_run"], [asc("_deal_no")], ahead, "_ahead", **kw)
    after = deals.select(entity, "_deal_no", F.col("_k").alias("_kind"), F.col("_s").alias("_start"), F.when(F.col("_l").isNotNull(), F.col("_upto") + F.col("_ahead")).alias("_fin"))
    following = placed.select(entity, (F.col("_place") - 1).alias("_place"), (F.col("_known") - 1).alias("_to"))
    states = placed.join(after, [entity, "_deal_no"], "left").join(following, [entity, "_place"], "left")
    return states.where(F.col("_to").isNull() | (F.col("_to") >= F.col("_known"))).select(
        entity, F.col("_known").alias("_from"), "_to", F.col("_k").alias("_newest"), "_kind", "_start", "_fin")


def states(intervals: DataFrame, universe: DataFrame, entity: str, period: str) -> DataFrame:
    """The state of every entity at every period: each row of ``universe`` (entity, first, last) over its periods, from ``state_intervals``.

    An interval is unfolded over the periods that it shares with its entity's range, so the work is the result's size; no event is
    read again. Periods before the first event, and entities without events, are unknown. Columns are those of ``deal_state``.
    """
    first = intervals.groupBy(entity).agg((F.min("_from") - 1).alias("_to"))
    held = intervals.select(entity, "_from", "_to", "_newest", "_kind", "_start", "_fin")
    nothing = [F.lit(None).cast(held.schema[c].dataType).alias(c) for c in ("_newest", "_kind", "_start", "_fin")]
    before = universe.join(first, entity, "left").select(entity, F.lit(None).cast("long").alias("_from"), "_to", *nothing, F.col("first").cast("long").alias("first"), F.col("last").cast("long").alias("last"))
    known = universe.select(entity, F.col("first").cast("long").alias("first"), F.col("last").cast("long").alias("last")).join(held, entity).select(*before.columns)
    lo, hi = F.greatest("_from", "first"), F.least("_to", "last")
    rows = before.unionByName(known).withColumn("_lo", lo).withColumn("_hi", hi).where(F.col("_lo") <= F.col("_hi")).withColumn(period, F.explode(F.sequence("_lo", "_hi")))
    at, have = F.col(period), F.col("_kind").isNotNull()
    status = (F.when(~have, "unknown").when((F.col("_newest") == "end") | F.coalesce(F.col("_fin") < at, F.lit(False)), "lapsed")
              .when(F.col("_fin").isNull(), "no_length").otherwise("known"))
    rows = rows.withColumn("status", status)
    current, is_ext = F.col("status").isin("known", "no_length"), F.col("_kind") == "extension"
    flag = lambda c: F.coalesce(current & c, F.lit(False))                              # noqa: E731
    return rows.select(entity, period, "status", F.when(F.col("status") == "known", F.col("_fin") - at + 1).alias("remaining"), F.col("_fin").alias("last_covered"),
                       flag(F.col("_start") == at).alias("new_deal"), flag(is_ext).alias("extension"), flag(is_ext & (F.col("_start") >= at - 1)).alias("recent_extension"))


def state_flag(state: DataFrame) -> DataFrame:
    """Design indicators and a display label of a deal state."""
    known = F.col("status") == "known"
    cy, two, three = known & (F.col("remaining") == 1), known & (F.col("remaining") == 2), known & (F.col("remaining") >= 3)
    out = state.withColumn("contract_year", F.coalesce(cy, F.lit(False))).withColumn("two_left", F.coalesce(two, F.lit(False))).withColumn("three_left", F.coalesce(three, F.lit(False)))
    label = F.when(F.col("contract_year"), "contract_year").when(F.col("recent_extension"), "extension").when(F.col("new_deal"), "new_deal").otherwise("")
    return out.withColumn("lapsed", F.col("status") == "lapsed").withColumn("flag", label)


def entry_clock(players: DataFrame, *, season: int, entity: str = "player_id", scale_years: int = 4, first_round: int = 30, top_pick: int = 5, late_pick: int = 20) -> DataFrame:
    """Years since entry and the indicator columns of the entry-scale clock, from static facts; a later entry year gives no clock."""
    years = F.when(F.col("draft_year") <= season, F.lit(season) - F.col("draft_year") + 1)
    by_number = F.when(F.col("draft_number") >= 1, F.when(F.col("draft_number") <= first_round, 1).otherwise(2)).otherwise(0)
    rnd = F.when(F.col("draft_round") >= 1, F.least(F.col("draft_round"), F.lit(2))).otherwise(by_number)
    out = players.dropDuplicates([entity]).select(entity, years.alias("years"), F.when(years.isNotNull(), rnd).otherwise(F.lit(0)).alias("round"),
                                                  pick_slot(F.col("draft_number"), F.col("draft_round")).alias("pick"))
    first = F.col("round") == 1
    on = lambda c: F.coalesce(c, F.lit(False)).cast("double")       # noqa: E731
    final = first & (F.col("years") == scale_years)
    return out.select("*", F.when(first & F.col("years").between(1, scale_years), F.col("years")).alias("scale_year"),
                      on(first & (F.col("years") == scale_years - 1)).alias("option_year"), on(final).alias("final_year"),
                      on(first & (F.col("years") == scale_years + 1)).alias("post_scale"),
                      *[on(first & (F.col("years") == k)).alias(f"r1_y{k}") for k in range(1, scale_years + 2)],
                      *[on((F.col("round") == 2) & (F.col("years") == k)).alias(f"r2_y{k}") for k in range(1, 4)],
                      on(final & (F.col("pick") <= top_pick)).alias("top_final"), on(final & (F.col("pick") >= late_pick)).alias("late_final"))

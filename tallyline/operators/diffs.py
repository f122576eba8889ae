"""Run-over-run differences: keyed snapshots, moves, movers and set changes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tallyline.operators.ranking import asc, top_k


def compare(prev: DataFrame, cur: DataFrame, key: list[str], columns: list[str]) -> DataFrame:
    """Full outer join with ``in_prev``, ``in_cur`` and ``<column>_prev`` / ``<column>_cur``."""
    p = prev.select(*key, F.lit(True).alias("in_prev"), *[F.col(c).alias(c + "_prev") for c in columns])
    c = cur.select(*key, F.lit(True).alias("in_cur"), *[F.col(x).alias(x + "_cur") for x in columns])
    return p.join(c, key, "full").na.fill({"in_prev": False, "in_cur": False})


def membership_moves(prev: DataFrame, cur: DataFrame, *, entity: str = "player_id", group: str = "team_id") -> DataFrame:
    """(entity, change, from, to): arrived, departed or moved between two snapshots; unchanged rows are left out."""
    j = compare(prev, cur, [entity], [group])
    a, b = F.col(group + "_prev"), F.col(group + "_cur")
    change = (F.when(~F.col("in_prev"), F.lit("arrived")).when(~F.col("in_cur"), F.lit("departed")).when(~a.eqNullSafe(b), F.lit("moved")))
    return j.select(entity, change.alias("change"), a.alias("from_group"), b.alias("to_group")).where(F.col("change").isNotNull())


def changed_values(prev: DataFrame, cur: DataFrame, key: list[str], column: str) -> DataFrame:
    """Keys in both snapshots whose value differs."""
    j = compare(prev, cur, key, [column]).where(F.col("in_prev") & F.col("in_cur"))
    return j.where(~F.col(column + "_prev").eqNullSafe(F.col(column + "_cur"))).select(*key, column + "_prev", column + "_cur")


def rank_moves(prev: DataFrame, cur: DataFrame, *, entity: str, rank: str, min_move: float, top: int | None = None, period: str | None = None) -> DataFrame:
    """(entity, kind, move): risers and fallers past ``min_move``, and rankings gained or lost. A positive move is toward rank 1. With
    ``period``, for each value of it; ``prev`` then has the period that it is compared in."""
    by = [period] if period else []
    j = compare(prev, cur, [*by, entity], [rank])
    a, b = F.col(rank + "_prev"), F.col(rank + "_cur")
    move = a - b
    kind = (F.when(a.isNull() & b.isNotNull(), F.lit("gained")).when(a.isNotNull() & b.isNull(), F.lit("lost"))
            .when(move >= min_move, F.lit("riser")).when(move <= -min_move, F.lit("faller")))
    out = j.select(*by, entity, kind.alias("kind"), a.alias("prev"), b.alias("cur"), move.alias("move")).where(F.col("kind").isNotNull())
    if top is None:
        return out
    size = F.when(F.col("kind").isin("riser", "faller"), -F.abs("move")).otherwise(F.coalesce("cur", "prev"))
    return top_k(out.withColumn("_size", size), [*by, "kind"], [asc("_size"), asc(entity)], top, "place").drop("_size")


def list_changes(prev: DataFrame, cur: DataFrame, *, entity: str, rank: str, min_move: int = 5) -> DataFrame:
    """New, dropped and moved entries of a ranked list."""
    j = compare(prev, cur, [entity], [rank])
    a, b = F.col(rank + "_prev"), F.col(rank + "_cur")
    change = (F.when(~F.col("in_prev"), F.lit("new")).when(~F.col("in_cur"), F.lit("dropped")).when(F.abs(a - b) >= min_move, F.lit("moved")))
    return j.select(entity, change.alias("change"), a.alias("prev"), b.alias("cur")).where(F.col("change").isNotNull())


def count_delta(prev: DataFrame, cur: DataFrame, group: list[str]) -> DataFrame:
    """(group, prev, cur, delta) row counts."""
    a = prev.groupBy(*group).agg(F.count(F.lit(1)).alias("prev"))
    b = cur.groupBy(*group).agg(F.count(F.lit(1)).alias("cur"))
    j = a.join(b, group, "full").na.fill({"prev": 0, "cur": 0})
    return j.withColumn("delta", F.col("cur") - F.col("prev"))


def key_changes(prev: DataFrame, cur: DataFrame, key: list[str]) -> DataFrame:
    """(key, change): new and gone keys."""
    p, c = prev.select(*key).distinct(), cur.select(*key).distinct()
    return c.join(p, key, "left_anti").withColumn("change", F.lit("new")).unionByName(p.join(c, key, "left_anti").withColumn("change", F.lit("gone")))


def array_changes(prev: Column, cur: Column) -> Column:
    """Struct (added, removed) of two id arrays."""
    return F.struct(F.array_except(cur, prev).alias("added"), F.array_except(prev, cur).alias("removed"))


def settings_diff(ours: DataFrame, theirs: DataFrame) -> DataFrame:
    """(field, ours, theirs, same) over two key/value tables."""
    j = compare(ours, theirs, ["field"], ["value"])
    return j.select("field", F.col("value_prev").alias("ours"), F.col("value_cur").alias("theirs"), F.col("value_prev").eqNullSafe(F.col("value_cur")).alias("same"))


def unseen_events(events: DataFrame, seen: DataFrame, key: list[str], *, filled: Column | None = None) -> DataFrame:
    """Events that are filled in and whose key was not seen before."""
    rows = events if filled is None else events.where(filled)
    return rows.join(seen.select(*key).distinct(), key, "left_anti")


def union_report(parts: dict[str, DataFrame]) -> DataFrame:
    """Several diffs as one (section, row) table of JSON rows."""
    frames = [f.select(F.lit(name).alias("section"), F.to_json(F.struct(*f.columns)).alias("row")) for name, f in parts.items()]
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out

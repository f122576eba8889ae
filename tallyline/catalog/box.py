"""Box-score roles of the driver's tables: a customer is a player, a nation a team, a day with orders a game."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tallyline.catalog.base import Tables
from tallyline.functions.periods import season_label
from tallyline.session import cut_lineage

SCORING = {"PTS": 1.0, "REB": 1.0, "AST": 2.0, "STL": 4.0, "BLK": 4.0, "TO": -2.0, "FGM": 2.0, "FGA": -1.0, "FTM": 1.0, "FTA": -1.0, "3PM": 1.0}


def game_logs(t: Tables) -> DataFrame:
    """One row per customer and order day; every box-score identity holds."""
    orders = t.orders.select("o_orderkey", F.col("o_custkey").alias("player_id"), F.to_date("o_orderdate").alias("game_date"))
    teams = t.customer.select(F.col("c_custkey").alias("player_id"), F.col("c_nationkey").cast("long").alias("team_id"))
    lines = t.lineitem.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).join(teams, "player_id")
    q = F.col("l_quantity").cast("long")
    made, far, free = F.col("l_returnflag") == "R", F.col("l_discount") >= 0.05, F.col("l_linestatus") == "F"
    total = lambda cond: F.sum(F.when(cond, q).otherwise(0))                   # noqa: E731
    g = lines.groupBy("player_id", "team_id", "game_date").agg(
        (F.count(F.lit(1)) * 6.0).alias("min"), F.sum(q).alias("fga"), total(made).alias("fgm"), total(far).alias("fg3a"), total(far & made).alias("fg3m"), total(free).alias("fta"),
        total(free & (F.col("l_returnflag") == "A")).alias("ftm"), F.count_if(F.col("l_returnflag") == "N").alias("oreb"), F.count_if(F.col("l_returnflag") != "N").alias("dreb"),
        F.count(F.lit(1)).alias("ast"), F.count_if(F.col("l_tax") > 0.06).alias("stl"), F.count_if(F.col("l_tax") < 0.02).alias("blk"), F.count_if(F.col("l_discount") < 0.01).alias("tov"),
        F.count_if(F.col("l_tax") == 0).alias("pf"))
    return g.select(season_label(F.year("game_date")).alias("season"), F.concat_ws("|", "team_id", "game_date").alias("game_id"), "game_date", "player_id",
                    F.concat(F.lit("Customer "), F.col("player_id").cast("string")).alias("player_name"), "team_id", F.concat(F.lit("N"), F.col("team_id").cast("string")).alias("team_abbr"), "min", "fgm", "fga",
                    "fg3m", "fg3a", "ftm", "fta", "oreb", "dreb", (F.col("oreb") + F.col("dreb")).alias("reb"), "ast", "stl", "blk", "tov", "pf", (2 * F.col("fgm") + F.col("fg3m") + F.col("ftm")).alias("pts"))


def team_games(t: Tables) -> DataFrame:
    days = t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey")).select(F.col("c_nationkey").cast("long").alias("team_id"), F.to_date("o_orderdate").alias("game_date")).distinct()
    return days.select(season_label(F.year("game_date")).alias("season"), F.concat_ws("|", "team_id", "game_date").alias("game_id"), "game_date", "team_id", F.concat(F.lit("N"), F.col("team_id").cast("string")).alias("team_abbr"))


def players(t: Tables) -> DataFrame:
    first = t.orders.groupBy(F.col("o_custkey").alias("player_id")).agg(F.min(F.year("o_orderdate")).cast("long").alias("first"), F.max(F.year("o_orderdate")).cast("long").alias("last"))
    names = F.array(*[F.lit(x) for x in ("G", "F", "C", "G-F", "F-C")])
    return t.customer.join(first, F.col("c_custkey") == F.col("player_id")).select(
        "player_id", F.concat(F.lit("Customer "), F.col("player_id").cast("string")).alias("player_name"), F.make_date((F.col("first") - 19 - F.col("c_nationkey") % 15).cast("int"), F.lit(5), F.lit(1)).alias("birthdate"),
        F.element_at(names, (F.col("c_nationkey") % 5 + 1).cast("int")).alias("position"), F.col("first").alias("draft_year"), F.lit(1).cast("long").alias("draft_round"),
        (F.floor(F.col("c_acctbal").cast("double") / 200) + 6).cast("long").alias("draft_number"), F.col("first").alias("from_year"), F.col("last").alias("to_year"))


def bio(t: Tables) -> DataFrame:
    p = players(t)
    seen = t.orders.select(F.col("o_custkey").alias("player_id"), F.year("o_orderdate").alias("y")).distinct()
    return seen.join(p, "player_id").select(season_label(F.col("y")).alias("season"), "player_id", (F.datediff(F.make_date("y", F.lit(10), F.lit(1)), F.col("birthdate")) / 365.25).alias("age_at_season_start"))


def history_tables(t: Tables) -> dict[str, DataFrame]:
    # the role tables are joins; a projection reads them many times
    return {name: cut_lineage(table(t)) for name, table in (("game_logs", game_logs), ("team_games", team_games), ("players", players), ("player_season_bio", bio))}

"""Table contracts: name, unique key, typed columns, and the rules a valid row keeps."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql import types as T

KINDS = {"int": T.LongType(), "float": T.DoubleType(), "str": T.StringType(), "bool": T.BooleanType(), "date": T.DateType(),
         "time": T.TimestampType(), "money": T.DecimalType(14, 2)}
_ACCEPTED = {"int": T.IntegralType, "float": T.FractionalType, "str": T.StringType, "bool": T.BooleanType,
             "date": (T.DateType, T.TimestampType, T.TimestampNTZType), "time": (T.TimestampType, T.TimestampNTZType), "money": T.NumericType}


class ContractError(ValueError):
    """A table does not satisfy its contract."""


@dataclass(frozen=True)
class TableSpec:
    name: str
    key: tuple[str, ...]
    columns: dict[str, tuple[str, bool]]                    # column -> (kind, nullable)
    rules: dict[str, str] = field(default_factory=dict)     # rule name -> SQL predicate that is true for a BAD row
    partition: str | None = None

    @property
    def schema(self) -> T.StructType:
        return T.StructType([T.StructField(c, KINDS[kind], nullable) for c, (kind, nullable) in self.columns.items()])


TABLES: dict[str, TableSpec] = {}


def register(name: str, key: str, columns: str, rules: dict[str, str] | None = None, partition: str | None = None) -> TableSpec:
    """``columns`` lists 'name kind' pairs; a trailing ? marks a nullable column."""
    cols = {}
    for item in columns.split(","):
        col, kind = item.split()
        cols[col] = (kind.rstrip("?"), kind.endswith("?"))
    spec = TableSpec(name, tuple(key.split()), cols, rules or {}, partition)
    TABLES[name] = spec
    return spec


COUNTS = ("fgm", "fga", "fg3m", "fg3a", "ftm", "fta", "oreb", "dreb", "reb", "ast", "stl", "blk", "tov", "pf", "pts")
_BOX = ", ".join(f"{c} int" for c in COUNTS)
# Identities of a valid box-score row (each predicate marks a bad row).
BOX_SCORE_RULES = {
    "fgm > fga": "fgm > fga",
    "fg3m > fgm": "fg3m > fgm",
    "fg3a > fga": "fg3a > fga",
    "ftm > fta": "ftm > fta",
    "reb != oreb + dreb": "reb <> oreb + dreb",
    "pts != 2*fgm + fg3m + ftm": "pts <> 2 * fgm + fg3m + ftm",
    "min <= 0": "min <= 0",
    "negative counting stat": "least(fgm, fga, ftm, fta, reb, ast, stl, blk, tov, pts) < 0",
}

GAME_LOGS = register("game_logs", "game_id player_id", "season str, game_id str, game_date date, player_id int, player_name str, team_id int, "
                     f"team_abbr str, matchup str, min float, {_BOX}, plus_minus float?", BOX_SCORE_RULES, "season")
TEAM_GAMES = register("team_games", "game_id team_id", "season str, game_id str, game_date date, team_id int, team_abbr str, is_home bool, "
                      "pts_for int?, pts_against int?", partition="season")
PLAYERS = register("players", "player_id", "player_id int, player_name str, birthdate date?, position str?, height_in float?, weight_lb float?, "
                   "draft_year int?, draft_round int?, draft_number int?, from_year int?, to_year int?")
PLAYER_SEASON_BIO = register("player_season_bio", "season player_id", "season str, player_id int, age_at_season_start float, team_id int?", partition="season")
PLAYER_ID_MAP = register("player_id_map", "source source_id", "player_id int, source str, source_id str, source_name str, match_method str, confidence float",
                         {"confidence outside 0..1": "confidence < 0 or confidence > 1"})
_PROJECTED = ", ".join(f"proj_{c} float" for c in ("pts", "reb", "ast", "stl", "blk", "tov", "fgm", "fga", "ftm", "fta", "fg3m"))
PROJECTIONS = register("projections", "season player_id model", "season str, player_id int, player_name str, model str, proj_gp float, proj_mpg float, "
                       f"{_PROJECTED}, proj_fppg float, proj_total_fp float, fppg_p10 float?, fppg_p50 float?, fppg_p90 float?",
                       {"band out of order": "fppg_p10 > fppg_p50 or fppg_p50 > fppg_p90", "negative games": "proj_gp < 0"}, "season")
register("offseason_logs", "game_id player_id", f"season str, game_id str, game_date date, player_id int, player_name str, team_id int, team_abbr str, "
         f"matchup str, min float, {_BOX}, plus_minus float?, event_season str, context str",
         {k: v for k, v in BOX_SCORE_RULES.items() if "pts" not in k and "reb" not in k} | {"unknown context": "context not in ('summer_league', 'preseason')"}, "event_season")
register("offseason_team_games", "game_id team_id", "season str, game_id str, game_date date, team_id int, team_abbr str, is_home bool, pts_for int?, "
         "pts_against int?, event_season str, context str", {"unknown context": "context not in ('summer_league', 'preseason')"}, "event_season")
register("playoff_logs", "game_id player_id", f"season str, game_id str, game_date date, player_id int, player_name str, team_id int, team_abbr str, min float, {_BOX}", partition="season")
register("roster_snapshots", "snapshot_date player_id", "snapshot_date date, season str, player_id int, player_name str, team_id int, team_abbr str, "
         "position str?, draft_year int?, draft_number int?", partition="snapshot_date")
register("status_snapshots", "snapshot_date source_id", "snapshot_date date, season str, source_id int, player_id int?, player_name str, pro_team_id int, "
         "injury_status str, injured bool, last_news_date time?", partition="snapshot_date")
register("injury_news", "note_id status", "note_id str, source_id int, player_id int?, player_name str, team_abbr str?, status str, injury_type str?, body_part str?, "
         "detail str?, side str?, return_date date?, fantasy_status str?, headline str?, text str?, source str?, published time?, first_seen time, last_seen time",
         {"first seen after last seen": "first_seen > last_seen"})
register("offcourt_news", "article_id source_id", "article_id str, source_id int, player_id int?, player_name str, n_athletes int, headline str, description str?, "
         "url str?, published time, first_seen time, last_seen time")
register("injury_reports", "game_date player_name report_ts", "season str, game_date date, report_ts time, slot str, matchup str, team_abbr str, player_name str, "
         "player_id int?, status str, category str?, detail str?", partition="season")
register("league_transactions", "txn_key", "txn_key str, txn_date date, team_id int, team_abbr str, kind str, subject_type str, person str, player_id int?, "
         "other_team_id int?, detail str, description str, first_seen time, last_seen time",
         {"unknown subject": "subject_type not in ('player', 'staff')", "first seen after last seen": "first_seen > last_seen"})
register("team_transactions", "", "season str, team_id int, player_id int, direction str, source_kind str, txn_date date?",
         {"unknown direction": "direction not in ('in', 'out')"}, "season")
register("player_contracts", "", "season str, page_season str, start_year int, team_id int?, player_id int, event str, contract_type str, years int?, days int?, "
         "amount_usd float?, signed_date date?, date_source str, is_two_way bool, is_ten_day bool, is_exhibit10 bool, is_minimum bool, is_extension bool, is_rookie bool, "
         "non_guaranteed bool, has_option bool, multiyear_unspecified bool, section str, terms_source str",
         {"unknown contract type": "contract_type not in ('', 'standard', 'two_way', 'ten_day', 'exhibit10', 'minimum', 'rookie')",
          "unknown date source": "date_source not in ('cell', 'citation', 'access_date', 'cell_no_year', 'none')",
          "years outside 1..6": "years not between 1 and 6", "two-way and ten-day": "is_two_way and is_ten_day"}, "season")
register("team_coaches", "season team_id seq", "season str, team_id int, seq int, coach_name str, coach_key str, status str, is_opening bool, n_coaches int, source str, start_date date?", partition="season")
register("schedule_games", "game_id", "season str, game_id str, scoring_period int?, game_date date, home_team_id int, away_team_id int, home_abbr str, away_abbr str, "
         "source str, time_tbd bool", {"team plays itself": "home_team_id = away_team_id"}, "season")
register("player_profiles", "player_id", "player_id int, player_name str, birthdate date?, country str?, organisation str?, organisation_type str?, origin str, height_in float?, weight_lb float?")
register("draft_combine", "draft_year player_id", "draft_year int, player_id int, height_in float?, weight_lb float?, wingspan_in float?, reach_in float?, vertical_in float?, "
         "max_vertical_in float?, lane_agility_s float?, sprint_s float?, bench_reps float?")
register("adp", "season source source_id", "season str, source str, source_id str, adp float", {"pick below one": "adp < 1"}, "season")


def empty_table(spark: SparkSession, spec: TableSpec) -> DataFrame:
    return spark.createDataFrame([], spec.schema)


def conform(df: DataFrame, spec: TableSpec) -> DataFrame:
    """Cast to the contract's types, null for a nullable column that is missing; extra columns are kept after them."""
    absent = [c for c, (_, nullable) in spec.columns.items() if c not in df.columns and not nullable]
    if absent:
        raise ContractError(f"{spec.name}: missing columns {absent}")
    typed = [(F.col(c) if c in df.columns else F.lit(None)).cast(KINDS[kind]).alias(c) for c, (kind, _) in spec.columns.items()]
    return df.select(*typed, *[c for c in df.columns if c not in spec.columns])


def schema_problems(df: DataFrame, spec: TableSpec, *, allow_extra: bool = True) -> list[str]:
    """Problems visible without reading a row."""
    out = [f"missing column {c}" for c in spec.columns if c not in df.columns]
    if not allow_extra:
        out += [f"unexpected column {c}" for c in df.columns if c not in spec.columns]
    for c, (kind, nullable) in spec.columns.items():
        if c in df.columns:
            found = df.schema[c].dataType
            integral_float = kind == "int" and nullable and isinstance(found, T.FractionalType)
            if not isinstance(found, _ACCEPTED[kind]) and not integral_float:
                out.append(f"{c}: type {found.simpleString()} is not {kind}")
    return out


def rule_counts(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """(rule, n_bad): every rule counted in one pass over the rows."""
    one = df.agg(*[F.count_if(F.coalesce(cond, F.lit(False))).alias(name) for name, cond in rules.items()])
    pairs = F.array(*[F.struct(F.lit(n).alias("rule"), F.col(f"`{n}`").alias("n_bad")) for n in rules])
    return one.select(F.explode(pairs).alias("p")).select("p.rule", "p.n_bad")


def duplicate_key_count(df: DataFrame, key: list[str]) -> DataFrame:
    """(n_bad): rows beyond the first of their key. Counts are combined on the map side, so a hot key does not move."""
    return df.groupBy(*key).agg(F.count(F.lit(1)).alias("n")).agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).cast("long").alias("n_bad"))


def table_problems(df: DataFrame, spec: TableSpec) -> DataFrame:
    """(rule, n_bad) for nulls, non-integral values, the spec's row rules and duplicate keys; rules without a hit are left out."""
    rules: dict[str, Column] = {}
    for c, (kind, nullable) in spec.columns.items():
        if c not in df.columns:
            continue
        if not nullable:
            rules[f"{c} is null"] = F.col(c).isNull()
        if kind == "int" and isinstance(df.schema[c].dataType, T.FractionalType):
            rules[f"{c} is not integral"] = (F.col(c) % 1) != 0
    rules.update({name: F.expr(bad) for name, bad in spec.rules.items()})
    out = rule_counts(df, rules)
    if spec.key and all(k in df.columns for k in spec.key):
        dup = duplicate_key_count(df, list(spec.key)).select(F.lit("duplicate key").alias("rule"), "n_bad")
        out = out.unionByName(dup)
    return out.where(F.col("n_bad") > 0)


def validate(df: DataFrame, spec: TableSpec | str, *, allow_extra: bool = True) -> DataFrame:
    """``df`` itself, or an error naming every problem."""
    spec = TABLES[spec] if isinstance(spec, str) else spec
    found = schema_problems(df, spec, allow_extra=allow_extra)
    if not any(p.startswith("missing") for p in found):
        found += [f"{r['n_bad']} rows: {r['rule']}" for r in table_problems(df, spec).collect()]   # one row per rule
    if found:
        raise ContractError(f"{spec.name}: " + "; ".join(found))
    return df

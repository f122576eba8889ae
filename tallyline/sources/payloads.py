"""Nested JSON payloads flattened to typed rows with schemas and ``explode``; every file is a row, so many files spread out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tallyline.functions.parsing import clean_text, parse_day, parse_height_inches, parse_minutes, position_code, to_double, to_nullable_int
from tallyline.functions.periods import event_window, is_playoff_game_id, is_regular_game_id
from tallyline.operators.ranking import asc, desc, keep_first
from tallyline.sources.contracts import COUNTS

RESULT_SCHEMA = "resultSets array<struct<name string, headers array<string>, rowSet array<array<string>>>>"


def read_json_files(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """One row per file, with its path."""
    return spark.read.schema(schema).option("multiLine", True).json(path).withColumn("source_file", F.input_file_name())


def result_rows(payload: DataFrame, name: str, columns: list[str]) -> DataFrame:
    """Named columns (as text) of one result set; the header, not the position, says where each is. A missing column is null."""
    one = payload.withColumn("_set", F.explode("resultSets")).where(F.col("_set.name") == name)
    rows = one.select(*[c for c in payload.columns if c != "resultSets"], F.col("_set.headers").alias("_h"), F.explode("_set.rowSet").alias("_r"))
    at = lambda c: F.array_position("_h", F.lit(c)).cast("int")       # noqa: E731
    keep = [c for c in rows.columns if c not in ("_h", "_r")]
    return rows.select(*keep, *[F.when(at(c) > 0, F.try_element_at("_r", F.when(at(c) > 0, at(c)).otherwise(1))).alias(c) for c in columns])


# Payload column -> contract column.
LOG_COLUMNS = {"PLAYER_ID": "player_id", "PLAYER_NAME": "player_name", "TEAM_ID": "team_id", "TEAM_ABBREVIATION": "team_abbr", "GAME_ID": "game_id",
               "GAME_DATE": "game_date", "MATCHUP": "matchup", "PLUS_MINUS": "plus_minus"} | {c.upper(): c for c in COUNTS}


def _typed_logs(payload: DataFrame, name: str) -> DataFrame:
    raw = result_rows(payload, name, [*LOG_COLUMNS, "MIN", "MIN_SEC"])
    out = raw.select(*[F.col(a).alias(b) for a, b in LOG_COLUMNS.items()], F.coalesce(parse_minutes(F.col("MIN")), parse_minutes(F.col("MIN_SEC"))).alias("min"))
    return out.select(*[(to_nullable_int(F.col(c)).alias(c) if c in COUNTS else F.col(c).try_cast("bigint").alias(c) if c in ("player_id", "team_id")
                         else to_double(F.col(c)).alias(c) if c == "plus_minus" else parse_day(F.col(c)).alias(c) if c == "game_date"
                         else F.trim(c).alias(c) if c in ("game_id", "team_abbr", "matchup", "player_name") else F.col(c)) for c in out.columns])


def _dropped_and_kept(logs: DataFrame, reason: Column, *, prefer: list[str]) -> tuple[DataFrame, DataFrame]:
    """(kept, counts): typed drops by reason, then identical and conflicting duplicates of (game_id, player_id)."""
    tagged = logs.withColumn("reason", reason)
    good = tagged.where(F.col("reason").isNull()).drop("reason")
    distinct = good.distinct()
    kept = keep_first(distinct, ["game_id", "player_id"], [desc(c) for c in prefer] + [asc("team_id")])
    counts = tagged.where(F.col("reason").isNotNull()).groupBy("reason").agg(F.count(F.lit(1)).alias("n_rows"))
    n = lambda df: df.agg(F.count(F.lit(1))).scalar()          # noqa: E731
    extra = logs.sparkSession.range(1).select(F.explode(F.array(F.struct(F.lit("identical duplicate").alias("reason"), (n(good) - n(distinct)).alias("n_rows")),
                                                                F.struct(F.lit("conflicting duplicate").alias("reason"), (n(distinct) - n(kept)).alias("n_rows")))).alias("x")).select("x.*")
    return kept, counts.unionByName(extra).where(F.col("n_rows") > 0)


def game_logs(payload: DataFrame, season: str, *, name: str = "PlayerGameLogs") -> tuple[DataFrame, DataFrame]:
    """Contract rows of one season, and the rows dropped by reason."""
    logs = _typed_logs(payload, name).withColumn("season", F.lit(season))
    missing = F.greatest(*[F.col(c).isNull().cast("int") for c in (*COUNTS, "player_id", "team_id")]) == 1
    reason = (F.when(~is_regular_game_id(F.col("game_id"), F.lit(season)), "not a regular-season game").when(F.col("min").isNull() | (F.col("min") <= 0), "did not play")
              .when(missing, "missing box-score fields"))
    return _dropped_and_kept(logs, reason, prefer=["min", "pts"])


def offseason_logs(payload: DataFrame, event_season: str, context: str, season: str, *, name: str = "LeagueGameLog") -> tuple[DataFrame, DataFrame]:
    """The same for an off-season event: rows outside its calendar window are dropped, identities are not enforced."""
    logs = _typed_logs(payload, name).select("*", F.lit(season).alias("season"), F.lit(event_season).alias("event_season"), F.lit(context).alias("context"))
    first, last = event_window(F.lit(context), F.lit(int(event_season[:4])))
    reason = (F.when(~F.col("game_date").between(first, last), "outside the event window").when(F.col("min").isNull() | (F.col("min") <= 0), "did not play"))
    return _dropped_and_kept(logs, reason, prefer=["min", "pts"])


def playoff_logs(payload: DataFrame, season: str, *, name: str = "LeagueGameLog") -> DataFrame:
    logs = _typed_logs(payload, name).withColumn("season", F.lit(season)).where(is_playoff_game_id(F.col("game_id"), F.lit(season)) & (F.col("min") > 0))
    return keep_first(logs, ["game_id", "player_id"], [desc("min"), asc("team_id")]).drop("plus_minus", "matchup")


def team_games(payload: DataFrame, season: str, *, name: str = "LeagueGameLog") -> DataFrame:
    """One row per team-game; the opponent's score is the other row's, null for both when either is missing or the game is not a pair."""
    raw = result_rows(payload, name, ["GAME_ID", "GAME_DATE", "TEAM_ID", "TEAM_ABBREVIATION", "MATCHUP", "PTS"])
    rows = raw.select(F.trim("GAME_ID").alias("game_id"), parse_day(F.col("GAME_DATE")).alias("game_date"), F.col("TEAM_ID").try_cast("bigint").alias("team_id"),
                      F.trim("TEAM_ABBREVIATION").alias("team_abbr"), F.contains("MATCHUP", F.lit("vs.")).alias("is_home"), to_nullable_int(F.col("PTS")).cast("bigint").alias("pts_for")).distinct()
    rows = rows.where(is_regular_game_id(F.col("game_id"), F.lit(season)))
    pair = rows.groupBy("game_id").agg(F.count(F.lit(1)).alias("_n"), F.sum("pts_for").alias("_s"), F.count("pts_for").alias("_k"))
    both = rows.join(pair, "game_id")
    whole = (F.col("_n") == 2) & (F.col("_k") == 2)
    return both.select(F.lit(season).alias("season"), "game_id", "game_date", "team_id", "team_abbr", "is_home", "pts_for",
                       F.when(whole, F.col("_s") - F.col("pts_for")).alias("pts_against"))


def entity_index(payload: DataFrame, *, name: str = "PlayerIndex") -> DataFrame:
    """Static attributes, first row per id."""
    cols = ["PERSON_ID", "PLAYER_FIRST_NAME", "PLAYER_LAST_NAME", "POSITION", "HEIGHT", "WEIGHT", "DRAFT_YEAR", "DRAFT_ROUND", "DRAFT_NUMBER", "FROM_YEAR", "TO_YEAR",
            "COUNTRY", "COLLEGE", "TEAM_ID", "TEAM_ABBREVIATION", "ROSTER_STATUS"]
    raw = result_rows(payload, name, cols)
    out = raw.select(F.col("PERSON_ID").try_cast("bigint").alias("player_id"), F.trim(F.concat_ws(" ", "PLAYER_FIRST_NAME", "PLAYER_LAST_NAME")).alias("player_name"),
                     position_code(F.col("POSITION")).alias("position"), parse_height_inches(F.col("HEIGHT")).alias("height_in"), to_double(F.col("WEIGHT")).alias("weight_lb"),
                     *[to_nullable_int(F.col(c)).alias(c.lower()) for c in ("DRAFT_YEAR", "DRAFT_ROUND", "DRAFT_NUMBER", "FROM_YEAR", "TO_YEAR")],
                     clean_text(F.col("COUNTRY")).alias("country"), clean_text(F.col("COLLEGE")).alias("organisation"), F.col("TEAM_ID").try_cast("bigint").alias("team_id"),
                     F.col("TEAM_ABBREVIATION").alias("team_abbr"), to_nullable_int(F.col("ROSTER_STATUS")).alias("roster_status"))
    return keep_first(out.where(F.col("player_id").isNotNull()), ["player_id"], [asc("player_name"), desc("to_year")])


def profiles(index: DataFrame, *, home: str = "USA", min_members: int = 3) -> DataFrame:
    """Origin and organisation type: an organisation listed by enough domestic entities counts as a college."""
    colleges = index.where((F.col("country") == home) & F.col("organisation").isNotNull()).groupBy("organisation").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= min_members)
    out = index.join(colleges, "organisation", "left")
    origin = F.when(F.col("country").isNull(), None).when(F.col("country") == home, "usa").otherwise("intl")
    return out.withColumn("origin", origin).withColumn("organisation_type", F.when(F.col("_n").isNotNull(), "college").otherwise("other")).drop("_n")


def rostered(index: DataFrame) -> DataFrame:
    return index.where(F.col("roster_status") == 1)


def incoming_class(index: DataFrame, year: int, known: DataFrame) -> DataFrame:
    """This year's draft class, not yet known."""
    return index.where(F.col("draft_year") == year).join(known.select("player_id").distinct(), "player_id", "left_anti")


def roster_snapshot(index: DataFrame, season: str, day: str) -> DataFrame:
    return rostered(index).select(F.lit(day).cast("date").alias("snapshot_date"), F.lit(season).alias("season"), "player_id", "player_name", "team_id", "team_abbr", "position",
                                  "draft_year", "draft_number")


def season_bio(payload: DataFrame, season: str, *, name: str = "LeagueDashPlayerBioStats") -> DataFrame:
    raw = result_rows(payload, name, ["PLAYER_ID", "TEAM_ID", "AGE"])
    out = raw.select(F.lit(season).alias("season"), F.col("PLAYER_ID").try_cast("bigint").alias("player_id"), F.col("TEAM_ID").try_cast("bigint").alias("team_id"), to_double(F.col("AGE")).alias("age"))
    return keep_first(out, ["season", "player_id"], [asc("team_id")])


def common_info(payload: DataFrame, *, name: str = "CommonPlayerInfo") -> DataFrame:
    """Birthdate and attributes of single-entity payloads."""
    raw = result_rows(payload, name, ["PERSON_ID", "DISPLAY_FIRST_LAST", "BIRTHDATE", "POSITION", "HEIGHT", "WEIGHT", "DRAFT_YEAR", "DRAFT_ROUND", "DRAFT_NUMBER", "FROM_YEAR", "TO_YEAR"])
    return raw.select(F.col("PERSON_ID").try_cast("bigint").alias("player_id"), F.col("DISPLAY_FIRST_LAST").alias("player_name"), parse_day(F.col("BIRTHDATE"), strict=False).alias("birthdate"),
                      position_code(F.col("POSITION")).alias("position"), parse_height_inches(F.col("HEIGHT")).alias("height_in"), to_double(F.col("WEIGHT")).alias("weight_lb"),
                      *[to_nullable_int(F.col(c)).alias(c.lower()) for c in ("DRAFT_YEAR", "DRAFT_ROUND", "DRAFT_NUMBER", "FROM_YEAR", "TO_YEAR")])


def combine(payload: DataFrame, *, name: str = "DraftCombineStats") -> DataFrame:
    names = {"HEIGHT_WO_SHOES": "height_in", "WEIGHT": "weight_lb", "WINGSPAN": "wingspan_in", "STANDING_REACH": "reach_in", "STANDING_VERTICAL_LEAP": "vertical_in",
             "MAX_VERTICAL_LEAP": "max_vertical_in", "LANE_AGILITY_TIME": "lane_agility_s", "THREE_QUARTER_SPRINT": "sprint_s", "BENCH_PRESS": "bench_reps"}
    raw = result_rows(payload, name, ["SEASON", "PLAYER_ID", *names])
    out = raw.select(to_nullable_int(F.col("SEASON")).alias("draft_year"), F.col("PLAYER_ID").try_cast("bigint").alias("player_id"), *[to_double(F.col(a)).alias(b) for a, b in names.items()]).dropna(subset=["draft_year", "player_id"])
    return keep_first(out, ["draft_year", "player_id"], [desc("height_in")])


# ------------------------------------------------------------------------------------------------ league payloads

LEAGUE_SCHEMA = """settings struct<name string, isPublic boolean, size int, rosterSettings struct<lineupSlotCounts map<string,int>>,
  scoringSettings struct<scoringType string, scoringItems array<struct<statId int, points double>>>,
  draftSettings struct<type string, orderType string, timePerSelection int, isTradingEnabled boolean, keeperCount int>,
  acquisitionSettings struct<acquisitionType string, waiverHours int, acquisitionLimit int, matchupAcquisitionLimit double>,
  tradeSettings struct<max int, deadlineDate bigint, revisionHours int, vetoVotesRequired int>,
  scheduleSettings struct<matchupPeriodCount int, playoffTeamCount int, playoffReseed boolean, matchupPeriods map<string,array<int>>>>,
  status struct<finalScoringPeriod int>,
  teams array<struct<id int, name string, abbrev string, divisionId int, owners array<string>,
    roster struct<entries array<struct<playerId bigint, lineupSlotId int, playerPoolEntry struct<player struct<id bigint, fullName string, defaultPositionId int, proTeamId int, injuryStatus string>>>>>>>,
  draftDetail struct<drafted boolean, inProgress boolean, picks array<struct<overallPickNumber int, roundId int, roundPickNumber int, teamId int, playerId bigint, keeper boolean>>>,
  players array<struct<id bigint, onTeamId int, player struct<id bigint, fullName string, defaultPositionId int, proTeamId int, injuryStatus string, injured boolean, lastNewsDate bigint,
    ownership struct<percentOwned double, averageDraftPosition double>>>>,
  transactions array<struct<id string, type string, status string, teamId int, scoringPeriodId int, items array<struct<playerId bigint, type string, fromTeamId int, toTeamId int>>>>"""
# Lineup slot numbers and stat numbers of the league payload.
SLOT_NAMES = {0: "PG", 1: "SG", 2: "SF", 3: "PF", 4: "C", 5: "G", 6: "F", 7: "SG/SF", 8: "G/F", 9: "PF/C", 10: "F/C", 11: "UTIL", 12: "BE", 13: "IR"}
STAT_KEYS = {0: "PTS", 1: "BLK", 2: "STL", 3: "AST", 6: "REB", 11: "TO", 13: "FGM", 14: "FGA", 15: "FTM", 16: "FTA", 17: "3PM"}


def _name_of(number: Column, names: dict[int, str]) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in names.items() for x in kv]), number)


def league_settings(payload: DataFrame) -> DataFrame:
    """(field, value) rows of the league's settings."""
    s = F.col("settings")
    plain = {"name": s["name"], "size": s["size"], "scoring_type": s["scoringSettings"]["scoringType"], "draft.type": s["draftSettings"]["type"],
             "draft.seconds_per_pick": s["draftSettings"]["timePerSelection"], "draft.pick_trading": s["draftSettings"]["isTradingEnabled"],
             "acquisition.type": s["acquisitionSettings"]["acquisitionType"], "acquisition.waiver_hours": s["acquisitionSettings"]["waiverHours"],
             "trades.review_hours": s["tradeSettings"]["revisionHours"], "trades.votes_to_veto": s["tradeSettings"]["vetoVotesRequired"],
             "schedule.matchup_periods": s["scheduleSettings"]["matchupPeriodCount"], "schedule.playoff_teams": s["scheduleSettings"]["playoffTeamCount"]}
    one = F.array(*[F.struct(F.lit(k).alias("field"), v.cast("string").alias("value")) for k, v in plain.items()])
    flat = payload.select(F.explode(one).alias("x")).select("x.*")
    slots = payload.select(F.explode(s["rosterSettings"]["lineupSlotCounts"]).alias("k", "v")).where(F.col("v") > 0).select(
        F.concat(F.lit("slot."), _name_of(F.col("k").cast("int"), SLOT_NAMES)).alias("field"), F.col("v").cast("string").alias("value"))
    scoring = payload.select(F.explode(s["scoringSettings"]["scoringItems"]).alias("i")).select(_name_of(F.col("i.statId"), STAT_KEYS).alias("k"), F.col("i.points").alias("v")).where("k is not null").select(
        F.concat(F.lit("scoring."), F.col("k")).alias("field"), F.col("v").cast("string").alias("value"))
    return flat.unionByName(slots).unionByName(scoring)


def league_periods(payload: DataFrame) -> DataFrame:
    """(week, scoring_period)."""
    return payload.select(F.explode(F.col("settings.scheduleSettings.matchupPeriods")).alias("k", "v")).select(F.col("k").cast("int").alias("week"), F.explode("v").alias("scoring_period"))


def league_teams(payload: DataFrame) -> DataFrame:
    return payload.select(F.explode("teams").alias("t")).select(F.col("t.id").alias("team_id"), F.col("t.name").alias("name"), F.col("t.abbrev").alias("abbrev"), F.col("t.divisionId").alias("division_id"),
                                                                F.col("t.owners").alias("owner_ids"))


def league_rosters(payload: DataFrame) -> DataFrame:
    """One row per team and member."""
    e = payload.select(F.explode("teams").alias("t")).select(F.col("t.id").alias("team_id"), F.explode("t.roster.entries").alias("e"))
    p = F.col("e.playerPoolEntry.player")
    return e.select("team_id", F.coalesce(p["id"], F.col("e.playerId")).cast("string").alias("source_id"), p["fullName"].alias("name"), F.col("e.lineupSlotId").alias("lineup_slot_id"),
                    _name_of(F.col("e.lineupSlotId"), SLOT_NAMES).alias("lineup_slot"), p["injuryStatus"].alias("injury_status"))


def league_draft(payload: DataFrame) -> DataFrame:
    d = payload.select(F.explode("draftDetail.picks").alias("p"))
    return d.select(F.col("p.overallPickNumber").alias("overall_pick"), F.col("p.roundId").alias("round"), F.col("p.roundPickNumber").alias("round_pick"), F.col("p.teamId").alias("team_id"),
                    F.when(F.col("p.playerId") >= 0, F.col("p.playerId")).cast("string").alias("source_id"), F.col("p.keeper").alias("keeper"))


def league_free_agents(payload: DataFrame) -> DataFrame:
    e = payload.select(F.explode("players").alias("e"))
    p = F.col("e.player")
    return e.select(F.coalesce(p["id"], F.col("e.id")).cast("string").alias("source_id"), p["fullName"].alias("name"), p["proTeamId"].alias("pro_team_id"), p["injuryStatus"].alias("injury_status"),
                    p["injured"].alias("injured"), p["lastNewsDate"].alias("news_ms"), p["ownership"]["percentOwned"].alias("percent_owned"), p["ownership"]["averageDraftPosition"].alias("adp"), F.col("e.onTeamId").alias("on_team_id"))


def league_moves(payload: DataFrame) -> DataFrame:
    """One row per transaction item."""
    t = payload.select(F.explode("transactions").alias("t"))
    return t.select(F.col("t.id").alias("id"), F.col("t.type").alias("type"), F.col("t.status").alias("status"), F.col("t.teamId").alias("team_id"), F.explode_outer("t.items").alias("i")).select(
        "id", "type", "status", "team_id", F.col("i.type").alias("item_type"), F.col("i.playerId").cast("string").alias("source_id"))


def with_entity_ids(rows: DataFrame, id_map: DataFrame, source: str, *, min_confidence: float = 0.0) -> DataFrame:
    """``player_id`` through the id map, null where it has none. A source id has one row in the map."""
    ids = id_map.where((F.col("source") == source) & (F.col("confidence") >= min_confidence)).select("source_id", "player_id").dropDuplicates(["source_id"])
    return rows.join(ids, "source_id", "left")


def status_snapshot(players: DataFrame, season: str, day: str, id_map: DataFrame) -> DataFrame:
    named = players.where(F.col("source_id").isNotNull() & F.col("name").isNotNull())
    out = with_entity_ids(named, id_map, "espn")
    return out.select(F.lit(day).cast("date").alias("snapshot_date"), F.lit(season).alias("season"), F.col("source_id").try_cast("bigint").alias("source_id"), "player_id", F.col("name").alias("player_name"),
                      F.col("pro_team_id").cast("bigint").alias("pro_team_id"), F.coalesce("injury_status", F.lit("UNKNOWN")).alias("injury_status"), F.coalesce("injured", F.lit(False)).alias("injured"),
                      F.timestamp_millis("news_ms").alias("last_news_date"))


INJURY_FEED_SCHEMA = """injuries array<struct<injuries array<struct<id string, status string, date string, shortComment string, longComment string,
  athlete struct<id string, displayName string, team struct<abbreviation string>>,
  details struct<type string, location string, detail string, side string, returnDate string, fantasyStatus struct<abbreviation string>>>>>>"""
ARTICLE_FEED_SCHEMA = """articles array<struct<id string, headline string, description string, published string, links struct<web struct<href string>>,
  categories array<struct<type string, athleteId bigint, description string>>>>"""


def injury_notes(payload: DataFrame, seen_at: str, id_map: DataFrame) -> DataFrame:
    """One row per (note, status)."""
    i = payload.select(F.explode("injuries").alias("t")).select(F.explode("t.injuries").alias("i")).where(F.col("i.id").isNotNull() & F.col("i.athlete.displayName").isNotNull())
    text = lambda c: F.coalesce(c, F.lit(""))     # noqa: E731
    d = F.col("i.details")
    status = F.trim(text(F.col("i.status")))
    rows = i.select(F.col("i.id").alias("note_id"), F.col("i.athlete.id").alias("source_id"), F.col("i.athlete.displayName").alias("player_name"), text(F.col("i.athlete.team.abbreviation")).alias("team_abbr"),
                    F.when(status == "", "Unknown").otherwise(status).alias("status"), text(d["type"]).alias("injury_type"), text(d["location"]).alias("body_part"), text(d["detail"]).alias("detail"),
                    text(d["side"]).alias("side"), F.substring(d["returnDate"], 1, 10).try_cast("date").alias("return_date"), text(d["fantasyStatus"]["abbreviation"]).alias("fantasy_status"),
                    F.col("i.shortComment").alias("headline"), F.col("i.longComment").alias("text"), F.col("i.date").try_cast("timestamp").alias("published"),
                    F.lit(seen_at).cast("timestamp").alias("first_seen"), F.lit(seen_at).cast("timestamp").alias("last_seen"))
    return with_entity_ids(keep_first(rows, ["note_id", "status"], [desc("published"), asc("player_name")]), id_map, "espn")


def article_mentions(payload: DataFrame, seen_at: str, id_map: DataFrame, *, few: int = 3) -> DataFrame:
    """Article x entity rows: everyone linked when they are few, else those the headline names."""
    a = payload.select(F.explode("articles").alias("a")).where(F.col("a.id").isNotNull() & (F.col("a.headline") != ""))
    linked = F.filter("a.categories", lambda c: (c["type"] == "athlete") & c["athleteId"].isNotNull())
    about = F.when(F.size("_l") <= few, F.col("_l")).otherwise(F.filter("_l", lambda c: F.contains(F.lower("a.headline"), F.lower(c["description"]))))
    rows = a.withColumn("_l", linked).withColumn("_x", F.explode(about)).select(
        F.col("a.id").alias("article_id"), F.col("_x.athleteId").cast("string").alias("source_id"), F.col("_x.description").alias("player_name"), F.size("_l").alias("n_athletes"),
        F.col("a.headline").alias("headline"), F.col("a.description").alias("description"), F.coalesce("a.links.web.href", F.lit("")).alias("url"), F.col("a.published").try_cast("timestamp").alias("published"),
        F.lit(seen_at).cast("timestamp").alias("first_seen"), F.lit(seen_at).cast("timestamp").alias("last_seen"))
    return with_entity_ids(keep_first(rows, ["article_id", "source_id"], [desc("published"), asc("player_name")]), id_map, "espn")


SCHEDULE_SCHEMA = "settings struct<proTeams array<struct<id int, proGamesByScoringPeriod map<string,array<struct<id bigint, date bigint, scoringPeriodId int, homeProTeamId int, awayProTeamId int, startTimeTBD boolean>>>>>>"


def pro_schedule(payload: DataFrame, teams: DataFrame, season: str) -> DataFrame:
    """One row per game. The local day is day zero plus the scoring period; day zero is the most common (UTC minus 6 h) offset.

    ``teams``: (pro_team_id, team_id, team_abbr).
    """
    g = payload.select(F.explode("settings.proTeams").alias("t")).select(F.explode("t.proGamesByScoringPeriod").alias("_k", "_v")).select(F.explode("_v").alias("g")).select("g.*")
    g = g.groupBy("id").agg(*[F.min(c).alias(c) for c in ("date", "scoringPeriodId", "homeProTeamId", "awayProTeamId", "startTimeTBD")])
    offset = F.date_sub(F.to_date(F.timestamp_millis("date") - F.expr("INTERVAL 6 HOURS")), F.col("scoringPeriodId") - 1)
    counted = g.groupBy(offset.alias("_d")).agg(F.count(F.lit(1)).alias("_n"))
    zero = counted.agg(F.max_by("_d", F.struct("_n", -F.unix_date("_d")))).scalar()
    side = lambda p: teams.select(F.col("pro_team_id").alias(p + "ProTeamId"), F.col("team_id").alias(p + "_team_id"), F.col("team_abbr").alias(p + "_abbr"))     # noqa: E731
    out = g.join(F.broadcast(side("home")), "homeProTeamId").join(F.broadcast(side("away")), "awayProTeamId")       # a league's teams: a few dozen rows
    return out.select(F.lit(season).alias("season"), F.col("id").cast("string").alias("game_id"), F.col("scoringPeriodId").cast("bigint").alias("scoring_period"), F.date_add(zero, F.col("scoringPeriodId") - 1).alias("game_date"),
                      "home_team_id", "away_team_id", "home_abbr", "away_abbr", F.lit("espn").alias("source"), F.coalesce("startTimeTBD", F.lit(False)).alias("time_tbd"))



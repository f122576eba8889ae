"""Optional flag sources joined onto a board: row order and projections stay as they are."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from tallyline.functions.flags import advisory_games_risk, advisory_games_upside
from tallyline.functions.names import normalize_name
from tallyline.functions.rules import news_kinds, report_kind
from tallyline.operators.matching import in_cohort, in_universe
from tallyline.operators.merge import latest_per_key
from tallyline.operators.ranking import asc, desc, top_k

# Thresholds and advisory shares of the risk overlay.
ROTATION_MPG, MIN_TEAM_GAMES, PARTIAL_SHARE = 15.0, 3, 0.5
STATUS_HAIRCUT = {"OUT": 0.20, "DAY_TO_DAY": 0.03, "SUSPENDED": 0.10}
STALE_NEWS_DAYS, NEWS_DAYS, MIN_REPORT_GAMES, MIN_OPENED = 45, 60, 3, 20.0


def attach(board: DataFrame, overlay: DataFrame, *, entity: str = "player_id", defaults: dict | None = None) -> DataFrame:
    """Left join of an overlay with one row per entity; its missing values take the defaults."""
    extra = [c for c in overlay.columns if c != entity and c in board.columns]
    return board.drop(*extra).join(overlay.dropDuplicates([entity]), entity, "left").na.fill(defaults or {})


def preseason_flags(board: DataFrame, team_of: DataFrame, played: DataFrame, team_played: DataFrame, *, entity: str = "player_id", group: str = "team_id") -> DataFrame:
    """``pre_flag`` 'dnp_all' or 'partial' for projected regulars with a history who sat out their group's warm-up events."""
    j = board.select(entity, "proj_mpg", "n_hist").join(team_of.select(entity, group), entity, "left").join(played.select(entity, F.col("gp").alias("pre_gp")), entity, "left").join(
        team_played.select(group, F.col("gp").alias("team_pre_games")), group, "left").na.fill({"pre_gp": 0})
    share = F.when(F.col("team_pre_games") > 0, F.col("pre_gp") / F.col("team_pre_games"))
    ok = (F.col("n_hist") >= 1) & (F.col("proj_mpg") >= ROTATION_MPG) & (F.col("team_pre_games") >= MIN_TEAM_GAMES)
    flag = F.when(ok & (F.col("pre_gp") == 0), "dnp_all").when(ok & (share < PARTIAL_SHARE), "partial").otherwise("")
    return j.select(entity, "pre_gp", "team_pre_games", share.alias("pre_share"), flag.alias("pre_flag"))


def status_flags(status: DataFrame, today: Column, *, entity: str = "player_id") -> DataFrame:
    s = latest_per_key(status.where(F.col(entity).isNotNull()), [entity], "snapshot_date")
    age = F.datediff(today, F.to_date("last_news_date"))
    return s.select(entity, F.col("injury_status").alias("espn_status"), age.cast("double").alias("status_news_days"), F.coalesce(age > STALE_NEWS_DAYS, F.lit(False)).alias("status_stale"))


def injury_note_flags(notes: DataFrame, *, entity: str = "player_id") -> DataFrame:
    """``news_flag``: newest note per entity that is still in the latest pull."""
    n = latest_per_key(notes.where(F.col(entity).isNotNull()), [entity], "published", seen="last_seen")
    empty = lambda c: F.coalesce(F.col(c), F.lit(""))       # noqa: E731
    kind = F.when(empty("injury_type") != "", F.col("injury_type")).otherwise(empty("detail"))
    what = F.trim(F.concat_ws(" ", kind, F.when(empty("body_part") != "", F.concat(F.lit("("), F.col("body_part"), F.lit(")")))))
    back = F.when(F.col("return_date").isNotNull(), F.concat(F.lit(", est. return "), F.date_format("return_date", "MMM dd"))).otherwise("")
    return n.select(entity, F.concat(F.lit("news: "), F.lower("status"), F.when(what != "", F.concat(F.lit(", "), F.lower(what))).otherwise(""), back).alias("news_flag"))


def context_flags(roster: DataFrame, last_team: DataFrame, stars: DataFrame, names: DataFrame, *, entity: str = "player_id", group: str = "team_id") -> DataFrame:
    """``new_team``, and the stars who arrived at or left the entity's group, the entity itself left out.

    The list is of stars per group, a fixed number of ranked entities, never of members.
    """
    now = roster.select(entity, group).dropDuplicates([entity]).join(last_team.select(entity, F.col(group).alias("_prev")), entity, "left")
    moved = F.col("_prev").isNotNull() & (F.col("_prev") != F.col(group))
    star = now.where(moved).join(stars.select(entity), entity, "left_semi").join(names.select(entity, "name"), entity, "left")
    label = F.struct(F.col(entity).alias("id"), F.coalesce("name", F.col(entity).cast("string")).alias("name"))
    came = star.groupBy(group).agg(F.sort_array(F.collect_list(label)).alias("_in"))
    left = star.groupBy(F.col("_prev").alias(group)).agg(F.sort_array(F.collect_list(label)).alias("_out"))
    j = now.join(came, group, "left").join(left, group, "left")
    others = lambda c: F.array_join(F.transform(F.filter(c, lambda x: x["id"] != F.col(entity)), lambda x: x["name"]), ", ")     # noqa: E731
    text = lambda c, side: F.when(F.coalesce(others(c), F.lit("")) != "", F.concat(F.lit(f"star {side}: "), others(c))).otherwise("")
    return j.select(entity, group, moved.alias("new_team"), F.when(moved, F.col("_prev")).alias("from_group"), text("_in", "arrived").alias("star_arrivals"), text("_out", "left").alias("star_departures"))


def depth_flags(roster: DataFrame, opened: DataFrame, projected: DataFrame, *, entity: str = "player_id", group: str = "team_id") -> DataFrame:
    o = opened.where(F.col("net") >= MIN_OPENED)
    text = F.format_string("minutes opened: lost %.0f, %.0f arrived, net %.0f", "opened", "incoming", "net")
    return roster.select(entity, group).dropDuplicates([entity]).join(projected.select(entity), entity, "left_semi").join(o, group).select(entity, text.alias("depth_flag"))


def closing_stage_flags(closing: DataFrame, regular: DataFrame, *, entity: str = "player_id", order: tuple[str, ...] = ("game_date", "game_id"), last: int = 5, min_events: int = 5, uplift: float = 4.0) -> DataFrame:
    """Members whose role in the last events of the closing stage was much bigger than before."""
    n = closing.groupBy(entity).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= min_events)
    late = top_k(closing, [entity], [desc(c) for c in order], last, "_k").groupBy(entity).agg(F.avg("min").alias("_late"), F.count(F.lit(1)).alias("_m"))
    base = regular.groupBy(entity).agg(F.avg("min").alias("_base"))
    j = late.join(n, entity).join(base, entity, "left").na.fill({"_base": 0.0}).where(F.col("_late") >= F.col("_base") + uplift)
    return j.select(entity, F.format_string("playoffs: %.0f mpg over the last %d of %d games (regular season %.0f mpg)", "_late", "_m", "_n", "_base").alias("playoff_flag"))


def report_flags(reports: DataFrame, season: str, *, entity: str = "player_id") -> DataFrame:
    """Distinct days out per off-court kind in the newest earlier season."""
    start = F.substring("season", 1, 4).cast("int")
    prior = reports.where((start < int(season[:4])) & F.col(entity).isNotNull())
    last = prior.where(start == prior.agg(F.max(start)).scalar()).where(F.col("status") == "Out").withColumn("kind", report_kind(F.col("category"), F.col("detail"))).where(F.col("kind") != "")
    n = last.select(entity, "game_date", "kind", "season").distinct().groupBy(entity, "kind").agg(F.count(F.lit(1)).alias("n"), F.max("season").alias("season")).where(F.col("n") >= MIN_REPORT_GAMES)
    parts = F.sort_array(F.collect_list(F.struct((-F.col("n")).alias("o"), F.format_string("%d games out for %s", "n", "kind").alias("t"))))        # a handful of kinds
    return n.groupBy(entity).agg(F.concat(F.array_join(F.transform(parts, lambda x: x["t"]), "; "), F.lit(" in "), F.max("season")).alias("report_flag"))


def article_flags(articles: DataFrame, today: Column, *, entity: str = "player_id", days: int = NEWS_DAYS, chars: int = 60) -> DataFrame:
    """Newest article per kind within the last ``days``."""
    tagged = articles.withColumn("kinds", news_kinds(F.col("headline"), F.col("description"))).where((F.col("kinds") != "") & F.col(entity).isNotNull())
    recent = tagged.where(F.datediff(today, F.to_date("published")).between(0, days)).withColumn("kind", F.explode(F.split("kinds", ", ")))
    best = recent.groupBy(entity, "kind").agg(F.max_by(F.struct("published", "headline"), F.struct("published", "headline")).alias("a"))
    line = F.concat(F.col("kind"), F.lit(": "), F.substring(F.col("a.headline"), 1, chars))
    rows = F.sort_array(F.collect_list(F.struct(F.col("a.published").alias("p"), line.alias("t"))), asc=False)                                       # a handful of kinds
    return best.groupBy(entity).agg(F.array_join(F.transform(rows, lambda x: x["t"]), "; ").alias("offcourt_news"))


def offcourt_flags(board: DataFrame, reports: DataFrame, articles: DataFrame, season: str, today: Column, *, entity: str = "player_id") -> DataFrame:
    j = board.select(entity).join(report_flags(reports, season, entity=entity), entity, "left").join(article_flags(articles, today, entity=entity), entity, "left")
    return j.select(entity, F.concat_ws("; ", "report_flag", "offcourt_news").alias("offcourt_flag"))


def note_flags(board: DataFrame, notes: DataFrame, *, entity: str = "player_id") -> tuple[DataFrame, DataFrame]:
    """(flags, unresolved): notes matched by id, else by a name only one row of the board has."""
    names = board.select(entity, normalize_name(F.col("name")).alias("_n")).groupBy("_n").agg(F.count(F.lit(1)).alias("_c"), F.min(entity).alias("_id")).where(F.col("_c") == 1)
    j = notes.withColumn("_n", normalize_name(F.col("name"))).join(names, "_n", "left").withColumn("_who", F.coalesce(F.col(entity), F.col("_id")))
    flags = j.where(F.col("_who").isNotNull()).groupBy(F.col("_who").alias(entity)).agg(F.array_join(F.sort_array(F.collect_set("note")), "; ").alias("note_flag"))
    return flags, j.where(F.col("_who").isNull()).select("name", "note")


def build_overlay(board: DataFrame, sources: dict[str, DataFrame], *, entity: str = "player_id") -> DataFrame:
    """``risk_flags`` text, ``risk_level`` ('', watch, high), ``risk_gp_haircut`` and ``risk_gp``. Sources that are missing are skipped."""
    out = board
    for s in sources.values():
        out = attach(out, s, entity=entity)
    has = lambda c: c in out.columns       # noqa: E731
    texts, levels, cuts = [], [F.lit(0)], [F.lit(0.0)]
    if has("pre_flag"):
        texts.append(F.when(F.col("pre_flag") == "dnp_all", F.format_string("played 0 of %d preseason games", "team_pre_games"))
                     .when(F.col("pre_flag") == "partial", F.format_string("played %d of %d preseason games", "pre_gp", "team_pre_games")))
        levels.append(F.when(F.col("pre_flag") == "dnp_all", 1).otherwise(0))
    if has("espn_status"):
        hit = F.col("espn_status").isin(*STATUS_HAIRCUT)
        cut = reduce(lambda acc, kv: F.when(F.col("espn_status") == kv[0], kv[1]).otherwise(acc), STATUS_HAIRCUT.items(), F.lit(0.0))
        stale = F.coalesce(F.col("status_stale"), F.lit(False))
        texts.append(F.when(hit, F.concat(F.lit("status: "), F.lower("espn_status"), F.when(stale, " (stale)").otherwise(""))))
        levels.append(F.when(hit & stale, 1).when(F.col("espn_status") == "OUT", 2).when(hit, 1).otherwise(0))
        cuts.append(F.when(stale, 0.0).otherwise(F.coalesce(cut, F.lit(0.0))))
    if has("new_team"):
        texts.append(F.when(F.col("new_team"), "new team"))
    for c in ("star_arrivals", "star_departures", "depth_flag", "playoff_flag", "news_flag", "offcourt_flag", "note_flag"):
        if has(c):
            texts.append(F.when(F.col(c) != "", F.col(c)))
    flags = F.array_join(F.array_compact(F.array(*texts)), "; ") if texts else F.lit("")
    level = F.greatest(*levels, F.lit(0))
    haircut = F.greatest(*cuts, F.lit(0.0))
    return out.withColumn("risk_flags", flags).withColumn("risk_level", F.when(level >= 2, "high").when(level == 1, "watch").otherwise("")).withColumn("risk_gp_haircut", haircut).withColumn(
        "risk_gp", F.col("proj_gp") * (1 - F.col("risk_gp_haircut")))


def return_flags(board: DataFrame, profile: DataFrame, *, season_games: float = 82.0, entity: str = "player_id") -> DataFrame:
    """Members of the return-from-absence cohort in the last period's profile (with ``veteran`` and ``mpg``)."""
    ok = profile.where(in_cohort(universe=in_universe()))
    j = ok.join(board.select(entity, "proj_gp", "proj_fppg"), entity)
    share = F.col("first_idx") / F.col("n_events")
    up = advisory_games_upside(share, F.col("proj_gp"), season_games)
    return j.select(entity, F.lit("returned-healthy").alias("return_label"), share.alias("return_block_pct"), F.col("tail_len").alias("return_tail"), up.alias("return_gp_upside_adv"),
                    (up * F.col("proj_fppg")).alias("return_fp_upside_adv"), F.col("n_events").alias("return_events"), F.col("first_idx").alias("return_first"), F.col("gp").alias("return_gp"))


def short_absence_flags(board: DataFrame, profile: DataFrame, *, min_mpg: float = 20.0, min_gp: int = 41, min_iso: int = 6, entity: str = "player_id") -> DataFrame:
    ok = profile.where(F.col("veteran") & (F.col("n_groups") == 1) & (F.col("mpg") >= min_mpg) & (F.col("gp") >= min_gp) & (F.col("iso_n") >= min_iso))
    j = ok.join(board.select(entity, "proj_gp"), entity)
    adv = advisory_games_risk(F.col("iso_n"), F.col("proj_gp"))
    return j.select(entity, F.lit("short-absences").alias("lm_label"), "iso_n", "rest_n", adv.alias("lm_gp_adv"), F.col("gp").alias("lm_gp"), F.col("n_events").alias("lm_events"))


def annotate_moves(moves: DataFrame, board: DataFrame, roster: DataFrame, *, relevant_rank: int = 180, mates: int = 3, entity: str = "player_id") -> DataFrame:
    """Rank and relevance of each move, with the best-ranked members of its destination (the mover left out)."""
    b = board.select(entity, "rank", "name", "position").dropDuplicates([entity])
    ranked = roster.select(entity, "team_abbr").dropDuplicates([entity]).join(b, entity)
    top = top_k(ranked, ["team_abbr"], [asc("rank"), asc(entity)], mates + 1, "_k").groupBy("team_abbr").agg(
        F.sort_array(F.collect_list(F.struct("rank", F.col(entity).alias("id"), "name"))).alias("_mates"))
    j = moves.join(b.select(entity, "rank", "position"), entity, "left").join(top.withColumnRenamed("team_abbr", "to_abbr"), "to_abbr", "left")
    listed = F.slice(F.filter("_mates", lambda m: ~m["id"].eqNullSafe(F.col(entity))), 1, mates)
    text = F.array_join(F.transform(listed, lambda m: F.format_string("%s (#%d)", m["name"], m["rank"])), ", ")
    relevant = F.coalesce(F.col("rank") <= relevant_rank, F.lit(False))
    return j.withColumn("relevant", relevant).withColumn("context", F.when(relevant & (F.coalesce(text, F.lit("")) != ""), F.concat(F.col("to_abbr"), F.lit(" best teammates: "), text)).otherwise("")).drop("_mates")


def digest(annotated: DataFrame, day: str, *, limit: int = 60, order: list[str] | None = None) -> DataFrame:
    """First ``limit`` lines per day and how many more there were (a report)."""
    n = annotated.groupBy(day).agg(F.count(F.lit(1)).alias("n_all"))
    head = top_k(annotated, [day], [asc(c) for c in (order or ["rank", "person"])], limit, "line_no")
    return head.join(n, day).withColumn("n_hidden", F.greatest(F.col("n_all") - limit, F.lit(0)))


def leader_table(opening: DataFrame, shift: DataFrame, *, period: str = "s", group: str = "team_id") -> DataFrame:
    """Group, leader, whether new, and the expected change of style."""
    return opening.select(period, group, "coach_name").join(shift, [period, group])


def affected_members(table: DataFrame, board: DataFrame, roster: DataFrame, *, top: int = 150, entity: str = "player_id", group: str = "team_id") -> DataFrame:
    changed = table.where("is_new").select(group, "coach_name")
    return board.where(F.col("rank") <= top).join(roster.select(entity, group).dropDuplicates([entity]), entity).join(changed, group)

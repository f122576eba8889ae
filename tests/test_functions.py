import pytest
from pyspark.sql import functions as F

from tallyline.functions import flags, names, parsing, periods, positions, rules, scoring


def one(spark, *cols):
    return spark.range(1).select(*cols).first()


def test_season_labels_round_trip_and_reject_junk(spark):
    row = one(spark, periods.season_label(F.lit(1999)), periods.season_year(F.lit("2023-24")), periods.season_label(F.lit(2009)))
    assert list(row) == ["1999-00", 2023, "2009-10"]
    with pytest.raises(Exception):
        one(spark, periods.season_year(F.lit("2023-25")))
    assert periods.expand_season_spec("2015-16:2017-18,2016-17") == ["2015-16", "2016-17", "2017-18"]


def test_calendar_turns(spark):
    d = lambda s: F.lit(s).cast("date")     # noqa: E731
    row = one(spark, periods.follows_season(d("2024-09-30")), periods.follows_season(d("2024-10-01")), periods.covers_from_season(d("2024-07-01")), periods.covers_from_season(d("2024-06-30")),
              periods.season_of_day(d("2020-08-15"), F.lit(None).cast("string")), periods.season_of_day(d("2021-08-15"), F.lit(None).cast("string")))
    assert list(row) == [2023, 2024, 2024, 2023, "2019-20", "2021-22"]


def test_last_complete_day_uses_local_time(spark):
    t = lambda s: periods.last_complete_local_day(F.lit(s).cast("timestamp"))      # noqa: E731
    row = one(spark, t("2026-01-10 08:29:00"), t("2026-01-10 08:30:00"))
    assert [str(x) for x in row] == ["2026-01-08", "2026-01-09"]


@pytest.mark.parametrize("name,key", [("Luka Dončić", "luka doncic"), ("Jimmy Butler III", "jimmy butler"), ("Gary Trent Jr.", "gary trent"), ("D'Angelo Russell", "d angelo russell"), ("Nené", "nene")])
def test_normalize_name(spark, name, key):
    assert one(spark, names.normalize_name(F.lit(name)))[0] == key


def test_alias_and_valid_names(spark):
    row = one(spark, names.alias_key(F.lit("Cameron Johnson")), names.valid_name(F.lit("Ann Bell")), names.valid_name(F.lit("Ann bell")), names.valid_name(F.lit("Ann")), names.valid_name(F.lit("Juan de Vries")), names.display_name(F.lit("Moore Jr., Wendell")))
    assert list(row) == ["cam johnson", True, False, False, True, "Wendell Moore Jr."]


def test_parsers(spark):
    row = one(spark, parsing.parse_minutes(F.lit("34:30")), parsing.parse_minutes(F.lit("-")), parsing.parse_height_inches(F.lit("6-9")), parsing.position_code(F.lit("Guard-Forward")),
              parsing.parse_years(F.lit("a two-year deal")), parsing.parse_years(F.lit("24 years old")), parsing.parse_amount(F.lit("worth $54.3 million")), parsing.parse_amount(F.lit("$12")))
    assert list(row) == [34.5, None, 81.0, "G-F", 2, None, 54300000.0, None]
    with pytest.raises(Exception):
        one(spark, parsing.parse_minutes(F.lit("lots")))
    day = one(spark, parsing.first_day_in_text(F.lit("signed on July 9 by"), F.lit(2023)), parsing.first_day_in_text(F.lit("3 March 2024, then May 1, 2025"), F.lit(2023)), parsing.first_day_in_text(F.lit("none"), F.lit(2023)))
    assert [(str(d["day"]), d["source"]) for d in day] == [("2023-07-09", "cell_no_year"), ("2024-03-03", "cell"), ("None", "none")]


def test_positions(spark):
    row = one(spark, positions.eligible_slots(F.lit("F-C")), positions.eligible_positions(F.lit("PG-SG")), positions.position_group(F.lit("C-F")), positions.eligible_slots(F.lit(None).cast("string")))
    assert list(row) == [["PF", "C", "F", "UTIL"], ["PG", "SG"], "C", ["UTIL"]]


def test_reason_rules(spark):
    kind = lambda c, d: rules.classify_reason(F.lit(c), F.lit(d))["kind"]        # noqa: E731
    row = one(spark, kind("Injury/Illness", "Left Knee; Sprain"), kind("Injury/Illness", "N/A; Illness"), kind("Rest", ""), kind("G League - Two-Way", ""), kind("Injury/Illness", "Right Ankle; Injury Recovery"), kind("Personal Reasons", ""))
    assert list(row) == ["injury", "illness", "rest", "g_league", "recovery", "personal"]
    tags = one(spark, rules.news_kinds(F.lit("Star requests trade"), F.lit("")), rules.news_kinds(F.lit("Star denies trade request"), F.lit("")), rules.report_kind(F.lit("Not With Team"), F.lit("Return to competition reconditioning")))
    assert list(tags) == ["trade request", "", ""]


def test_scores_and_flags(spark):
    df = spark.createDataFrame([(10, 5, 2)], "pts int, reb int, tov int")
    assert df.select(scoring.weighted_score(df, {"PTS": 1, "REB": 1.5, "TO": -2}, columns=scoring.STAT_COLUMNS)).first()[0] == 13.5
    with pytest.raises(KeyError):
        scoring.weighted_score(df, {"AST": 1}, columns=scoring.STAT_COLUMNS)
    row = one(spark, flags.confidence_bucket(F.lit(10.0), F.lit(4.0)), flags.confidence_bucket(F.lit(-1.0), F.lit(0.0)), flags.advisory_games_risk(F.lit(7), F.lit(1.0)), flags.advisory_games_upside(F.lit(0.7), F.lit(80.0)))
    assert list(row) == ["lean_your_way", "clear_loss", -1.0, 2.0]
    assert one(spark, scoring.shrink(F.lit(1.0), F.lit(0.0), F.lit(0.0), 5.0), scoring.posterior_mean(F.lit(10.0), F.lit(20.0), F.lit(5), 5.0))[1] == 15.0

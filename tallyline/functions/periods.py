"""Season labels, calendar turns and ages as column expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column, functions as F

LABEL_PATTERN = r"^(\d{4})-(\d{2})$"


def season_label(year: Column) -> Column:
    """2023 -> '2023-24'."""
    return F.format_string("%d-%02d", year.cast("int"), F.pmod(year.cast("int") + 1, F.lit(100)))


def season_year(label: Column) -> Column:
    """'2023-24' -> 2023; a malformed label raises, null stays null."""
    year = F.try_to_number(F.regexp_extract(label, LABEL_PATTERN, 1), F.lit("9999")).cast("int")
    fine = label.rlike(LABEL_PATTERN) & (season_label(year) == label)
    return F.when(label.isNull(), F.lit(None).cast("int")).when(fine, year).otherwise(
        F.raise_error(F.concat(F.lit("malformed season "), label)).cast("int"))


def season_year_fast(label: Column) -> Column:
    """Start year of a label already known to be well formed."""
    return F.substring(label, 1, 4).cast("int")


def season_labels_between(first: int, last: int) -> list[str]:
    return [f"{y}-{(y + 1) % 100:02d}" for y in range(first, last + 1)]


def expand_season_spec(spec: str) -> list[str]:
    """'2015-16:2017-18,2020-21' -> every label named, in order and once."""
    def year(text: str) -> int:
        match = re.fullmatch(r"(\d{4})-(\d{2})", text.strip())
        if not match or (int(match[1]) + 1) % 100 != int(match[2]):
            raise ValueError(f"malformed season {text!r}")
        return int(match[1])

    out: list[str] = []
    for part in filter(None, (p.strip() for p in spec.split(","))):
        first, _, last = part.partition(":")
        lo, hi = year(first), year(last or first)
        if hi < lo:
            raise ValueError(f"empty season range {part!r}")
        out.extend(s for s in season_labels_between(lo, hi) if s not in out)
    return out


def explode_season_range(first: Column, last: Column) -> Column:
    """Generator of the start years from ``first`` to ``last``."""
    return F.explode(F.sequence(first.cast("int"), last.cast("int")))


def previous_season(label: Column) -> Column:
    return season_label(season_year_fast(label) - 1)


def season_end_year(label: Column) -> Column:
    return season_year_fast(label) + 1


def year_turning(day: Column, first_month: int) -> Column:
    """Year whose 12-month span, starting in ``first_month``, holds ``day``."""
    return F.year(F.add_months(day, -(first_month - 1)))


def follows_season(day: Column) -> Column:
    """Start year of the season an event on ``day`` follows (turn on 1 October)."""
    return year_turning(day, 10)


def covers_from_season(day: Column) -> Column:
    """Start year of the first season a deal signed on ``day`` covers (turn on 1 July)."""
    return year_turning(day, 7)


def age_on_october_first(birth: Column, year: Column) -> Column:
    return F.datediff(F.make_date(year, F.lit(10), F.lit(1)), birth) / F.lit(365.25)


def season_of_day(day: Column, listed: Column) -> Column:
    """Season of a day: a schedule lookup first, then the August turn; the bubble months of 2020 belong to 2019-20."""
    late_finish = day.between(F.lit("2020-07-30").cast("date"), F.lit("2020-10-12").cast("date"))
    return F.coalesce(listed, F.when(late_finish, F.lit("2019-20")).otherwise(season_label(year_turning(day, 8))))


# Calendar window of each off-season event context, as (month, day) of its first and last day.
EVENT_WINDOWS = {"summer_league": ((6, 1), (9, 30)), "preseason": ((9, 1), (12, 31))}


def event_window(context: Column, year: Column) -> tuple[Column, Column]:
    """First and last calendar day of an event context in a year."""
    def edge(i: int) -> Column:
        out = F.lit(None).cast("date")
        for name, days in EVENT_WINDOWS.items():
            month, day = days[i]
            out = F.when(context == name, F.make_date(year, F.lit(month), F.lit(day))).otherwise(out)
        return out
    return edge(0), edge(1)


def last_complete_local_day(instant: Column, *, zone: str = "America/New_York", settle_hours: float = 3.5) -> Column:
    """UTC instant -> the newest local date whose games have all ended."""
    local = F.from_utc_timestamp(instant, zone)
    return F.date_sub(F.to_date(local - F.expr(f"INTERVAL {int(settle_hours * 60)} MINUTES")), 1)


def zone_offset_hours(instant: Column, zone: str = "America/New_York") -> Column:
    seconds = F.unix_timestamp(F.from_utc_timestamp(instant, zone)) - F.unix_timestamp(instant)
    return (seconds / 3600).cast("int")


def is_live_on(day: Column, year: Column) -> Column:
    """Does a draft-day overlay for the season of ``year`` still mean something: August to December of that year."""
    return (F.year(day) == year) & (F.month(day) >= 8)


def game_id_prefix(label: Column, kind: str = "2") -> Column:
    return F.concat(F.lit("00" + kind), F.substring(label, 3, 2))


def is_regular_game_id(game_id: Column, label: Column) -> Column:
    return game_id.rlike(r"^002\d{7}$") & game_id.startswith(game_id_prefix(label))


def is_playoff_game_id(game_id: Column, label: Column) -> Column:
    return game_id.rlike(r"^004\d{7}$") & game_id.startswith(game_id_prefix(label, "4"))

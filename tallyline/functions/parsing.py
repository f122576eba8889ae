"""Lenient readers of numbers, dates and codes held as text; junk becomes null or an error, never a guess."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Texts that mean "nothing recorded".
BLANKS = ("", "-", "--", "None", "nan", "NaN")
# Position words and their codes.
POSITION_WORDS = {"Guard": "G", "Forward": "F", "Center": "C"}
# Number words and months.
NUMBER_WORDS = {"one": 1, "two": 2, "three": 3, "four": 4, "five": 5, "six": 6}
MONTHS = ("january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december")


def to_double(text: Column) -> Column:
    """Lenient cast: anything that is not a number is null."""
    return text.try_cast("double")


def to_nullable_int(text: Column) -> Column:
    return F.round(text.try_cast("double")).cast("int")


def clean_text(text: Column) -> Column:
    trimmed = F.trim(text)
    return F.when(~trimmed.isin("", "None", "nan", "NaN"), trimmed)


def parse_minutes(text: Column) -> Column:
    """'34:30' or '34.5' -> 34.5; blanks are null; anything else raises."""
    raw = F.trim(text.cast("string"))
    clock = r"^(\d+):(\d{1,2}(?:\.\d+)?)$"
    from_clock = (F.regexp_extract(raw, clock, 1).try_cast("double")
                  + F.regexp_extract(raw, clock, 2).try_cast("double") / 60.0)
    number = raw.try_cast("double")
    return (F.when(raw.isNull() | raw.isin(*BLANKS), F.lit(None).cast("double"))
            .when(raw.rlike(clock), from_clock)
            .when(number.isNotNull(), number)
            .otherwise(F.raise_error(F.concat(F.lit("unparseable minutes "), raw)).cast("double")))


def parse_day(text: Column, *, strict: bool = True) -> Column:
    """'2019-04-10', '2019-04-10T00:00:00' or 'APR 10, 2019' -> date; with ``strict`` junk raises, else it is null."""
    raw = F.trim(text.cast("string"))
    named = F.initcap(raw)
    day = F.coalesce(F.try_to_timestamp(F.substring(raw, 1, 10), F.lit("yyyy-MM-dd")),
                     F.try_to_timestamp(named, F.lit("MMM d, yyyy"))).cast("date")
    if not strict:
        return day
    return F.when(raw.isNull() | day.isNotNull(), day).otherwise(
        F.raise_error(F.concat(F.lit("unparseable date "), raw)).cast("date"))


def parse_height_inches(text: Column) -> Column:
    """'6-9' -> 81; a bare number above 30 is already inches."""
    raw = F.trim(text.cast("string"))
    shape = r"^(\d+)\s*-\s*(\d{1,2})$"
    number = raw.try_cast("double")
    return (F.when(raw.rlike(shape), F.regexp_extract(raw, shape, 1).try_cast("double") * 12
                   + F.regexp_extract(raw, shape, 2).try_cast("double"))
            .when(number > 30, number))


def position_code(text: Column) -> Column:
    """'Guard-Forward' -> 'G-F'."""
    table = F.create_map(*[F.lit(x) for kv in POSITION_WORDS.items() for x in kv])
    parts = F.transform(F.split(F.trim(text), "-"), lambda w: F.coalesce(F.try_element_at(table, F.trim(w)), F.trim(w)))
    return F.when(F.length(F.trim(text)) > 0, F.array_join(parts, "-"))


def pick_slot(number: Column, round_: Column, *, undrafted: float = 61.0) -> Column:
    """Draft slot: the number, else the middle of the round, else the undrafted slot."""
    number, round_ = number.cast("double"), round_.cast("double")
    return (F.when(number >= 1, number).when(round_ >= 1, (round_ - 1) * 30 + 15.5).otherwise(F.lit(undrafted)))


def decayed_pick(pick: Column, years: Column, decay: Column | float, *, undrafted: float = 61.0) -> Column:
    """An old slot counts for less: its distance from the undrafted slot shrinks by ``decay`` per year waited."""
    waited = F.coalesce(years.cast("double"), F.lit(0.0))
    base = decay if isinstance(decay, Column) else F.lit(float(decay))
    return F.lit(undrafted) - (F.lit(undrafted) - pick) * F.pow(base, waited)


def parse_years(text: Column) -> Column:
    """'4-year', 'two years' -> 1..6; an age ('24 years old') is not a length."""
    shape = r"(?i)\b(\d{1,2}|one|two|three|four|five|six)\s*[-‐-―]?\s*(?:year|yr)s?\b(?!\s*[-‐-―]?\s*old)"
    token = F.lower(F.regexp_extract(text, shape, 1))
    table = F.create_map(*[F.lit(x) for kv in NUMBER_WORDS.items() for x in kv])
    n = F.coalesce(token.try_cast("int"), F.try_element_at(table, token))
    return F.when(n.between(1, 6), n)


def parse_amount(text: Column, *, low: float = 1e4, high: float = 1e9) -> Column:
    """'$54.3 million' -> 54300000; figures outside the plausible range count as not stated."""
    shape = r"(?i)\$\s*([0-9][0-9,]*(?:\.[0-9]+)?)\s*(million|mil\b|m\b|thousand|k\b|billion|b\b)?"
    value = F.regexp_replace(F.regexp_extract(text, shape, 1), ",", "").try_cast("double")
    unit = F.substring(F.lower(F.regexp_extract(text, shape, 2)), 1, 1)
    scale = F.when(unit == "m", 1e6).when(unit.isin("t", "k"), 1e3) \
        .when(unit == "b", 1e9).otherwise(1.0)
    dollars = F.round(value * scale, 2)
    return F.when(dollars.between(low, high), dollars)


def parse_days(text: Column) -> Column:
    return F.regexp_extract(text, r"(?i)\b(\d{1,2})\s*[-‐-―]?\s*days?\b", 1).try_cast("int")


def first_day_in_text(text: Column, page_year: Column) -> Column:
    """``day_in_text`` as a struct (day, source)."""
    day, source = day_in_text(text, page_year)
    return F.struct(day.alias("day"), source.alias("source"))


def day_in_text(text: Column, page_year: Column) -> tuple[Column, Column]:
    """First 'Month D, YYYY' or 'D Month YYYY' in free text, and where its year came from.

    A day without a year takes the page's start year from June on and the next year before June.
    """
    names = "|".join(MONTHS) + "|" + "|".join(m[:3] for m in MONTHS) + "|sept"
    month_first = rf"(?i)\b({names})\.?\s+(\d{{1,2}})(?:st|nd|rd|th)?(?:,?\s*(\d{{4}}))?\b"
    day_first = rf"(?i)\b(\d{{1,2}})\s+({names})\.?,?\s+(\d{{4}})\b"

    def read(shape: str, month_group: int, day_group: int) -> tuple[Column, Column, Column]:
        token = F.lower(F.regexp_extract(text, shape, month_group))
        month = F.array_position(F.array(*[F.lit(m[:3]) for m in MONTHS]), F.substring(token, 1, 3)).cast("int")
        day = F.regexp_extract(text, shape, day_group).try_cast("int")
        stated = F.regexp_extract(text, shape, 3).try_cast("int")
        year = F.coalesce(stated, F.when(month >= 6, page_year).otherwise(page_year + 1))
        made = F.try_to_timestamp(F.format_string("%04d-%02d-%02d", year, month, day), F.lit("yyyy-MM-dd")).cast("date")
        source = F.when(stated.isNotNull(), F.lit("cell")).otherwise(F.lit("cell_no_year"))
        at = F.regexp_instr(text, F.lit(shape))
        return F.when((at > 0) & (month > 0) & made.isNotNull(), made), source, at

    a_day, a_source, a_at = read(day_first, 2, 1)
    b_day, b_source, b_at = read(month_first, 1, 2)
    use_a = a_day.isNotNull() & (b_day.isNull() | (a_at <= b_at))
    return F.when(use_a, a_day).otherwise(b_day), F.when(use_a, a_source).when(b_day.isNotNull(), b_source).otherwise(F.lit("none"))

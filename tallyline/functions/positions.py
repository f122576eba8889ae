"""Which lineup slots a coarse position text can fill."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# The specific slots in order, the flexible slots with their members, and the any-slot.
SPECIFIC = ("PG", "SG", "SF", "PF", "C")
FLEX = {"G": ("PG", "SG"), "F": ("SF", "PF")}
ANY = "UTIL"
# Long words, the slots each token fills, and the two-token seams.
LONG_WORDS = {"GUARD": "G", "FORWARD": "F", "CENTER": "C", "CENTRE": "C"}
TOKEN_SLOTS = {"PG": ("PG",), "SG": ("SG",), "SF": ("SF",), "PF": ("PF",), "C": ("C",), "G": ("PG", "SG"), "F": ("SF", "PF")}
SEAMS = {("F", "G"): ("SG", "SF"), ("C", "F"): ("PF", "C")}


def _lookup(table: dict, key: Column) -> Column:
    def lit(v):
        return F.array(*[F.lit(x) for x in v]) if isinstance(v, tuple) else F.lit(v)
    return F.try_element_at(F.create_map(*[x for k, v in table.items() for x in (F.lit(k), lit(v))]), key)


def position_tokens(position: Column) -> Column:
    words = F.split(F.upper(F.trim(F.coalesce(position, F.lit("")))), r"[-/,\s]+")
    tokens = F.transform(words, lambda w: F.coalesce(_lookup(LONG_WORDS, w), w))
    return F.filter(tokens, lambda t: t.isin(*TOKEN_SLOTS))


def is_known(position: Column) -> Column:
    return F.size(position_tokens(position)) > 0


def eligible_positions(position: Column) -> Column:
    """Specific slots the position can fill, in slot order; empty when unknown."""
    tokens = F.array_distinct(position_tokens(position))
    seam = F.lit(None).cast("array<string>")
    for pair, slots in SEAMS.items():
        seam = F.when(F.array_sort(tokens) == F.array(*[F.lit(x) for x in pair]), F.array(*[F.lit(x) for x in slots])).otherwise(seam)
    union = F.flatten(F.transform(tokens, lambda t: _lookup(TOKEN_SLOTS, t)))
    ordered = F.filter(F.array(*[F.lit(p) for p in SPECIFIC]), lambda p: F.array_contains(union, p))
    return F.coalesce(seam, ordered)


def eligible_slots(position: Column) -> Column:
    """Specific slots, then the flexible ones they open, then the any-slot."""
    slots = eligible_positions(position)
    for flex, members in FLEX.items():
        opens = F.arrays_overlap(eligible_positions(position), F.array(*[F.lit(m) for m in members]))
        slots = F.concat(slots, F.when(opens, F.array(F.lit(flex))).otherwise(F.array().cast("array<string>")))
    return F.concat(slots, F.array(F.lit(ANY)))


def position_group(position: Column) -> Column:
    """'G', 'F', 'C' from the first token, 'U' when unknown."""
    first = F.try_element_at(position_tokens(position), F.lit(1))
    return (F.when(first.isin("PG", "SG", "G"), F.lit("G")).when(first.isin("SF", "PF", "F"), F.lit("F"))
            .when(first == "C", F.lit("C")).otherwise(F.lit("U")))

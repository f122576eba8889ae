"""Ordered and multi-label text rules, each one a chain of native regular-expression predicates."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Patterns of absence reasons.
ILLNESS = r"(?i)illness|flu\b|virus|infection|covid|sick|food poisoning|strep|pneumonia|dehydrat|bronch"
REST = r"(?i)\brest\b|injury management|load management|maintenance|managed"
RECOVERY = r"(?i)recovery|rehab|reconditioning|return to competition|conditioning|post.?surgical|surgery"
BODY_PARTS = (
    ("foot_ankle", r"(?i)ankle|foot|toe|achilles|heel|plantar|navicular|metatars|arch"),
    ("knee", r"(?i)knee|acl|mcl|lcl|pcl|menisc|patell"),
    ("leg_hip", r"(?i)hamstring|quad|thigh|calf|groin|hip|glute|adductor|\bleg\b|shin|tibia|fibula|femur|abductor|pelvi|soleus|gastroc|tendinitis.*leg"),
    ("back", r"(?i)\bback\b|spine|spinal|lumbar|sacr|rib|oblique|abdom|core|trunk|flank"),
    ("upper_limb", r"(?i)shoulder|elbow|wrist|hand|finger|thumb|\barm\b|bicep|tricep|forearm|metacarpal|pinky|pectoral|clavicle"),
    ("head_neck", r"(?i)concussion|head|neck|eye|face|nose|facial|jaw|orbital|ear\b|dental|tooth|cervical"),
)
# Which kinds count as injury, rest or other absence.
INJURY_KINDS = ("injury", "illness", "recovery")
REST_KINDS = ("rest",)
OTHER_KINDS = ("g_league", "personal", "suspension", "covid", "not_with_team", "other")

# Off-court report kinds in order, and texts that are not off-court.
REPORT_KINDS = (("trade pending", r"(?i)trade pending"), ("suspension", r"(?i)suspension"),
                ("personal reasons", r"(?i)personal"), ("not with team", r"(?i)not with team"))
NOT_OFFCOURT = r"(?i)return to competition|reconditioning|self.?isolat|health and safety|g league"

# News kinds, and denials that cancel a trade request.
NEWS_KINDS = (
    ("trade request",
     r"(?i)trade request|request(?:s|ed|ing)? (?:a )?trade|ask(?:s|ed|ing)? (?:for )?(?:a )?trade|ask(?:s|ed|ing)? to be traded|"
     r"want(?:s|ed)? (?:to be traded|a trade|out of (?:town|the team|his team))|demand(?:s|ed)? (?:a )?trade|"
     r"request(?:s|ed)? (?:to be )?traded"),
    ("holdout",
     r"(?i)hold-?outs?\b|hold(?:s|ing)? out of (?:camp|training)|skip(?:s|ped|ping)? (?:training )?camp|"
     r"(?:will not|won'?t|not|didn'?t|did not|fail(?:s|ed)? to) report(?:ing)? to"),
    ("contract dispute",
     r"(?i)(?:contract|extension) (?:dispute|standoff|impasse|disagreement|stalemate)|unhappy with (?:his |the )?contract|"
     r"reject(?:s|ed)? (?:a |the )?(?:contract )?extension|(?:contract|extension) (?:talks|negotiations) (?:stall|break|collaps)|"
     r"growing cloud"),
    ("leave of absence", r"(?i)leave of absence|personal reasons|personal matter|away from the team|excused absence"),
    ("suspension", r"(?i)\bsuspen(?:d|ds|ded|sion|sions)\b"),
)
DENIAL = r"(?i)denie[sd]|denying|(?:has not|hasn'?t|never|not) request|no trade request|rumou?rs?"


def first_rule(text: Column, rules, default: str = "") -> Column:
    """Name of the first rule whose pattern occurs in ``text``."""
    out = F.lit(default)
    for name, pattern in reversed(tuple(rules)):
        out = F.when(text.rlike(pattern), F.lit(name)).otherwise(out)
    return out


def matching_rules(text: Column, rules) -> Column:
    """Array of every rule name whose pattern occurs in ``text``."""
    return F.array_compact(F.array(*[F.when(text.rlike(pattern), F.lit(name)) for name, pattern in rules]))


def classify_reason(category: Column, detail: Column) -> Column:
    """Struct (kind, body_part) of one absence reason."""
    cat = F.lower(F.trim(F.coalesce(category, F.lit(""))))
    det = F.trim(F.coalesce(detail, F.lit("")))
    text = F.concat_ws(" ", cat, F.lower(det))
    part = first_rule(det, BODY_PARTS)
    medical = cat.startswith("injury") | cat.startswith("illness") | ((cat == "") & (det != ""))
    rested = cat.isin("rest", "injury management", "load management") | (det.rlike(REST) & ~det.rlike(RECOVERY))
    only_ill = det.rlike(ILLNESS) & (part == "")
    kind = (F.when(cat.startswith("g league") | text.rlike("two-way|on assignment"), "g_league")
            .when(text.contains("suspen"), "suspension")
            .when(text.rlike("health and safety|covid-19"), "covid")
            .when(text.rlike("personal|bereavement|family|paternity|birth"), "personal")
            .when(text.contains("not with team"), "not_with_team")
            .when(rested, "rest")
            .when(medical & only_ill, "illness")
            .when(medical & det.rlike(RECOVERY), "recovery")
            .when(medical, "injury")
            .when(text.rlike("return to competition|reconditioning|rehab"), "recovery")
            .otherwise("other"))
    shown = F.when(medical & kind.isin("injury", "recovery"), F.when(part == "", F.lit("other")).otherwise(part)).otherwise(F.lit(""))
    return F.struct(kind.alias("kind"), shown.alias("body_part"))


def report_kind(category: Column, detail: Column) -> Column:
    """Off-court kind of a report line, '' for injuries, rest and assignments."""
    text = F.concat_ws(" ", F.coalesce(category, F.lit("")), F.coalesce(detail, F.lit("")))
    return F.when(text.rlike(NOT_OFFCOURT), F.lit("")).otherwise(first_rule(text, REPORT_KINDS))


def news_kinds(headline: Column, description: Column) -> Column:
    """Comma-separated kinds of an article; a denied trade request is not one."""
    text = F.concat(F.coalesce(headline, F.lit("")), F.lit(". "), F.coalesce(description, F.lit("")))
    tags = matching_rules(text, NEWS_KINDS)
    kept = F.when(text.rlike(DENIAL), F.array_remove(tags, "trade request")).otherwise(tags)
    return F.array_join(kept, ", ")


def split_reason(reason: Column) -> Column:
    """'category - detail' -> struct of the two."""
    parts = F.split(F.coalesce(reason, F.lit("")), r"\s+-\s+", 2)
    return F.struct(F.trim(parts[0]).alias("category"), F.trim(F.coalesce(F.get(parts, F.lit(1)), F.lit(""))).alias("detail"))

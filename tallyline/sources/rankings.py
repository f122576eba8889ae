"""External rankings: CSV scans with a required header, resolution onto ids, comparison of several sources."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tallyline.functions.names import normalize_name
from tallyline.operators.resolve import match_entities

NO_ADP = 139.9          # fixed value: at or above it a listed pick means "not priced"
NAME_FIELD = r"^(.+?)\s+\(([A-Z]{2,3}|FA)\s+-\s+([A-Z,]+)\)\s*(.*)$"


def read_ranking_csv(spark: SparkSession, path: str, required: list[str]) -> DataFrame:
    """All columns as text; a missing required column is an error."""
    df = spark.read.option("header", True).option("inferSchema", False).csv(path)
    absent = [c for c in required if c not in df.columns]
    if absent:
        raise ValueError(f"{path}: missing columns {absent}")
    return df


def expert_ranking(rows: DataFrame) -> DataFrame:
    """RK, 'Name (TEAM - POS,POS) TAG' and 'ECR VS. ADP' to typed columns; a name that does not fit the shape is an error."""
    raw = F.trim(F.col("`PLAYER NAME`"))
    fits = raw.rlike(NAME_FIELD)
    name = F.when(fits, F.regexp_extract(raw, NAME_FIELD, 1)).otherwise(F.raise_error(F.concat(F.lit("unreadable player name "), raw)))
    tag = F.trim(F.regexp_extract(raw, NAME_FIELD, 4))
    return rows.select(F.trim("RK").alias("source_id"), raw.alias("source_name_raw"), name.alias("name"), F.regexp_extract(raw, NAME_FIELD, 2).alias("team"), F.regexp_extract(raw, NAME_FIELD, 3).alias("positions"),
                       F.when(tag != "", tag).alias("status_tag"), F.trim("RK").cast("int").alias("ext_rank"), F.regexp_replace(F.col("`ECR VS. ADP`"), r"[+\s]", "").try_cast("int").alias("ecr_vs_adp"))


def resolve_ranking(parsed: DataFrame, players: DataFrame, source: str) -> DataFrame:
    """One output row per input row, with the way it was matched."""
    got = match_entities(parsed, players, source_name=source, year_col=None)
    return parsed.join(got.select("source_id", "player_id", "match_method", "confidence"), "source_id", "left").na.fill({"match_method": "unmatched"})


def unresolved_rows(resolved: DataFrame) -> DataFrame:
    return resolved.where(F.col("player_id").isNull())


def real_adp(rows: DataFrame, column: str = "adp") -> DataFrame:
    return rows.where(F.col(column).isNotNull() & (F.col(column) > 0) & (F.col(column) < NO_ADP))


def map_adp(adp: DataFrame, id_map: DataFrame, source: str, *, min_confidence: float = 0.0) -> tuple[DataFrame, DataFrame]:
    """(player_id, adp) of one source, and the audit (unmapped, low_confidence, duplicates)."""
    ids = id_map.where(F.col("source") == source).select("source_id", F.col("player_id").alias("_pid"), "confidence").dropDuplicates(["source_id"])
    j = adp.where(F.col("source") == source).join(ids, "source_id", "left")
    low = F.col("_pid").isNotNull() & (F.col("confidence") < min_confidence)
    good = j.where(F.col("_pid").isNotNull() & ~low)
    best = good.groupBy("season", F.col("_pid").alias("player_id")).agg(F.min("adp").alias("adp"), F.count(F.lit(1)).alias("_n"))
    audit = j.agg(F.count(F.lit(1)).alias("rows"), F.count_if(F.col("_pid").isNull()).alias("unmapped"), F.count_if(F.coalesce(low, F.lit(False))).alias("low_confidence"))
    dup = best.agg(F.coalesce(F.sum(F.col("_n") - 1), F.lit(0))).scalar()
    return best.drop("_n"), audit.withColumn("duplicates", dup)


def fill_gap_period(second: DataFrame, names: DataFrame, season: str, *, name: str = "name") -> DataFrame:
    """A missing period from a second source, by names only one id has."""
    key = names.select("source_id", normalize_name(F.col(name)).alias("_n")).distinct()
    only = key.groupBy("_n").agg(F.count(F.lit(1)).alias("_c"), F.min("source_id").alias("source_id")).where(F.col("_c") == 1)
    rows = second.select(normalize_name(F.col(name)).alias("_n"), F.coalesce(*[F.col(c).cast("double") for c in ("adp", "ext_rank") if c in second.columns]).alias("adp"))
    return rows.join(only, "_n").groupBy("source_id").agg(F.min("adp").alias("adp")).withColumn("season", F.lit(season))


def adp_predictor(adp: DataFrame) -> DataFrame:
    """Rank-only projection: the score is minus the pick."""
    return adp.select("season", "player_id", F.lit("adp").alias("model"), (-F.col("adp")).alias("proj_total_fp"))


def compare_rankings(board: DataFrame, sources: dict[str, DataFrame], *, entity: str = "player_id") -> DataFrame:
    """Full outer join of our ranks and every source's, with deltas (theirs minus ours) and presence flags."""
    out = board.select(entity, F.col("rank").alias("our_rank"))
    for name, rows in sources.items():
        best = rows.where(F.col(entity).isNotNull()).groupBy(entity).agg(F.min("ext_rank").alias(f"{name}_rank"))
        out = out.join(best, entity, "full")
    for name in sources:
        out = out.withColumn(f"{name}_delta", F.col(f"{name}_rank") - F.col("our_rank"))
    size = F.greatest(*[F.abs(f"{n}_delta") for n in sources]) if len(sources) > 1 else F.abs(f"{next(iter(sources))}_delta")
    return out.withColumn("max_abs_delta", size).withColumn("n_sources", reduce(lambda a, b: a + b, [F.col(f"{n}_rank").isNotNull().cast("int") for n in sources]))


def flag_disagreements(comparison: DataFrame, sources: list[str], *, threshold: float) -> DataFrame:
    """``flagged``, the source that drives it, its direction and a text."""
    driver: Column = F.lit(None).cast("string")
    delta: Column = F.lit(None).cast("double")
    for n in reversed(sources):
        is_top = F.abs(f"{n}_delta") == F.col("max_abs_delta")
        driver, delta = F.when(is_top, F.lit(n)).otherwise(driver), F.when(is_top, F.col(f"{n}_delta").cast("double")).otherwise(delta)
    out = comparison.withColumn("flagged", F.coalesce(F.col("max_abs_delta") >= threshold, F.lit(False))).withColumn("driver", driver).withColumn("_d", delta)
    side = F.when(F.col("_d") > 0, "we rank higher").when(F.col("_d") < 0, "we rank lower")
    text = F.format_string("%s has rank %d, ours is %d", F.col("driver"), (F.col("our_rank") + F.col("_d")).cast("int"), F.col("our_rank"))
    return out.withColumn("direction", F.when(F.col("flagged"), side)).withColumn("text", F.when(F.col("flagged"), text)).drop("_d")


def unmatched_report(sources: dict[str, DataFrame]) -> DataFrame:
    """(source, name, match_method) of every miss."""
    frames = [unresolved_rows(r).select(F.lit(n).alias("source"), "name", "match_method") for n, r in sources.items()]
    return reduce(DataFrame.unionByName, frames)

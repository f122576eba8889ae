"""Walk-forward scoring: each period is projected from earlier ones only, then every period is scored in one grouped pass."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from tallyline.functions.periods import season_label, season_year_fast
from tallyline.functions.scoring import STAT_COLUMNS, weighted_score
from tallyline.operators import metrics, resample
from tallyline.operators.views import History
from tallyline.plans.adjusted import scored_actuals
from tallyline.plans.projector import Projector
from tallyline.sources.contracts import rule_counts


class ProjectionError(ValueError):
    """A projector's output breaks a rule."""


def check_projections(proj: DataFrame, season: str, scoring: Mapping[str, float] | None, *, rank_only: bool = False, tolerance: float = 1e-6) -> DataFrame:
    """The projection itself, or an error naming every broken rule: season, keys, ranges, band order, score consistency."""
    rules: dict[str, Column] = {"season": F.col("season") != season, "missing id": F.col("player_id").isNull(), "missing total": F.col("proj_total_fp").isNull()}
    if not rank_only:
        rules |= {"negative games": F.col("proj_gp") < 0, "band order": (F.col("fppg_p10") > F.col("fppg_p50") + tolerance) | (F.col("fppg_p50") > F.col("fppg_p90") + tolerance),
                  "total": F.abs(F.col("proj_total_fp") - F.col("proj_gp") * F.col("proj_fppg")) > tolerance * F.greatest(F.lit(1.0), F.abs("proj_total_fp"))}
        if scoring and all("proj_" + c in proj.columns for c in STAT_COLUMNS.values()):
            rules["score"] = F.abs(weighted_score(proj, scoring, prefix="proj_", columns=STAT_COLUMNS) - F.col("proj_fppg")) > tolerance * F.greatest(F.lit(1.0), F.abs("proj_fppg"))
    counts = rule_counts(proj, rules)
    dup = proj.groupBy("player_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").agg(F.lit("duplicate id").alias("rule"), F.count(F.lit(1)).alias("n_bad"))
    bad = counts.unionByName(dup).where(F.col("n_bad") > 0).collect()                # one row per rule
    if bad:
        raise ProjectionError("; ".join(f"{r['n_bad']} rows break '{r['rule']}'" for r in bad))
    return proj


@dataclass
class BacktestResult:
    """Evaluation rows, metrics per season, and what was run."""

    name: str
    frame: DataFrame
    seasons: DataFrame
    config: dict

    def summary(self) -> DataFrame:
        return metrics.summarize_periods(self.seasons)

    def summary_interval(self, metric: str, *, n_boot: int = 1000) -> DataFrame:
        return resample.period_interval(self.seasons, "season", metric, n_boot=n_boot)

    def save(self, path: str) -> None:
        self.frame.write.mode("overwrite").parquet(f"{path}/{self.name}/frame")
        self.seasons.write.mode("overwrite").parquet(f"{path}/{self.name}/seasons")
        spark = self.frame.sparkSession
        spark.createDataFrame([{"name": self.name, **{k: str(v) for k, v in self.config.items()}}]).write.mode("overwrite").json(f"{path}/{self.name}/config")

    @classmethod
    def load(cls, spark, path: str, name: str) -> "BacktestResult":
        config = spark.read.json(f"{path}/{name}/config").first().asDict()
        return cls(name, spark.read.parquet(f"{path}/{name}/frame"), spark.read.parquet(f"{path}/{name}/seasons"), config)


def walk_forward(tables: Mapping[str, DataFrame], projector: Projector, seasons: list[int], scoring: Mapping[str, float], *, ks: tuple[int, ...] = (12, 50, 100), n_rostered: int = 182,
                 min_gp: int = 10, rank_only: bool = False, sanitize: bool = True) -> BacktestResult:
    """Project each season from its history, check the output, and score all seasons together."""
    if not seasons:
        raise ValueError("no seasons to score")
    parts = []
    for s in seasons:
        history = History.until(tables, s, sanitize=sanitize)
        proj = projector.project(history)
        parts.append(check_projections(proj, f"{s}-{(s + 1) % 100:02d}", scoring, rank_only=rank_only))
    keep = ["season", "player_id", "proj_gp", "proj_fppg", "proj_total_fp", *(c for c in ("fppg_p10", "fppg_p50", "fppg_p90") if all(c in p.columns for p in parts))]
    proj = reduce(DataFrame.unionByName, [p.select(*keep) for p in parts])
    logs = tables["game_logs"].where(season_year_fast(F.col("season")).isin(*seasons))
    actual = scored_actuals(logs, scoring).select(season_label(F.col("s")).alias("season"), "player_id", F.col("gp").alias("actual_gp"), F.col("fppg").alias("actual_fppg"), F.col("total_fp").alias("actual_total_fp"))
    frame = metrics.eval_frame(proj, actual)
    if "fppg_p10" in keep:
        events = logs.select("season", "player_id", weighted_score(logs, scoring, columns=STAT_COLUMNS).alias("fp"))
        frame = frame.join(metrics.band_counts(events, proj, key=["season", "player_id"], score="fp"), ["season", "player_id"], "left").na.fill(0, ["band_games", "p50_games", "n_below_p10", "n_above_p90", "n_below_p50"])
    frame = frame.persist()                                      # entity-seasons, read by every metric
    per = metrics.period_metrics(frame, ks=ks, n_rostered=n_rostered, min_gp=min_gp, rank_only=rank_only)
    if "fppg_p10" in keep:
        per = per.join(metrics.calibration_shares(frame, ["season"]), "season", "left")
    return BacktestResult(projector.name, frame, per, {"projector": projector.name, "seasons": ",".join(map(str, seasons)), "n_rostered": n_rostered, "min_gp": min_gp})


ERROR_OF = {"mae_total_fp": ("proj_total_fp", "actual_total_fp", "projected"), "mae_fppg": ("proj_fppg", "actual_fppg", "fppg"), "mae_gp": ("proj_gp", "actual_gp", "projected")}


def paired_lift(a: BacktestResult, b: BacktestResult, metric: str, *, n_boot: int = 500, min_gp: int = 10) -> DataFrame:
    """(metric, estimate, lo, hi, ..., n_won, n_seasons): improvement of b over a on rows both project.

    Error metrics resample entities within seasons, with shared weights; rank metrics resample seasons.
    """
    a_s, b_s = a.seasons.select("season", F.col(metric).alias("_a")), b.seasons.select("season", F.col(metric).alias("_b"))
    sign = -1.0 if metrics.higher_is_better(metric) is False else 1.0
    per = a_s.join(b_s, "season").withColumn("gain", F.lit(sign) * (F.col("_b") - F.col("_a")))
    if metric in ERROR_OF:
        p, act, subset = ERROR_OF[metric]
        left = metrics.subset_rows(a.frame, subset, min_gp=min_gp).select("season", "player_id", F.col(p).alias("_pa"), act)
        both = left.join(metrics.subset_rows(b.frame, subset, min_gp=min_gp).select("season", "player_id", F.col(p).alias("_pb")), ["season", "player_id"])
        out = resample.paired_improvement(both, F.abs(F.col("_pa") - F.col(act)), F.abs(F.col("_pb") - F.col(act)), ["player_id"], strata=["season"], n_boot=n_boot)
    else:
        out = resample.period_interval(per, "season", "gain", n_boot=n_boot)
    wins = per.agg(F.struct(F.count_if(F.col("gain") > 0).alias("won"), F.count("gain").alias("n")).alias("w")).scalar()
    return out.select(F.lit(metric).alias("metric"), F.lit(a.name).alias("model_a"), F.lit(b.name).alias("model_b"), "*", wins["won"].alias("n_won"), wins["n"].alias("n_seasons"))


def ablation(results: list[BacktestResult], metric_names: list[str], *, n_boot: int = 500) -> DataFrame:
    """Lift of every variant over the one before it."""
    rows = [paired_lift(a, b, m, n_boot=n_boot) for a, b in zip(results, results[1:]) for m in metric_names]
    out = reduce(lambda x, y: x.unionByName(y, allowMissingColumns=True), rows)
    verdict = F.when(F.col("lo") > 0, "better").when(F.col("hi") < 0, "worse").otherwise("unclear")
    return out.withColumn("verdict", verdict)


def cutoff_grid(events: DataFrame, cutoffs: list[int], *, entity: str, period: str, order: list[str], value: str) -> DataFrame:
    """(entity, period, cutoff, n_seen, seen, n_rest, rest): totals before and after each entity's nth event, every cutoff in one pass.

    ``events`` holds one row per entity and day, so the numbering window is bounded by the calendar.
    """
    w = Window.partitionBy(entity, period).orderBy(*order)
    rows = events.withColumn("_i", F.row_number().over(w)).withColumn("cutoff", F.explode(F.array(*[F.lit(c) for c in cutoffs])))
    past = F.col("_i") <= F.col("cutoff")
    return rows.groupBy(entity, period, "cutoff").agg(F.count_if(past).alias("n_seen"), F.sum(F.when(past, F.col(value)).otherwise(0.0)).alias("seen"), F.count_if(~past).alias("n_rest"),
                                                      F.sum(F.when(~past, F.col(value)).otherwise(0.0)).alias("rest"))

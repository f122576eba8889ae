"""Projectors stacked on a base: a gated residual regression scales the stat block, and rank-only or naive predictors."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from functools import reduce

from pyspark.sql import DataFrame, functions as F

from tallyline.functions.periods import season_label, season_year_fast
from tallyline.functions.scoring import STAT_COLUMNS, weighted_score, youth_weight
from tallyline.operators.fit import GatedFit, factor_from_adjustment, gated_ridge, wls
from tallyline.operators.folds import deal_state, entry_clock, state_flag
from tallyline.operators.matching import cohort_z
from tallyline.operators.panel import naive_last_period, period_actuals
from tallyline.operators.views import History, before_period
from tallyline.plans.projector import Projector

MIN_TRAIN_GP = 10
Design = Callable[[History, int, DataFrame], tuple[DataFrame, list[str]]]
"""(history, season, rows with player_id, age, is_rookie) -> (rows with design columns, their names)."""

# Component score -> event rate; minutes that centre each context.
EVENT_RATES = {"z": "fp36", "ts_z": "ts", "usg_z": "usg36", "ast_z": "ast36", "reb_z": "reb36", "stk_z": "stk36"}
CONTEXTS = {"sl": ("summer_league", 25.0), "pre": ("preseason", 20.0)}


def scored_actuals(logs: DataFrame, scoring: Mapping[str, float]) -> DataFrame:
    """(player_id, s, gp, total_fp, fppg)."""
    rows = logs.withColumn("s", season_year_fast(F.col("season"))).withColumn("fp", weighted_score(logs, scoring, columns=STAT_COLUMNS))
    return period_actuals(rows, entity="player_id", period="s", group="team_id", day="game_date", event="game_id", score="fp", minutes="min")


class AdjustedProjector:
    """Base projection times a factor from a regression of past residuals, if cross-validation lets it through."""

    def __init__(self, base: Projector, scoring: Mapping[str, float], design: Design | list[Design], *, name: str, center: bool = False, use_intercept: bool = False, min_rows: int = 150,
                 min_gain: float = 0.0005, ridges: tuple[float, ...] = (1.0, 10.0, 100.0, 1000.0), limits: tuple[float, float] = (0.8, 1.25), train_seasons: int | None = None):
        self.base, self.scoring, self.name, self.limits = base, dict(scoring), name, limits
        self.designs = list(design) if isinstance(design, (list, tuple)) else [design]
        self.options = {"center": center, "use_intercept": use_intercept, "min_rows": min_rows, "min_gain": min_gain, "ridges": ridges}
        self.train_seasons = train_seasons
        self.last_fit: GatedFit | None = None
        self._memo: dict[int, DataFrame] = {}

    def _base_for(self, history: History, season: int) -> DataFrame:
        """Base projection of an earlier season; it does not depend on the target, so it is kept."""
        if season not in self._memo:
            self._memo[season] = self.base.project(History.until(history.tables, season)).persist()
        return self._memo[season]

    def _train(self, history: History) -> tuple[GatedFit, Design]:
        """The fit of the design variant with the lowest cross-validated loss."""
        tried = [(self._fit_design(history, d), d) for d in self.designs]
        return min(tried, key=lambda fd: fd[0].diagnostics.get("cv_loss", float("inf")))

    def _fit_design(self, history: History, design: Design) -> GatedFit:
        actual = scored_actuals(history["game_logs"], self.scoring)
        seasons = sorted(r[0] for r in actual.select("s").distinct().collect())[1:]
        if self.train_seasons:
            seasons = seasons[-self.train_seasons:]
        parts, names = [], []
        for s in seasons:
            proj = self._base_for(history, s).select("player_id", "proj_fppg", "age", "is_rookie")
            rows = proj.join(actual.where((F.col("s") == s) & (F.col("gp") >= MIN_TRAIN_GP)), "player_id")
            rows, names = design(history, s, rows)
            parts.append(rows.select(*names, (F.col("fppg") - F.col("proj_fppg")).alias("_resid"), "gp", "s"))
        if not parts:
            return GatedFit([], None, None, None, 0.0, False, False, {"reason": "no training seasons"})
        return gated_ridge(reduce(DataFrame.unionByName, parts), names, "_resid", "gp", "s", **self.options)

    def project(self, history: History) -> DataFrame:
        history.assert_no_future()
        base = self.base.project(history)
        self.last_fit, design = self._train(history)
        rows, _ = design(history, history.target, base)
        factor = factor_from_adjustment(F.col("proj_fppg"), self.last_fit.adjustment(), low=self.limits[0], high=self.limits[1])
        out = rows.withColumn("_f", factor).select(*[c for c in base.columns], "_f")
        scaled = ["proj_" + c for c in STAT_COLUMNS.values()] + ["fppg_p10", "fppg_p50", "fppg_p90", "proj_fppg_sd"]
        out = out.select(*[(F.col(c) * F.col("_f")).alias(c) if c in scaled else F.col(c) for c in base.columns], F.col("_f").alias("adjust_factor"))
        out = out.withColumn("proj_fppg", weighted_score(out, self.scoring, prefix="proj_", columns=STAT_COLUMNS))
        return out.withColumn("proj_total_fp", F.col("proj_fppg") * F.col("proj_gp")).withColumn("model", F.lit(self.name))


def event_table(logs: DataFrame, team_games: DataFrame, scoring: Mapping[str, float], *, as_of: str | None = None, min_minutes: float = 40.0, clip_at: float = 3.0,
                preseason_fraction: float = 1.0) -> DataFrame:
    """(player_id, event_season): usage and cohort-relative production of both off-season contexts side by side."""
    logs = cut_first_dates(logs, preseason_fraction)
    out = None
    for prefix, (context, _) in CONTEXTS.items():
        d = logs.where(F.col("context") == context)
        g = team_games.where(F.col("context") == context)
        if as_of is not None and prefix == "pre":
            d, g = d.where(F.col("game_date") <= F.lit(as_of).cast("date")), g.where(F.col("game_date") <= F.lit(as_of).cast("date"))
        d = d.withColumn("fp", weighted_score(d, scoring, columns=STAT_COLUMNS))
        sums = ("fp", "pts", "fga", "fta", "tov", "ast", "reb", "stl", "blk")
        e = d.groupBy("player_id", "event_season").agg(F.count(F.lit(1)).alias("gp"), F.sum("min").alias("minutes"), *[F.sum(c).alias(c) for c in sums])
        stints = d.select("player_id", "event_season", "team_id").distinct().join(g.groupBy("event_season", "team_id").agg(F.count(F.lit(1)).alias("_n")), ["event_season", "team_id"], "left")
        e = e.join(stints.groupBy("player_id", "event_season").agg(F.sum("_n").alias("_of")), ["player_id", "event_season"], "left")
        per = F.when(F.col("minutes") > 0, 36.0 / F.col("minutes"))
        shots = 2.0 * (F.col("fga") + 0.44 * F.col("fta"))
        e = e.select("player_id", "event_season", "gp", "minutes", F.when(F.col("_of") > 0, F.col("gp") / F.col("_of")).alias("gp_share"), (F.col("minutes") / F.col("gp")).alias("mpg"),
                     (F.col("fp") * per).alias("fp36"), F.when(shots > 0, F.col("pts") / shots).alias("ts"), ((F.col("fga") + 0.44 * F.col("fta") + F.col("tov")) * per).alias("usg36"),
                     (F.col("ast") * per).alias("ast36"), (F.col("reb") * per).alias("reb36"), ((F.col("stl") + F.col("blk")) * per).alias("stk36"))
        e = cohort_z(e, ["event_season"], EVENT_RATES, "minutes", min_weight=min_minutes, clip_at=clip_at)
        e = e.select("player_id", "event_season", *[F.col(c).alias(f"{prefix}_{c}") for c in ("gp", "minutes", "mpg", "gp_share", "fp36", *EVENT_RATES)])
        out = e if out is None else out.join(e, ["player_id", "event_season"], "full")
    return out


def cut_first_dates(logs: DataFrame, fraction: float, *, context: str = "preseason") -> DataFrame:
    """Keep the first share of each preseason's distinct dates; other contexts are untouched. A preseason has a few dozen dates."""
    if fraction >= 1.0:
        return logs
    dates = logs.where(F.col("context") == context).select("event_season", "game_date").distinct()
    cut = dates.groupBy("event_season").agg(F.sort_array(F.collect_list("game_date")).alias("_d"))
    cut = cut.select("event_season", F.element_at("_d", F.greatest(F.ceil(F.size("_d") * F.lit(fraction)), F.lit(1)).cast("int")).alias("_last"))
    j = logs.join(F.broadcast(cut), "event_season", "left")                                             # one row per season
    return j.where((F.col("context") != context) | (F.col("game_date") <= F.col("_last"))).drop("_last")


def offseason_design(logs: DataFrame, team_games: DataFrame, scoring: Mapping[str, float], *, evidence_minutes: float = 150.0, components: bool = False, as_of: str | None = None) -> Design:
    """Event evidence shrunk by minutes, with youth and newcomer interactions; no event means zero in every column."""
    def build(history: History, season: int, rows: DataFrame) -> tuple[DataFrame, list[str]]:
        known, games = (before_period(t, history.target) if "season" in t.columns else t for t in (logs, team_games))
        events = event_table(known, games, scoring, as_of=as_of).where(season_year_fast(F.col("event_season")) == season).drop("event_season")
        j = rows.join(events, "player_id", "left")
        y, r = youth_weight(F.col("age")), F.col("is_rookie").cast("double")
        names = []
        for prefix, (_, centre) in CONTEXTS.items():
            m = F.coalesce(F.col(f"{prefix}_minutes"), F.lit(0.0))
            has = m > 0
            w = m / (m + evidence_minutes)
            z = F.when(has, F.coalesce(F.col(f"{prefix}_z"), F.lit(0.0))).otherwise(0.0) * w
            mpg = F.when(has, F.coalesce((F.col(f"{prefix}_mpg") - centre) / 10.0, F.lit(0.0))).otherwise(0.0)
            cols = {"has": has.cast("double"), "z": z, "z_young": z * y, "z_new": z * r, "mpg": mpg, "mpg_young": mpg * y}
            if components:
                for c in list(EVENT_RATES)[1:]:
                    zc = F.when(has, F.coalesce(F.col(f"{prefix}_{c}"), F.lit(0.0))).otherwise(0.0) * w
                    cols |= {c: zc, c + "_young": zc * y}
            for k, v in cols.items():
                j = j.withColumn(f"d_{prefix}_{k}", v)
                names.append(f"d_{prefix}_{k}")
        return j, names
    return build


def clock_design() -> Design:
    """Indicators of the entry-scale clock."""
    names = [f"r1_y{k}" for k in range(1, 6)] + [f"r2_y{k}" for k in range(1, 4)] + ["top_final", "late_final"]

    def build(history: History, season: int, rows: DataFrame) -> tuple[DataFrame, list[str]]:
        clock = entry_clock(history["players"], season=season).select("player_id", *names)
        return rows.join(clock, "player_id", "left").na.fill(0.0, names), names
    return build


def terms_events(contracts: DataFrame) -> DataFrame:
    """Contract rows as steps of the deal walk, in order of their date (1 August of the first covered year when it is unknown)."""
    makes = F.col("event").isin("sign", "resign", "extension") & ~F.col("is_ten_day")
    kind = (F.when(makes & ((F.col("event") == "extension") | F.col("is_extension")), "extension").when(makes, "deal").when(F.col("event").isin("waived", "bought_out", "retired", "expired", "option_declined"), "end")
            .when(F.col("event") == "claimed", "resume"))
    day = F.unix_date(F.coalesce("signed_date", F.make_date(F.col("start_year"), F.lit(8), F.lit(1))))
    return contracts.select("player_id", kind.alias("kind"), F.col("start_year").cast("int").alias("start"), F.col("years").cast("int").alias("length"), day.alias("day"),
                            F.pmod(F.xxhash64("event", "start_year", "years", "team_id"), F.lit(1 << 40)).alias("tie"), season_year_fast(F.col("season")).alias("s"))


def terms_design(contracts: DataFrame) -> Design:
    """Indicators of the deal an entity is on at the start of a season, with the entry-scale clock where nothing is stated."""
    names = ["contract_year", "two_left", "three_left", "recent_extension", "new_deal", "lapsed", "final_year", "option_year"]

    def build(history: History, season: int, rows: DataFrame) -> tuple[DataFrame, list[str]]:
        steps = terms_events(before_period(contracts, season)).where(F.col("s") < season)
        state = state_flag(deal_state(steps, "player_id", order=["day", "tie"], kind="kind", start="start", length="length", at=season))
        clock = entry_clock(history["players"], season=season).select("player_id", "final_year", "option_year")
        j = rows.join(state.select("player_id", *[F.col(c).cast("double").alias(c) for c in names[:6]]), "player_id", "left").join(clock, "player_id", "left")
        return j.na.fill(0.0, names), names
    return build


class NaiveLastSeason:
    """Last season's counts, mean and band, unchanged."""

    def __init__(self, scoring: Mapping[str, float], *, min_games: int = 10, name: str = "naive_last_season"):
        self.scoring, self.min_games, self.name = dict(scoring), min_games, name

    def project(self, history: History) -> DataFrame:
        logs = history["game_logs"]
        rows = logs.select("player_id", season_year_fast(F.col("season")).alias("s"), weighted_score(logs, self.scoring, columns=STAT_COLUMNS).alias("fp")).where(F.col("s") == history.target - 1)
        out = naive_last_period(rows, entity="player_id", period="s", score="fp", min_events=self.min_games)
        return out.drop("s").withColumn("season", season_label(F.lit(history.target))).withColumn("model", F.lit(self.name))


class AdpProjector:
    """Rank-only: the better the market pick, the higher the score."""

    def __init__(self, adp: DataFrame, *, name: str = "adp"):
        self.adp, self.name = adp, name

    def project(self, history: History) -> DataFrame:
        rows = self.adp.where(season_year_fast(F.col("season")) == history.target)
        null = F.lit(None).cast("double")
        return rows.groupBy("season", "player_id").agg((-F.min("adp")).alias("proj_total_fp")).select("season", "player_id", F.lit(self.name).alias("model"), null.alias("proj_gp"), null.alias("proj_fppg"), "proj_total_fp")


class BlendProjector:
    """A base projection's total re-read from a fit on log pick and own total; rows the market does not list keep the model's."""

    def __init__(self, base: Projector, adp: DataFrame, beta: tuple[float, float, float], *, name: str = "adp_blend"):
        self.base, self.adp, self.beta, self.name = base, adp, beta, name

    def project(self, history: History) -> DataFrame:
        out = self.base.project(history)
        picks = self.adp.where(season_year_fast(F.col("season")) == history.target).groupBy("player_id").agg(F.min("adp").alias("adp"))
        return blend_totals(out.join(picks, "player_id", "left"), self.beta).withColumn("proj_total_fp", F.col("blend_total_fp")).withColumn("model", F.lit(self.name))


def blend_totals(rows: DataFrame, beta: tuple[float, float, float]) -> DataFrame:
    a, b, c = (F.lit(float(v)) for v in beta)
    return rows.withColumn("blend_total_fp", F.when(F.col("adp").isNotNull(), a + b * F.log("adp") + c * F.col("proj_total_fp")).otherwise(F.col("proj_total_fp")))


def fit_blend(rows: DataFrame, *, total: str = "proj_total_fp", actual: str = "actual_total_fp", adp: str = "adp") -> tuple[float, float, float]:
    """Least squares of the outcome on log pick and the model total over listed rows of earlier seasons."""
    x = rows.where(F.col(adp).isNotNull()).select(F.log(adp).alias("lp"), F.col(total).alias("m"), F.col(actual).alias("y"))
    return tuple(float(v) for v in wls(x, ["lp", "m"], "y", ridge=0.0))

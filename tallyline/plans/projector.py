"""The baseline projection: a pipeline of fitted pieces over one panel, with hooks for extra features, and its registry."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass, field
from typing import Protocol, runtime_checkable

from pyspark.sql import Column, DataFrame, functions as F

from tallyline.functions.parsing import pick_slot
from tallyline.functions.periods import season_label, season_year_fast
from tallyline.functions.positions import position_group
from tallyline.functions.scoring import STAT_COLUMNS, clip, recency_weighted, weighted_score
from tallyline.operators import fit as fits
from tallyline.operators.panel import ages_at, build_panel, period_lengths
from tallyline.operators.ranking import exact_quantiles
from tallyline.operators.views import History

from tallyline.plans.rates import MINUTES, RATES, VOLATILITY, BaselineConfig, QuantityFit, fit_quantities, has_history, lag_frame, predict_quantities
from tallyline.session import cut_lineage

MU_CLIP, PHI_CLIP, DEFAULT_PHI, SD_FLOOR = (0.02, 0.985), (0.01, 0.6), 0.12, 1.0
TOP_PLATEAU, MIN_PLATEAU, ROOKIE_RIDGE = 10, 5, 1e-3
TAU_FLOOR, DEFAULT_TAU, MIN_BUCKET_ROWS, PRED_FLOOR = 0.02, 0.15, 40, 5.0
EXTRA = "x_"


@runtime_checkable
class Projector(Protocol):
    """Anything the walk-forward and the board can use."""

    name: str

    def project(self, history: History) -> DataFrame:
        """Projection rows for ``history.target``."""
        ...


_REGISTRY: dict[str, Callable[..., Projector]] = {}


def register_projector(name: str, factory: Callable[..., Projector], *, overwrite: bool = False) -> None:
    if name in _REGISTRY and not overwrite:
        raise KeyError(f"projector {name!r} is registered; pass overwrite=True to replace it")
    _REGISTRY[name] = factory


def available_projectors() -> list[str]:
    return sorted(_REGISTRY)


def get_projector(name: str, **kw) -> Projector:
    if name not in _REGISTRY:
        raise KeyError(f"unknown projector {name!r}; known: {available_projectors()}")
    return _REGISTRY[name](**kw)


Feature = Callable[[History, DataFrame], DataFrame]
"""(history, rows keyed on player_id and s) -> the rows with ``x_...`` columns; used by availability, or as inputs of a minutes shift."""


@dataclass
class VolatilityPrior:
    a: float
    b: float
    q: tuple[float, float, float]

    def sd(self, fppg: Column) -> Column:
        return F.greatest(F.lit(self.a) + F.lit(self.b) * fppg, F.lit(SD_FLOOR))


@dataclass
class Fitted:
    config: BaselineConfig
    scoring: Mapping[str, float]
    target: int
    season_games: float
    panel: DataFrame
    minutes: QuantityFit
    rates: dict[str, QuantityFit]
    volatility: QuantityFit
    vol_prior: VolatilityPrior
    availability: fits.Logit
    phi: float
    appearance: fits.Logit | None
    rookie: dict
    shape: tuple[float, float, float]
    shift: Column
    tau: dict[int, float] = field(default_factory=dict)


def availability_columns(decay: float, n_lags: int, mpg: Column) -> dict[str, Column]:
    f = [F.col(f"f_lag{k}") for k in range(1, n_lags + 1)]
    bar = recency_weighted(f, decay)
    age = F.coalesce((F.col("age") - 27.0) / 5.0, F.lit(0.0))
    return {"a_bar": bar, "a_last": F.coalesce(f[0], bar), "a_min": F.array_min(F.array_compact(F.array(*f))), "a_gap": f[0].isNull().cast("double"), "a_age": age, "a_age2": age * age, "a_mpg": (mpg - 20.0) / 10.0}


def appearance_columns(n_lags: int) -> dict[str, Column]:
    f = [F.col(f"f_lag{k}") for k in range(1, n_lags + 1)]
    n = sum((x.isNotNull().cast("double") for x in f[1:]), f[0].isNotNull().cast("double"))
    last = F.lit(float(n_lags + 1))
    for k in range(n_lags, 0, -1):
        last = F.when(f[k - 1].isNotNull(), F.lit(float(k))).otherwise(last)
    return {"a_present": n, "a_since": last}


def stat_block(mpg: Column) -> dict[str, Column]:
    """Per-event stats from minutes and rates; box-score identities hold by construction."""
    c = F.col
    fga, fg3a, fta = c("fga") * mpg, F.least(c("fg3a"), c("fga")) * mpg, c("fta") * mpg
    fg3m, ftm = fg3a * c("fg3_pct"), fta * c("ft_pct")
    fgm = F.greatest(fga * c("fg_pct"), fg3m)
    out = {"pts": 2 * fgm + fg3m + ftm, "fgm": fgm, "fga": fga, "fg3m": fg3m, "ftm": ftm, "fta": fta}
    return out | {k: c(k) * mpg for k in ("reb", "ast", "stl", "blk", "tov")}


def fit_volatility(panel: DataFrame, scored: DataFrame, cfg: BaselineConfig) -> VolatilityPrior:
    ok = panel.where((F.col("gp") >= cfg.vol_min_games) & F.col("fp_sd").isNotNull())
    g = fits.gram(ok, ["fppg"], "fp_sd", "gp")
    a, b = (float(v) for v in g.solve()) if g.n >= 5 else (8.0, 0.0)
    keep = panel.where((F.col("gp") >= cfg.vol_quantile_min_games) & (F.col("fp_sd") > 0)).select("player_id", "s", "fppg", "fp_sd")
    z = cut_lineage(scored.join(keep, ["player_id", "s"]).select(((F.col("fp") - F.col("fppg")) / F.col("fp_sd")).alias("z")))      # read by every pass of the quantiles
    lo, mid, hi = cfg.quantiles
    q = exact_quantiles(z, [], "z", {"a": lo, "b": mid, "c": hi}).first()
    return VolatilityPrior(a, b, tuple(float(v) for v in q) if q is not None and q[0] is not None else (-1.28155, 0.0, 1.28155))


def fit_rookies(panel: DataFrame, players: DataFrame, cfg: BaselineConfig, minutes: QuantityFit, rates: dict[str, QuantityFit]) -> dict:
    """Draft-slot regressions of every target in one stacked pass, or the replacement-level fallback."""
    facts = players.select("player_id", "draft_year", pick_slot(F.col("draft_number"), F.col("draft_round")).alias("pick")).dropDuplicates(["player_id"])
    r = panel.join(facts, "player_id").where(F.col("draft_year") == F.col("s"))
    n, log_pick, age = r.agg(F.count(F.lit(1)), F.avg(F.log("pick")), F.avg("age")).first()
    rot = panel.where(F.col("gp") >= 20)
    rot = rot if rot.limit(1).count() else panel
    base_mpg = fits.weighted_quantile(rot, "mpg", "gp", [0.20])[0]
    base_f = panel.agg(F.percentile("f", F.lit(0.5))).first()[0]
    out = {"mode": "replacement", "n": int(n), "mpg": base_mpg, "f": float(base_f)}
    if n < cfg.min_rookie_rows:
        return out
    mid_age = float(age) if age is not None else 21.0
    targets = [("mpg", F.col("mpg"), F.col("gp").cast("double")), ("f", F.col("f"), F.lit(1.0))]
    targets += [(q.name, F.when(F.col(q.den) > 0, F.col(q.num) / F.col(q.den)), F.col(q.den).cast("double")) for q in RATES]
    items = F.array(*[F.struct(F.lit(name).alias("q"), y.cast("double").alias("y"), w.alias("w")) for name, y, w in targets])
    x = r.select((F.log("pick") - float(log_pick)).alias("lp"), (F.col("pos_group") == "G").cast("double").alias("g"), (F.col("pos_group") == "C").cast("double").alias("c"),
                 F.coalesce(F.col("age") - mid_age, F.lit(0.0)).alias("a"), F.explode(items).alias("_x")).select("lp", "g", "c", "a", "_x.*")
    grams = fits.gram(x, ["lp", "g", "c", "a"], "y", "w", by="q")
    top = r.where(F.col("pick") <= TOP_PLATEAU).agg(F.count("f"), F.avg("f")).first()
    return out | {"mode": "draft_slot", "center": (float(log_pick), mid_age), "beta": {k: [float(v) for v in g.solve(ROOKIE_RIDGE)] for k, g in grams.items()},
                  "f_cap": float(top[1]) if top[0] >= MIN_PLATEAU else None}


class BaselineProjector:
    """Minutes, rates, availability and volatility of every recent entity, plus a draft-slot prior for newcomers."""

    def __init__(self, scoring: Mapping[str, float], config: BaselineConfig | None = None, *, name: str = "baseline", availability_features: list[Feature] | None = None,
                 minutes_features: list[Feature] | None = None):
        self.scoring, self.config, self.name = dict(scoring), config or BaselineConfig(), name
        self.availability_features, self.minutes_features = availability_features or [], minutes_features or []

    # ------------------------------------------------------------------ fit

    def _with(self, features: list[Feature], history: History, rows: DataFrame) -> tuple[DataFrame, list[str]]:
        if features:
            rows = rows.drop(*[c for c in rows.columns if c.startswith(EXTRA)])       # a layer may serve both minutes and availability
        before = set(rows.columns)
        for f in features:
            rows = f(history, rows)
        return rows, [c for c in rows.columns if c not in before and c.startswith(EXTRA)]

    def fit(self, history: History) -> Fitted:
        history.assert_no_future()
        cfg, n = self.config, self.config.n_lags
        logs = history["game_logs"]
        panel = cut_lineage(build_panel(logs, history["team_games"], history["players"], history["player_season_bio"], self.scoring))      # one row per entity and season, read by every fit
        scored = logs.select("player_id", season_year_fast(F.col("season")).alias("s"), weighted_score(logs, self.scoring, columns=STAT_COLUMNS).alias("fp"))
        vol = fit_volatility(panel, scored, cfg)
        valid = (F.col("gp") >= cfg.vol_min_games) & F.col("fp_sd").isNotNull()
        panel = panel.withColumn("gpz", F.when(valid, F.col("gp")).otherwise(0).cast("double")).withColumn("z_gp", F.when(valid, F.col("fp_sd") / vol.sd(F.col("fppg")) * F.col("gp")).otherwise(0.0))
        train = cut_lineage(lag_frame(panel, panel, (*RATES, MINUTES, VOLATILITY), n))
        first = fit_quantities(panel, train, (MINUTES, VOLATILITY), cfg)
        minutes, volatility = first["mpg"], first["vol"]
        pred = predict_quantities(train, {"mpg": minutes}, n).select("player_id", "s", clip(F.col("mpg"), 0.0, cfg.mpg_max).alias("mpg_pred"))
        train = cut_lineage(train.join(pred, ["player_id", "s"]))
        rates = fit_quantities(panel, train, RATES, cfg, mpg="mpg_pred")
        known = train.where(has_history(n))

        shift = F.lit(0.0)
        if self.minutes_features:
            rows, names = self._with(self.minutes_features, history, known.withColumn("_resid", F.col("mpg") - F.col("mpg_pred")))
            shift = fits.clipped_shift_fit(rows, names, "_resid", "gp")
        a_cols = availability_columns(cfg.availability_decay, n, F.col("mpg_pred"))
        rows, extra = self._with(self.availability_features, history, known)
        rows = rows.select("*", *[c.alias(k) for k, c in a_cols.items()])
        avail = fits.fit_logit(rows.where(F.col("f") > 0), [*a_cols, *extra], "f", c=cfg.availability_c, min_rows=cfg.availability_min_rows)
        mu = avail.probability(*MU_CLIP)
        phi = rows.where(F.col("f") > 0).select(F.col("f"), mu.alias("mu")).agg((F.sum((F.col("f") - F.col("mu")) * (F.col("f") - F.col("mu"))) / F.sum(F.col("mu") * (1 - F.col("mu")))).alias("p")).first()[0]
        phi = min(max(float(phi), PHI_CLIP[0]), PHI_CLIP[1]) if avail.fitted and phi is not None else DEFAULT_PHI
        appearance = self._fit_appearance(panel, history, minutes) if cfg.appearance_hurdle else None
        lengths = period_lengths(history["team_games"].withColumn("s", season_year_fast(F.col("season"))))
        games = cfg.season_games or round(lengths.orderBy(F.desc("s")).limit(3).agg(F.max("season_len")).first()[0])
        out = Fitted(cfg, self.scoring, history.target, float(games), panel, minutes, rates, volatility, vol, avail, phi, appearance, fit_rookies(panel, history["players"], cfg, minutes, rates), vol.q, shift)
        back = cut_lineage(self._components(out, history, train.where(has_history(n))))
        out.shape = self._calibrated(out, back, scored)
        if cfg.season_intervals:
            out.tau = self._spread(back, panel)
        return out

    def _fit_appearance(self, panel: DataFrame, history: History, minutes: QuantityFit) -> fits.Logit:
        """Chance of appearing at all: everyone active in the seasons before each season, labelled by whether a row follows."""
        cfg, n = self.config, self.config.n_lags
        last = panel.agg(F.max("s")).first()[0]
        due = panel.select("player_id", F.explode(F.array(*[F.col("s") + k for k in range(1, cfg.active_seasons + 1)])).alias("s")).distinct().where(F.col("s") <= last)
        rows = due.join(panel.select("player_id", "s", F.lit(1.0).alias("_seen")), ["player_id", "s"], "left").na.fill({"_seen": 0.0})
        rows = ages_at(rows, history["players"], history["player_season_bio"]).withColumn("pos_group", F.lit("U"))
        frame = cut_lineage(lag_frame(rows, panel, (*RATES, MINUTES, VOLATILITY), n))
        pred = predict_quantities(frame, {"mpg": minutes}, n).select("player_id", "s", clip(F.col("mpg"), 0.0, cfg.mpg_max).alias("_mpg"))
        frame = frame.join(pred, ["player_id", "s"])
        cols = availability_columns(cfg.availability_decay, n, F.col("_mpg")) | appearance_columns(n)
        return fits.fit_logit(frame.select("_seen", *[c.alias(k) for k, c in cols.items()]), list(cols), "_seen", c=cfg.appearance_c, min_rows=cfg.appearance_min_rows)

    # ------------------------------------------------------------------ predict

    def _components(self, m: Fitted, history: History, frame: DataFrame) -> DataFrame:
        """Minutes, rates, availability and volatility for lagged rows."""
        cfg, n = m.config, m.config.n_lags
        rows, _ = self._with(self.minutes_features, history, frame)
        first = predict_quantities(frame, {"mpg": m.minutes, "vol": m.volatility}, n).select("player_id", "s", F.col("mpg").alias("_mpg"), F.col("vol").alias("z_hat"))
        rows = rows.drop("mpg", "mpg_pred").join(first, ["player_id", "s"]).withColumn("proj_mpg", clip(F.col("_mpg") + m.shift, 0.0, cfg.mpg_max))
        rated = predict_quantities(rows, m.rates, n, mpg="proj_mpg").select("player_id", "s", *m.rates, "fga_n")
        rows, _ = self._with(self.availability_features, history, rows)
        a_cols = availability_columns(cfg.availability_decay, n, F.col("proj_mpg")) | (appearance_columns(n) if m.appearance else {})
        rows = rows.select("*", *[c.alias(k) for k, c in a_cols.items()])
        if m.availability.fitted:
            mu = m.availability.probability(*MU_CLIP)
        else:
            rate = F.lit(m.availability.base_rate)
            mu = clip(0.5 * F.coalesce("a_bar", rate) + 0.5 * rate, *MU_CLIP)
        p = m.appearance.probability(0.02, 1.0) if m.appearance else F.lit(1.0)
        seen = sum((F.col(f"f_lag{k}").isNotNull().cast("int") for k in range(2, n + 1)), F.col("f_lag1").isNotNull().cast("int"))
        kept = rows.select("player_id", "s", "age", "proj_mpg", mu.alias("mu_f"), p.alias("p_appear"), "z_hat", seen.alias("n_hist_seasons")).join(rated, ["player_id", "s"])
        weight = F.col("fga_n") / (F.col("fga_n") + m.rates["fga"].kappa)
        kept = kept.select("player_id", "s", "age", "proj_mpg", *m.rates, "mu_f", "p_appear", "z_hat", "n_hist_seasons", weight.alias("data_weight"), F.lit(False).alias("is_rookie"))
        return self._scored(m, kept)

    def _scored(self, m: Fitted, d: DataFrame) -> DataFrame:
        stats = stat_block(F.col("proj_mpg"))
        d = d.select("*", *[c.alias("proj_" + k) for k, c in stats.items()])
        d = d.withColumn("proj_fppg", weighted_score(d, m.scoring, prefix="proj_", columns=STAT_COLUMNS))
        return d.withColumn("proj_fppg_sd", F.col("z_hat") * m.vol_prior.sd(F.col("proj_fppg")))

    def _calibrated(self, m: Fitted, back: DataFrame, scored: DataFrame, *, min_games: int = 500) -> tuple[float, float, float]:
        """Quantiles of (event score - projection) / projected deviation over the history's own events."""
        u = scored.join(back.select("player_id", "s", "proj_fppg", "proj_fppg_sd"), ["player_id", "s"]).select(((F.col("fp") - F.col("proj_fppg")) / F.col("proj_fppg_sd")).alias("u"))
        u = cut_lineage(u)                                                                 # read by every pass of the quantiles
        if u.count() < min_games:
            return m.vol_prior.q
        a, b, c = m.config.quantiles
        return tuple(float(v) for v in exact_quantiles(u, [], "u", {"a": a, "b": b, "c": c}).first())

    def _spread(self, back: DataFrame, panel: DataFrame, *, min_gp: int = 10) -> dict[int, float]:
        """Relative spread of the season mean around its projection by seasons of history, event noise removed."""
        j = back.select("player_id", "s", "proj_fppg", "proj_fppg_sd", F.least("n_hist_seasons", F.lit(3)).alias("b")).join(panel.select("player_id", "s", "fppg", "gp"), ["player_id", "s"])
        j = j.where((F.col("proj_fppg") >= PRED_FLOOR) & (F.col("gp") >= min_gp))
        r2 = F.pow((F.col("fppg") - F.col("proj_fppg")) / F.col("proj_fppg"), F.lit(2.0))
        noise = F.pow(F.col("proj_fppg_sd") / F.col("proj_fppg"), F.lit(2.0)) / F.col("gp")
        rows = j.groupingSets([[], [F.col("b")]], "b").agg(F.grouping("b").alias("g"), F.count(F.lit(1)).alias("n"), (F.avg(r2) - F.avg(noise)).alias("v")).collect()
        est = lambda v: max(v, TAU_FLOOR ** 2) ** 0.5        # noqa: E731
        pooled = next((est(r["v"]) for r in rows if r["g"] == 1 and r["n"]), DEFAULT_TAU)
        own = {r["b"]: est(r["v"]) for r in rows if r["g"] == 0 and r["n"] >= MIN_BUCKET_ROWS}
        return {b: own.get(b, pooled) for b in range(4)}

    def _newcomers(self, m: Fitted, history: History) -> DataFrame:
        players = history["players"]
        new = players.where(F.col("draft_year") == m.target).join(m.panel.select("player_id").distinct(), "player_id", "left_anti").dropDuplicates(["player_id"])
        rows = ages_at(new.select("player_id", F.lit(m.target).alias("s"), pick_slot(F.col("draft_number"), F.col("draft_round")).alias("pick"), F.col("position")), players, history["player_season_bio"])
        return self.prior_rows(m, rows.withColumn("pos_group", position_group(F.col("position"))))

    def prior_rows(self, m: Fitted, rows: DataFrame, *, mpg_scale: Column | float = 1.0, mu: Column | None = None) -> DataFrame:
        """Components of entities without history from the draft-slot prior."""
        rk = m.rookie
        as_col = lambda v: v if isinstance(v, Column) else F.lit(float(v))      # noqa: E731
        if rk["mode"] == "draft_slot":
            lp, ag = rk["center"]
            x = [F.log("pick") - lp, (F.col("pos_group") == "G").cast("double"), (F.col("pos_group") == "C").cast("double"), F.coalesce(F.col("age") - ag, F.lit(0.0))]
            dot = lambda k: sum((F.lit(b) * v for b, v in zip(rk["beta"][k][1:], x)), F.lit(rk["beta"][k][0]))     # noqa: E731
            f = dot("f") if rk["f_cap"] is None else F.least(dot("f"), F.lit(rk["f_cap"]))
            mpg, rate = dot("mpg"), dot
        else:
            f, mpg = F.lit(rk["f"]), F.lit(rk["mpg"])
            rate = lambda k: m.rates[k].prior_at(rk["mpg"])          # noqa: E731
        out = rows.select("player_id", "s", "age", clip(mpg * as_col(mpg_scale), 0.5, m.config.mpg_max).alias("proj_mpg"), *[clip(rate(q.name), *((0.0, 1.0) if q.kind == "pct" else (0.0, 5.0))).alias(q.name) for q in RATES],
                          clip(f if mu is None else mu, *MU_CLIP).alias("mu_f"), F.lit(1.0).alias("p_appear"), F.lit(1.0).alias("z_hat"), F.lit(0).alias("n_hist_seasons"), F.lit(0.0).alias("data_weight"), F.lit(True).alias("is_rookie"))
        return self._scored(m, out)

    def predict(self, m: Fitted, history: History) -> DataFrame:
        cfg = m.config
        newest = m.panel.agg(F.max("s")).scalar()
        active = m.panel.where(F.col("s") > newest - cfg.active_seasons).select("player_id", "pos_group").distinct().withColumn("s", F.lit(m.target))
        rows = ages_at(active, history["players"], history["player_season_bio"])
        frame = cut_lineage(lag_frame(rows, m.panel, (*RATES, MINUTES, VOLATILITY), cfg.n_lags))       # read for minutes, rates and availability
        d = self._components(m, history, frame).unionByName(self._newcomers(m, history))
        names = history["players"].select("player_id", "player_name").dropDuplicates(["player_id"])
        d = d.join(names, "player_id", "left").withColumn("player_name", F.coalesce("player_name", F.col("player_id").cast("string")))
        games = F.lit(m.season_games)
        gp = F.col("mu_f") * F.col("p_appear") * games
        base_sd = F.sqrt(F.lit(m.phi) * F.col("mu_f") * (1 - F.col("mu_f")))
        # zero-inflated share: mean p*mu, variance p*(sd^2 + mu^2) - (p*mu)^2
        sd = F.sqrt(F.greatest(F.col("p_appear") * (base_sd * base_sd + F.col("mu_f") * F.col("mu_f")) - F.pow(F.col("p_appear") * F.col("mu_f"), F.lit(2.0)), F.lit(0.0)))
        lo, mid, hi = m.shape
        out = d.withColumn("proj_gp", gp).withColumn("proj_total_fp", F.col("proj_fppg") * gp)
        tau = F.lit(0.0)
        if m.tau:
            tau = F.element_at(F.create_map(*[F.lit(x) for kv in m.tau.items() for x in kv]), F.least(F.col("n_hist_seasons"), F.lit(3)))
        confidence = F.when(F.col("data_weight") < 0.5, "low").when(F.col("data_weight") < 0.8, "medium").otherwise("high")
        return out.select(
            season_label(F.lit(m.target)).alias("season"), "player_id", "player_name", F.lit(self.name).alias("model"), "proj_gp", "proj_mpg", *["proj_" + c for c in STAT_COLUMNS.values()],
            "proj_fppg", "proj_total_fp", *[(F.col("proj_fppg") + F.lit(q) * F.col("proj_fppg_sd")).alias(k) for q, k in ((lo, "fppg_p10"), (mid, "fppg_p50"), (hi, "fppg_p90"))],
            "proj_fppg_sd", (sd * games).alias("proj_gp_sd"), clip(gp - 1.2816 * sd * games, 0.0, m.season_games).alias("proj_gp_p10"), clip(gp + 1.2816 * sd * games, 0.0, m.season_games).alias("proj_gp_p90"),
            (F.col("proj_fppg") * tau).alias("proj_fppg_spread"), "age", "is_rookie", "n_hist_seasons", confidence.alias("confidence"), F.col("p_appear").alias("proj_p_appear"))

    def project(self, history: History) -> DataFrame:
        # which players were known is a join over all events: made once, read by every part
        history = History(history.target, {**history.tables, "players": cut_lineage(history["players"])})
        return self.predict(self.fit(history), history)

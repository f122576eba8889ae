"""Decayed, age-shifted and shrunk rates: one set of grouped passes fits every quantity at once.

Age curves, prior regressions and the grid over decay and shrinkage are each a single grouped pass over one row per entity and
period, whatever the number of quantities, decays and constants.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_schema

from tallyline.operators.fit import KAPPA_HIGH, KAPPA_LOW, KAPPA_POINTS, AgeCurve, gram, grid_losses_of, log_grid
from tallyline.operators.panel import attach_lags
from tallyline.operators.ranking import asc, with_running_sum
from tallyline.session import cut_lineage, spread


@dataclass(frozen=True)
class Quantity:
    name: str
    num: str
    den: str
    kind: str                      # rate, pct, minutes or ratio
    age: bool = True
    prior: str = "regression"      # regression, constant or one


RATES = tuple(Quantity(n, n, "min", "rate") for n in ("fga", "fta", "fg3a", "reb", "ast", "stl", "blk", "tov")) + (
    Quantity("fg_pct", "fgm", "fga", "pct"), Quantity("ft_pct", "ftm", "fta", "pct"), Quantity("fg3_pct", "fg3m", "fg3a", "pct"))
MINUTES = Quantity("mpg", "min", "gp", "minutes", prior="constant")
VOLATILITY = Quantity("vol", "z_gp", "gpz", "ratio", age=False, prior="one")
BOUNDS = {"rate": (0.0, 5.0), "pct": (0.0, 1.0), "minutes": (0.0, 48.0), "ratio": (0.2, 5.0)}


@dataclass(frozen=True)
class BaselineConfig:
    """Hyper-parameters of the baseline projection."""

    n_lags: int = 4
    decay_grid: tuple[float, ...] = (0.3, 0.5, 0.7, 0.9)
    default_decay: float = 0.6
    age_degree: int = 2
    age_min_pairs: int = 40
    min_fit_rows: int = 30
    availability_decay: float = 0.6
    availability_c: float = 1.0
    availability_min_rows: int = 60
    appearance_hurdle: bool = False
    appearance_c: float = 1.0
    appearance_min_rows: int = 100
    season_intervals: bool = False
    min_rookie_rows: int = 20
    active_seasons: int = 2
    vol_min_games: int = 10
    vol_quantile_min_games: int = 20
    mpg_max: float = 44.0
    quantiles: tuple[float, float, float] = (0.10, 0.50, 0.90)
    season_games: int | None = None
    default_kappa: dict[str, float] = field(default_factory=lambda: {
        "mpg": 25.0, "fga": 400.0, "fta": 400.0, "fg3a": 500.0, "reb": 400.0, "ast": 400.0, "stl": 800.0, "blk": 800.0, "tov": 500.0,
        "fg_pct": 300.0, "ft_pct": 150.0, "fg3_pct": 250.0, "vol": 15.0})


@dataclass
class QuantityFit:
    """What was learned about one quantity."""

    q: Quantity
    decay: float
    kappa: float
    curve: AgeCurve
    beta: tuple[float, ...]
    fitted: bool = False

    def prior_at(self, mpg: float) -> Column:
        """Prior mean for a fixed number of minutes, by position group."""
        if self.q.prior != "regression":
            return F.lit(self.beta[0])
        g, c = (F.col("pos_group") == "G").cast("double"), (F.col("pos_group") == "C").cast("double")
        return F.lit(self.beta[0]) + F.lit(self.beta[1]) * g + F.lit(self.beta[2]) * c + F.lit(self.beta[3] * mpg / 10.0)


# ---- estimates of a batch of rows, worked out in the tasks: a row is never copied for a quantity or a decay

def _numbers(batch: pa.RecordBatch, name: str) -> tuple[np.ndarray, np.ndarray]:
    """A column's values with 0 for nulls, and which are known."""
    column = batch.column(name)
    return column.fill_null(0.0).to_numpy(zero_copy_only=False), column.is_valid().to_numpy(zero_copy_only=False)


def _change_to(curve: AgeCurve, age: np.ndarray) -> np.ndarray:
    """Integral of the age curve up to ``age``, continued with constant slope beyond its support."""
    c = [*curve.coefs, 0.0, 0.0, 0.0][:3]
    a = np.fmin(np.maximum(age, curve.lo), curve.hi)
    x = a - curve.center
    area = x * (c[0] + x * (c[1] / 2 + x * c[2] / 3))
    return area + (c[0] + x * (c[1] + x * c[2])) * (age - a)


def _lagged(batch: pa.RecordBatch, f: QuantityFit, n_lags: int) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Lag numerators shifted to the row's age and lag denominators, nearest first; a missing lag counts nothing."""
    age, aged = _numbers(batch, "age")
    dens = [_numbers(batch, f"{f.q.den}_lag{k}")[0] for k in range(1, n_lags + 1)]
    moved, curved = [], f.q.age and not f.curve.is_flat
    here = _change_to(f.curve, age) if curved else None
    for k, den in enumerate(dens, 1):
        shift = np.where(aged, here - _change_to(f.curve, age - k), 0.0) if curved else 0.0
        moved.append(_numbers(batch, f"{f.q.num}_lag{k}")[0] + den * shift)
    return moved, dens


def _decayed(values: list[np.ndarray], decay: float) -> np.ndarray:
    return sum((v * decay ** i for i, v in enumerate(values)), 0.0)


def _prior(batch: pa.RecordBatch, f: QuantityFit) -> tuple[np.ndarray, np.ndarray]:
    """Prior means by position group and minutes, and which are known."""
    b = [*f.beta, 0.0, 0.0, 0.0][:4]
    (minutes, known), group = _numbers(batch, "_minutes"), batch.column("pos_group")
    g, c = (pc.equal(group, x).fill_null(False).to_numpy(zero_copy_only=False).astype(np.float64) for x in "GC")
    return b[0] + b[1] * g + b[2] * c + b[3] * minutes / 10.0, known & group.is_valid().to_numpy(zero_copy_only=False)


def _bounded(f: QuantityFit, v: np.ndarray) -> np.ndarray:
    low, high = BOUNDS[f.q.kind]
    return np.fmin(np.maximum(v, low), high)


def _estimated(frame: DataFrame, quantities: Iterable[Quantity], n_lags: int, minutes: Column, *, target: bool) -> DataFrame:
    """What the estimates of the quantities read: one row for each of ``frame``'s, with own values only for training rows."""
    columns = sorted({c for q in quantities for c in (q.num, q.den)})
    names = [*(columns if target else []), *[f"{c}_lag{k}" for c in columns for k in range(1, n_lags + 1)]]
    return frame.select("player_id", "s", F.col("age").cast("double").alias("age"), "pos_group", minutes.cast("double").alias("_minutes"), *[F.col(c).cast("double").alias(c) for c in names])


def predict_quantities(frame: DataFrame, fits: dict[str, QuantityFit], n_lags: int, *, mpg: str | None = None) -> DataFrame:
    """(player_id, s, <quantity>..., <quantity>_n...): shrunk, bounded estimates and their exposure, all quantities in one grouped pass."""
    rows = _estimated(frame, [f.q for f in fits.values()], n_lags, F.col(mpg) if mpg else F.lit(0.0), target=False)
    names = [f.q.name for f in fits.values()]
    made = T.StructType([*rows.select("player_id", "s").schema, *[T.StructField(c, T.DoubleType()) for name in names for c in (name, name + "_n")]])

    def estimates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = to_arrow_schema(made)
        for batch in batches:
            out = [batch.column("player_id"), batch.column("s")]
            with np.errstate(all="ignore"):
                for f in fits.values():
                    prior, known = _prior(batch, f)
                    top, n = (_decayed(values, f.decay) for values in _lagged(batch, f, n_lags))
                    est = np.where((n > 0) | np.isnan(n), _bounded(f, top / n), prior)
                    v = prior + np.where(n + f.kappa == 0, 0.0, n / (n + f.kappa)) * (est - prior)
                    out += [pa.array(_bounded(f, np.where(known, v, -np.inf))), pa.array(n)]       # without a prior: the least value
            yield pa.record_batch(out, schema=schema)

    est = rows.mapInArrow(estimates, made)
    return est.groupBy("player_id", "s").agg(*[F.max(c).alias(c) for c in [*names, *[name + "_n" for name in names]]])


def lag_frame(rows: DataFrame, panel: DataFrame, quantities: tuple[Quantity, ...], n_lags: int) -> DataFrame:
    """Rows (player_id, s, age, pos_group, ...) with the lags every quantity needs."""
    cols = sorted({"gp", "f", "min"} | {c for q in quantities for c in (q.num, q.den)})
    return attach_lags(rows, panel, entity="player_id", period="s", n_lags=n_lags, columns=cols)


def has_history(n_lags: int) -> Column:
    return F.coalesce(*[F.col(f"gp_lag{k}") for k in range(1, n_lags + 1)]).isNotNull()


def fit_curves(panel: DataFrame, quantities: tuple[Quantity, ...], cfg: BaselineConfig) -> dict[str, AgeCurve]:
    """Age curves of all quantities: moments per quantity in one pass, support quantiles in another."""
    aged = [q for q in quantities if q.age]
    out = {q.name: AgeCurve() for q in quantities}
    if not aged:
        return out
    columns = sorted({c for q in aged for c in (q.num, q.den)})
    base = panel.select("player_id", "s", "age", *[F.col(c).cast("double").alias(c) for c in columns])
    later = base.select("player_id", (F.col("s") - 1).alias("s"), *[F.col(c).alias(c + "_next") for c in columns])
    pairs = base.where(F.col("age").isNotNull()).join(later, ["player_id", "s"])              # once for all quantities
    moves, sums = [], []
    for i, q in enumerate(aged):
        den, den_next = F.col(q.den), F.col(q.den + "_next")
        delta, weight = F.try_divide(F.col(q.num + "_next"), den_next) - F.try_divide(F.col(q.num), den), F.try_divide(den * den_next, den + den_next)
        moves.append(F.when((den > 0) & (den_next > 0) & delta.isNotNull() & (weight > 0), F.struct(weight.alias("w"), (weight * delta).alias("wd"))).alias(f"_{i}"))
        sums.append(F.struct(F.lit(q.name).alias("q"), F.sum(F.col(f"_{i}.w")).alias("w"), F.sum(F.col(f"_{i}.wd")).alias("wd"), F.count(F.col(f"_{i}.w")).alias("n")))
    # everything the fit needs is a sum per (quantity, age)
    per_age = pairs.select("age", *moves).groupBy("age").agg(F.array(*sums).alias("_x")).select("age", F.inline("_x")).where(F.col("n") > 0)
    per_age = cut_lineage(per_age.select("q", "age", "w", (F.col("wd") / F.col("w")).alias("delta"), "n"))
    powers = [f"p{i}" for i in range(1, cfg.age_degree + 1)]
    x = per_age.select("q", "delta", "w", *[F.pow(F.col("age") - 27.0, F.lit(float(i))).alias(c) for i, c in enumerate(powers, 1)])
    grams = gram(x, powers, "delta", "w", by="q")
    run = with_running_sum(per_age, ["q"], [asc("age")], F.col("w"), "cum").join(per_age.groupBy("q").agg(F.sum("w").alias("all")), "q")
    rows = run.groupBy("q").agg(F.sum("n").alias("n"), F.countDistinct(F.round("age")).alias("k"), F.min(F.when(F.col("cum") >= 0.025 * F.col("all"), F.col("age"))).alias("lo"),
                                F.min(F.when(F.col("cum") >= 0.975 * F.col("all"), F.col("age"))).alias("hi")).collect()                   # one row per quantity
    sizes, span = {r["q"]: (r["n"], r["k"]) for r in rows}, {r["q"]: (r["lo"], r["hi"]) for r in rows}
    for q in aged:
        n, k = sizes.get(q.name, (0, 0))
        if n >= cfg.age_min_pairs and k >= cfg.age_degree + 2:
            out[q.name] = AgeCurve(tuple(float(c) for c in grams[q.name].solve(0.0)), 27.0, float(span[q.name][0]), float(span[q.name][1]), int(n))
    return out


def _tried(fits: dict[str, QuantityFit], decays: dict[str, tuple[float, ...]], n_lags: int) -> Callable[[pa.RecordBatch], Iterator[tuple]]:
    """Training rows of every quantity and decay, as ``grid_losses_of`` takes them: those with a value of their own, a prior and a history."""
    def groups(batch: pa.RecordBatch) -> Iterator[tuple]:
        for name, f in fits.items():
            (num, a), (den, b), (prior, c) = _numbers(batch, f.q.num), _numbers(batch, f.q.den), _prior(batch, f)
            moved, dens = _lagged(batch, f, n_lags)
            for decay in decays[name]:
                n = _decayed(dens, decay)
                ok = a & b & c & (den > 0) & (n > 0)
                if ok.any():
                    yield (name, decay), _bounded(f, _decayed(moved, decay)[ok] / n[ok]), prior[ok], n[ok], num[ok] / den[ok], den[ok]
    return groups


def fit_quantities(panel: DataFrame, train: DataFrame, quantities: tuple[Quantity, ...], cfg: BaselineConfig, *, mpg: str | None = None) -> dict[str, QuantityFit]:
    """Curve, prior, decay and shrinkage of every quantity. ``train`` is the lag frame of the panel rows; ``mpg`` names the
    minutes the rate priors see while tuning (the predicted ones, as in forecasting)."""
    curves = fit_curves(panel, quantities, cfg)
    betas: dict[str, tuple[float, ...]] = {q.name: (1.0,) for q in quantities if q.prior == "one"}
    regress = [q for q in quantities if q.prior == "regression"]
    if regress:
        items = F.array(*[F.struct(F.lit(q.name).alias("q"), F.col(q.num).cast("double").alias("num"), F.col(q.den).cast("double").alias("den")) for q in regress])
        rows = panel.withColumn("_x", F.explode(items)).select("_x.*", (F.col("pos_group") == "G").cast("double").alias("g"), (F.col("pos_group") == "C").cast("double").alias("c"), (F.col("mpg") / 10).alias("m"))
        grams = gram(rows.where(F.col("den") > 0).withColumn("rate", F.col("num") / F.col("den")), ["g", "c", "m"], "rate", "den", by="q")
        betas |= {name: tuple(float(v) for v in g.solve()) for name, g in grams.items()}
    constant = [q for q in quantities if q.prior == "constant"]
    if constant:
        sums = panel.agg(*[(F.sum(F.when(F.col(q.den) > 0, F.col(q.num))) / F.sum(F.when(F.col(q.den) > 0, F.col(q.den)))).alias(q.name) for q in constant]).first()
        betas |= {q.name: (float(sums[q.name]),) for q in constant}
    fits = {q.name: QuantityFit(q, cfg.default_decay, cfg.default_kappa[q.name], curves[q.name], betas.get(q.name, (0.0, 0.0, 0.0, 0.0))) for q in quantities}

    rows = spread(train.where(has_history(cfg.n_lags)))
    if rows.count() < cfg.min_fit_rows:
        return fits
    data = _estimated(rows, quantities, cfg.n_lags, F.col(mpg or "mpg"), target=True)
    grid = log_grid(KAPPA_LOW, KAPPA_HIGH, KAPPA_POINTS)
    keys = T.StructType([T.StructField("q", T.StringType()), T.StructField("decay", T.DoubleType())])
    losses = grid_losses_of(data, _tried(fits, {q: cfg.decay_grid for q in fits}, cfg.n_lags), keys, grid).collect()           # quantities x decays x grid points
    best = {}
    for r in sorted(losses, key=lambda r: (r["loss"], r["decay"], r["kappa"])):
        best.setdefault(r["q"], r)
    best = {q: r for q, r in best.items() if r["rows"] >= cfg.min_fit_rows}
    if best:
        fine = {q: log_grid(grid[max(grid.index(r["kappa"]) - 1, 0)], grid[min(grid.index(r["kappa"]) + 1, KAPPA_POINTS - 1)], 41) for q, r in best.items()}
        chosen = _tried({q: fits[q] for q in best}, {q: (float(r["decay"]),) for q, r in best.items()}, cfg.n_lags)
        second = grid_losses_of(data, chosen, keys, fine)
        refined = {r["q"]: r["k"] for r in second.groupBy("q").agg(F.min_by("kappa", F.struct("loss", "kappa")).alias("k")).collect()}
        for q, r in best.items():
            fits[q].decay, fits[q].kappa, fits[q].fitted = float(r["decay"]), float(refined.get(q, r["kappa"])), True
    return fits

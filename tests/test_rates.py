"""Estimates of rates, minutes and curves: one row per entity and period goes to the tasks, none for a quantity or a decay."""

import pytest
from pyspark.sql import functions as F

from tallyline.operators import fit, panel
from tallyline.plans import rates
from tallyline.plans.rates import BaselineConfig, Quantity, QuantityFit

CURVE = fit.AgeCurve((0.01, -0.002, 0.0), 27.0, 20.0, 35.0, 50)
FGA = QuantityFit(Quantity("fga", "fga", "min", "rate"), 0.5, 100.0, CURVE, (0.3, 0.1, -0.1, 0.05), True)
VOL = QuantityFit(Quantity("vol", "z", "g", "ratio", age=False, prior="one"), 0.9, 15.0, fit.AgeCurve(), (1.0,), True)
FRAME = "player_id long, s int, age double, pos_group string, mpg double, fga_lag1 double, fga_lag2 double, min_lag1 double, min_lag2 double, z_lag1 double, z_lag2 double, g_lag1 double, g_lag2 double"


def _plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def _plain(f, age, group, mpg, nums, dens):
    """One row's estimate, written out."""
    def change(a):
        c, at = f.curve.coefs, min(max(a, f.curve.lo), f.curve.hi)
        x = at - f.curve.center
        return x * (c[0] + x * (c[1] / 2 + x * c[2] / 3)) + (c[0] + x * (c[1] + x * c[2])) * (a - at)

    low, high = rates.BOUNDS[f.q.kind]
    if group is None or mpg is None:
        return low
    b = [*f.beta, 0.0, 0.0, 0.0][:4]
    prior = b[0] + b[1] * (group == "G") + b[2] * (group == "C") + b[3] * mpg / 10
    moves = f.q.age and not f.curve.is_flat and age is not None
    top = sum(((nums[i] or 0.0) + (dens[i] or 0.0) * (change(age) - change(age - i - 1) if moves else 0.0)) * f.decay ** i for i in range(2))
    n = sum((d or 0.0) * f.decay ** i for i, d in enumerate(dens))
    est = min(max(top / n, low), high) if n > 0 else prior
    return min(max(prior + n / (n + f.kappa) * (est - prior), low), high)


def test_predictions_are_the_plain_ones_and_copy_no_rows(spark):
    data = [(1, 1999, 30.5, "G", 20.0, 400.0, 300.0, 900.0, 800.0, 20.0, 8.0, 18.0, 9.0),
            (2, 1999, 19.0, "C", 31.0, None, 300.0, None, 800.0, None, 90.0, None, 9.0),
            (3, 1999, 40.0, "F", 12.0, None, None, None, None, None, None, None, None),
            (4, 1999, None, "G", 25.0, 100.0, 900.0, 500.0, 60.0, 3.0, None, 4.0, 0.0),
            (5, 1999, 25.0, None, 25.0, 100.0, 50.0, 500.0, 60.0, 3.0, 1.0, 4.0, 2.0),
            (6, 1999, 25.0, "F", None, 100.0, 50.0, 500.0, 60.0, 3.0, 1.0, 4.0, 2.0),
            (7, 1999, 25.0, "F", 10.0, 100.0, 50.0, 500.0, 60.0, 3.0, 1.0, 4.0, 2.0),
            (7, 1999, 25.0, "F", 10.0, 900.0, 50.0, 500.0, 60.0, 3.0, 1.0, 5.0, 2.0),                   # of a key's rows the greatest values count
            (None, 1999, 25.0, "F", 10.0, 100.0, 50.0, 500.0, 60.0, 3.0, 1.0, 4.0, 2.0)]
    out = rates.predict_quantities(spark.createDataFrame(data, FRAME), {"fga": FGA, "vol": VOL}, 2, mpg="mpg")
    assert out.columns == ["player_id", "s", "fga", "vol", "fga_n", "vol_n"]
    want = {}
    for p, s, age, group, mpg, *v in data:
        new = (_plain(FGA, age, group, mpg, v[0:2], v[2:4]), _plain(VOL, age, group, mpg, v[4:6], v[6:8]), (v[2] or 0.0) + 0.5 * (v[3] or 0.0), (v[6] or 0.0) + 0.9 * (v[7] or 0.0))
        want[p] = tuple(map(max, new, want[p])) if p in want else new
    got = {r["player_id"]: tuple(r)[2:] for r in out.collect()}
    assert got.keys() == want.keys()
    for p in want:
        assert got[p] == pytest.approx(want[p], abs=1e-12), p
    assert "Generate" not in _plan(out)


def _panel(spark):
    rows = [(p, s, 19.0 + p % 13 + s - 1990 if p % 17 else None, "GFC"[p % 3] if p % 19 else None, float((p * 7 + s * 3) % 40), float(1 + (p + s) % 30 if (p + 2 * s) % 11 else 0), float(20 + (p * s) % 9))
            for p in range(150) for s in range(1990, 1997) if (p * 3 + s) % 5]
    made = spark.createDataFrame(rows, "player_id long, s int, age double, pos_group string, reb double, min double, mpg double")
    return made.withColumn("ast", F.col("reb") % 7).withColumn("gp", F.lit(2)).withColumn("f", F.lit(0.5))


def test_curves_of_all_quantities_are_those_of_each(spark):
    made, quantities = _panel(spark), (Quantity("reb", "reb", "min", "rate"), Quantity("ast", "ast", "min", "rate"), Quantity("vol", "ast", "min", "ratio", age=False))
    got = rates.fit_curves(made, quantities, BaselineConfig())
    assert got["vol"].is_flat
    for q in quantities[:2]:
        want = fit.fit_age_curve(panel.consecutive_pairs(made, q.num, q.den))
        assert want.n_pairs > 40 and (got[q.name].n_pairs, got[q.name].lo, got[q.name].hi) == (want.n_pairs, want.lo, want.hi)
        assert got[q.name].coefs == pytest.approx(want.coefs, abs=1e-9)


def test_fits_choose_the_best_of_the_grid_and_copy_no_rows(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(rates, "grid_losses_of", lambda df, *a: seen.append(_plan(df)) or fit.grid_losses_of(df, *a))
    made, cfg = _panel(spark), BaselineConfig(n_lags=2, decay_grid=(0.4, 0.8), default_kappa={"reb": 1.0})
    quantity = Quantity("reb", "reb", "min", "rate")
    train = rates.lag_frame(made, made, (quantity,), 2)
    got = rates.fit_quantities(made, train, (quantity,), cfg)["reb"]
    assert len(seen) == 2 and not any("Generate" in plan for plan in seen)
    losses = []
    known = train.where(rates.has_history(2) & (F.col("min") > 0)).collect()
    for decay in cfg.decay_grid:
        for kappa in fit.log_grid(fit.KAPPA_LOW, fit.KAPPA_HIGH, fit.KAPPA_POINTS):
            f, total, weights = QuantityFit(quantity, decay, kappa, got.curve, got.beta), 0.0, 0.0
            for r in known:
                dens = [r["min_lag1"], r["min_lag2"]]
                if r["pos_group"] is None or not sum((d or 0.0) for d in dens) > 0:
                    continue
                total += r["min"] * (r["reb"] / r["min"] - _plain(f, r["age"], r["pos_group"], r["mpg"], [r["reb_lag1"], r["reb_lag2"]], dens)) ** 2
                weights += r["min"]
            losses.append((total / weights, decay, kappa))
    _, decay, kappa = min(losses)
    assert got.fitted and got.decay == decay
    grid = fit.log_grid(fit.KAPPA_LOW, fit.KAPPA_HIGH, fit.KAPPA_POINTS)
    at = grid.index(kappa)
    assert grid[max(at - 1, 0)] * 0.999 <= got.kappa <= grid[min(at + 1, len(grid) - 1)] * 1.001

"""Many regressions from one pass: column subsets and ridges, each period from the periods before it, and a blend fitted on what they predict.

Rows are read once for the moments of all columns by period. A subset is a block of that matrix, solved by sweeping its columns in; a target
period is the sum of the periods before it. Only (p + 1)(p + 2) / 2 sums a period reach the driver. A column with gaps enters as two, known (1 or 0) and known
times value: setting the gaps to the training mean is then a change of basis of the moments, different for each target, and needs no further pass.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

from tallyline.operators.fit import Gram, by_period, gram

KNOWN, FILLED = "_known_", "_filled_"


def with_gaps(df: DataFrame, columns: list[str]) -> DataFrame:
    """``df`` with the two columns of each of ``columns`` that may be null."""
    for c in columns:
        df = df.withColumn(KNOWN + c, F.col(c).isNotNull().cast("double")).withColumn(FILLED + c, F.coalesce(F.col(c).cast("double"), F.lit(0.0)))
    return df


def sweep(m: np.ndarray, k: int) -> np.ndarray:
    """The matrix with column ``k`` brought into the regression (or, swept again with the sign turned, taken out)."""
    out = m - np.outer(m[:, k], m[k, :]) / m[k, k]
    out[k, :], out[:, k] = m[k, :] / m[k, k], m[:, k] / m[k, k]
    out[k, k] = -1.0 / m[k, k]
    return out


def solve_subset(g: Gram, picked: list[int], ridge: float) -> tuple[np.ndarray, float]:
    """(coefficients of the intercept and the ``picked`` columns, squared error left) with ``ridge`` added to every column but the intercept."""
    p = len(g.xy)
    m = np.zeros((p + 1, p + 1))
    m[:p, :p] = g.xx + ridge * np.diag([0.0] + [1.0] * (p - 1))
    m[:p, p], m[p, :p], m[p, p] = g.xy, g.xy, g.yy
    chosen = [0, *picked]
    for k in chosen:
        if m[k, k] <= 1e-8 * max(g.xx[k, k], 1e-12):        # a column that the others make up, or that never varies
            continue
        m = sweep(m, k)
    swept = np.array([m[k, k] < 0 for k in chosen])
    return np.where(swept, m[chosen, p], 0.0), float(m[p, p])


def mean_filled(g: Gram, columns: list[str], gaps: list[str]) -> tuple[Gram, dict[str, float]]:
    """The moments with the gaps of ``gaps`` at the training mean of what is known, and those means. ``columns`` are the moments' columns after the intercept."""
    t, means = np.eye(len(g.xy)), {}
    for c in gaps:
        known, value = 1 + columns.index(KNOWN + c), 1 + columns.index(FILLED + c)
        means[c] = float(g.s1[value] / g.s1[known]) if g.s1[known] > 0 else 0.0
        t[value, 0], t[value, known] = means[c], -means[c]                     # known * value + (1 - known) * mean
    return Gram(g.n, g.w, t @ g.xx @ t.T, t @ g.xy, g.yy, g.s1, g.s2), means


@dataclass
class Variants:
    """Coefficients by (variant, ridge) and target period."""

    columns: dict[str, list[str]]
    gaps: list[str]
    rows: dict[int, int]
    means: dict[int, dict[str, float]]
    beta: dict[tuple[str, float], dict[int, np.ndarray]]
    left: dict[tuple[str, float], dict[int, float]]

    def predict(self, variant: str, ridge: float, period: Column) -> Column:
        """Of a row with the columns of ``with_gaps``; null at a period without a fit."""
        betas = self.beta[variant, ridge]
        out = by_period({t: float(b[0]) for t, b in betas.items()}, period)
        for i, c in enumerate(self.columns[variant], 1):
            x = F.col(c).cast("double")
            if c.startswith(FILLED):
                name = c.removeprefix(FILLED)
                x = x + (F.lit(1.0) - F.col(KNOWN + name)) * by_period({t: self.means[t][name] for t in betas}, period)
            out = out + by_period({t: float(b[i]) for t, b in betas.items()}, period) * x
        return out

    def table(self) -> list[tuple[str, float, int, int, str, float]]:
        """(variant, ridge, period, rows, term, coefficient)."""
        return [(v, r, t, self.rows[t], term, float(x)) for (v, r), betas in self.beta.items() for t, b in betas.items() for term, x in zip(["intercept", *self.columns[v]], b)]


def fit_variants(df: DataFrame, variants: dict[str, list[str]], y: str, w: str | None, period: str, targets: list[int], *, gaps: tuple[str, ...] = (), ridges: tuple[float, ...] = (1.0,), min_rows: int = 60) -> Variants:
    """All variants, ridges and target periods from one grouped pass over ``df``, which holds the columns of ``with_gaps`` for ``gaps``.

    A target with fewer than ``min_rows`` earlier rows has no fit. Rows with a null period, ``y`` or column, or without weight, are left out.
    """
    every = list(dict.fromkeys([c for cs in variants.values() for c in cs] + [prefix + g for g in gaps for prefix in (KNOWN, FILLED)]))
    grams = {int(k): g for k, g in gram(df.where(F.col(period).isNotNull()), every, y, w, by=period).items()}
    out = Variants(variants, list(gaps), {}, {}, {(v, r): {} for v in variants for r in ridges}, {(v, r): {} for v in variants for r in ridges})
    run: Gram | None = None
    waiting = sorted(grams)
    for t in sorted(targets):
        while waiting and waiting[0] < t:
            g = grams[waiting.pop(0)]
            run = g if run is None else run + g
        if run is None or run.n < min_rows:
            continue
        filled, out.means[t] = mean_filled(run, every, list(gaps))
        out.rows[t] = run.n
        for v, columns in variants.items():
            for r in ridges:
                out.beta[v, r][t], out.left[v, r][t] = solve_subset(filled, [1 + every.index(c) for c in columns], r)
    return out


def fit_from_history(df: DataFrame, xs: list[str], y: str, w: str | None, period: str, targets: list[int], *, signal: str, projected: str, listed: str, ridge: float = 1.0, blend_ridge: float = 1e-6, min_rows: int = 60) -> DataFrame:
    """``df`` with ``oof`` (the model's prediction of each row by the periods before it; null where ``projected`` is false or there is no fit),
    ``blend`` and ``blend_rows``.

    The blend of a period regresses ``y`` on ``signal``, the model's prediction (its mean where there is none) and whether it is missing, over
    the listed rows of earlier periods, whose predictions are out of fold themselves. So no row of a period or a later one has a part in its blend. Two passes in all: the model's moments, and the blend's moments over rows
    joined with what each period's model says.
    """
    model = fit_variants(df, {"model": xs}, y, w, period, targets, ridges=(ridge,), min_rows=min_rows)
    said = F.when(F.col(projected), model.predict("model", ridge, F.col(period)))
    scored = with_gaps(df.withColumn("oof", said), ["oof"])
    fitted = model.beta["model", ridge]
    terms = [signal, FILLED + "oof", KNOWN + "oof"]
    past = scored.where(F.col(listed) & F.col(period).isin([int(t) for t in fitted]))
    blend = fit_variants(past, {"blend": terms}, y, None, period, targets, gaps=("oof",), ridges=(blend_ridge,), min_rows=min_rows)
    mixed = F.when(F.col(listed), blend.predict("blend", blend_ridge, F.col(period)))
    rows = by_period({t: float(n) for t, n in blend.rows.items()}, F.col(period)).cast("long")
    return scored.withColumn("blend", F.greatest(F.coalesce(mixed, F.col("oof")), F.lit(0.0))).withColumn("blend_rows", rows).drop(KNOWN + "oof", FILLED + "oof")

"""Weighted scores and the small arithmetic rules used on a stat line."""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame, functions as F

# Scoring key -> box-score column.
STAT_COLUMNS = {"PTS": "pts", "REB": "reb", "AST": "ast", "STL": "stl", "BLK": "blk", "TO": "tov",
                "FGM": "fgm", "FGA": "fga", "FTM": "ftm", "FTA": "fta", "3PM": "fg3m"}


def weighted_score(df: DataFrame, weights: Mapping[str, float], *, prefix: str = "",
                   columns: Mapping[str, str] | None = None) -> Column:
    """Weighted sum over the columns the weights name; a weight without a column is an error."""
    names = {k: prefix + (columns or {}).get(k, k) for k in weights}
    missing = sorted(n for n in names.values() if n not in df.columns)
    if missing:
        raise KeyError(f"no column for weights: {missing}")
    return reduce(add, [F.col(names[k]).cast("double") * F.lit(float(w)) for k, w in weights.items()])


def score_parts(weights: Mapping[str, float], columns: Mapping[str, str] | None = None) -> Column:
    """Map of stat key to its contribution."""
    names = {k: (columns or {}).get(k, k) for k in weights}
    return F.map_from_arrays(F.array(*[F.lit(k) for k in weights]),
                             F.array(*[F.col(names[k]).cast("double") * F.lit(float(w)) for k, w in weights.items()]))


def safe_ratio(num: Column, den: Column) -> Column:
    return F.when(den != 0, num / den)


def usage_per_36(fga: Column, fta: Column, tov: Column, minutes: Column) -> Column:
    return F.when(minutes > 0, (fga + F.lit(0.44) * fta + tov) / minutes * 36.0)


def shrink(est: Column, prior: Column, n: Column, kappa: Column | float) -> Column:
    """Empirical-Bayes pull toward a prior: n = 0 gives the prior."""
    k = kappa if isinstance(kappa, Column) else F.lit(float(kappa))
    return prior + F.coalesce(F.try_divide(n, n + k), F.lit(0.0)) * (est - prior)


def posterior_mean(prior: Column, sample: Column, n: Column, pseudo: float) -> Column:
    """(k * prior + n * sample) / (k + n); without a sample the prior stands."""
    seen = F.when(n > 0, sample).otherwise(prior)
    return (F.lit(pseudo) * prior + n * seen) / (F.lit(pseudo) + n)


def clip(value: Column, low: float, high: float) -> Column:
    return F.when(value.isNotNull(), F.least(F.greatest(value, F.lit(float(low))), F.lit(float(high))))


def recency_weighted(lags: list[Column], decay: float) -> Column:
    """Decayed mean over the lags that are present (lag 1 first); null when none is."""
    num = reduce(add, [F.coalesce(x, F.lit(0.0)) * F.lit(decay ** i) for i, x in enumerate(lags)])
    den = reduce(add, [x.isNotNull().cast("double") * F.lit(decay ** i) for i, x in enumerate(lags)])
    return F.when(den > 0, num / den)


def youth_weight(age: Column, *, young: float = 20.0, old: float = 26.0) -> Column:
    """1 up to ``young``, falling linearly to 0 at ``old``."""
    return F.when(age.isNull(), F.lit(0.0)).otherwise(clip((F.lit(old) - age) / F.lit(old - young), 0.0, 1.0))


def playing_share(games: Column, season_games: float) -> Column:
    return clip(games / F.lit(season_games), 0.0, 1.0)

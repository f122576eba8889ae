import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyline.operators import fit, metrics, resample, trends, value
from tallyline.operators.ranking import asc, desc, with_row_number

SHAPE = value.LeagueShape(2, (("PG", 1), ("UTIL", 1)), 1)


def test_replacement_arithmetic(spark):
    assert value.bench_weight(SHAPE, 0.75) == 0.5
    assert value.replacement_rank(SHAPE, 0.5) == 5.0
    df = spark.createDataFrame([(i, float(10 - i)) for i in range(8)], "id long, v double")
    assert value.value_at_rank(df, "v", 2.5, tie="id").first()["level"] == pytest.approx(7.5)
    assert value.value_at_rank(df, "v", 99, tie="id").first()["level"] == 3.0


def test_tiers_match_a_plain_implementation(spark):
    rng = random.Random(2)
    vals = sorted((rng.gauss(0, 10) + (40 if i < 6 else 15 if i < 20 else 0) for i in range(120)), reverse=True)
    ranked = with_row_number(spark.createDataFrame([(i, v) for i, v in enumerate(vals)], "id long, vorp double"), [], [desc("vorp"), asc("id")], "rank")
    got = [r["tier"] for r in value.assign_tiers(ranked).orderBy("rank").collect()]
    top = [v for v in vals if v > 0]
    gaps = [a - b for a, b in zip(top, top[1:])]
    scale = [max(float(np.median(gaps[max(0, i - 15):i + 16])), 1e-9) for i in range(len(gaps))]
    cand = [(i + 1, g / s) for i, (g, s) in enumerate(zip(gaps, scale)) if g > 0 and g >= 2.5 * s and g >= 0.01 * (top[0] - top[-1])]
    bounds = []
    for i, _ in sorted(cand, key=lambda c: (-c[1], c[0])):
        if len(bounds) < 11 and all(b - a >= 3 for a, b in zip([0, *sorted(bounds + [i])], [*sorted(bounds + [i]), len(top)])):
            bounds.append(i)
    want = [1 + sum(i >= b for b in bounds) if i < len(top) else len(bounds) + 2 for i in range(len(vals))]
    assert got == want


def test_rank_metrics_against_numpy(spark):
    rng = np.random.default_rng(0)
    p, a = rng.integers(0, 20, 60).astype(float), rng.integers(0, 30, 60).astype(float)
    df = spark.createDataFrame([(1, i, float(x), float(y)) for i, (x, y) in enumerate(zip(p, a))], "g int, id long, p double, a double")
    ranks = lambda x: np.array([(np.sum(x < v) + 1 + np.sum(x <= v)) / 2 for v in x])        # noqa: E731
    assert metrics.spearman(df, ["g"], "p", "a").first()["spearman"] == pytest.approx(np.corrcoef(ranks(p), ranks(a))[0, 1])
    k = 10
    disc = np.where(np.arange(60) < k, 1 / np.log2(np.arange(60) + 2.0), 0)
    dcg, at = 0.0, 0
    for v in sorted(set(p), reverse=True):
        m = p == v
        dcg += a[m].sum() * disc[at:at + m.sum()].mean()
        at += m.sum()
    assert metrics.ndcg(df, ["g"], "p", "a", k).first()["ndcg"] == pytest.approx(dcg / (np.sort(a)[::-1] @ disc))
    label = (a > 15).astype(int)
    pos, neg = p[label == 1], p[label == 0]
    want = np.mean([(x > y) + 0.5 * (x == y) for x in pos for y in neg])
    lab = df.withColumn("y", (F.col("a") > 15).cast("int"))
    assert metrics.auc(lab, ["g"], "p", "y").first()["auc"] == pytest.approx(want)
    assert metrics.auc(lab, ["g"], "p", "y", rows_per_task=10).first()["auc"] == pytest.approx(want)


def test_oracle_scores_one_and_weighted_error(spark):
    df = spark.createDataFrame([("s", i, float(i), float(i)) for i in range(30)], "season string, player_id long, p double, a double")
    top = metrics.topk_table(df, ["season"], "p", "a", "player_id", [5]).first()
    assert (top["hit"], top["capture"]) == (1.0, 1.0)
    w = spark.createDataFrame([(10.0, 4.0), (1.0, 2.0)], "p double, a double").agg(metrics.weighted_error(F.col("p"), F.col("a"), F.lit(5.0))).first()[0]
    assert w == 6.0


def test_wls_and_gated_ridge_equal_refits(spark):
    rng = np.random.default_rng(4)
    n = 400
    x, s = rng.normal(size=(n, 2)), rng.integers(0, 4, n)
    w = rng.uniform(1, 50, n)
    y = 1.0 + x @ np.array([2.0, -1.0]) + rng.normal(0, 0.5, n)
    df = spark.createDataFrame([(int(c), float(a), float(b), float(v), float(u)) for c, (a, b), v, u in zip(s, x, y, w)], "s int, a double, b double, y double, w double")
    X = np.column_stack([np.ones(n), x])
    want = np.linalg.lstsq(X * np.sqrt(w)[:, None], y * np.sqrt(w), rcond=None)[0]
    assert fit.wls(df, ["a", "b"], "y", "w", ridge=0.0) == pytest.approx(want, rel=1e-6)

    def solve(A, b, ridge):
        pen = np.eye(3) * ridge * max(np.trace(A) / 3, 1e-12)
        pen[0, 0] = 0
        return np.linalg.solve(A + pen + 1e-12 * np.eye(3), b)

    losses = {}
    for ridge in (1.0, 10.0):
        tot = 0.0
        for g in range(4):
            tr, te = s != g, s == g
            mean, sd = x[tr].mean(0), x[tr].std(0)
            Z = np.column_stack([np.ones(tr.sum()), (x[tr] - mean) / sd])
            beta = solve((Z.T * w[tr]) @ Z, (Z.T * w[tr]) @ y[tr], ridge / tr.sum())
            pred = beta[0] + ((x[te] - mean) / sd) @ beta[1:]
            tot += np.sum(w[te] * (y[te] - pred) ** 2)
        losses[ridge] = tot / w.sum()
    got = fit.gated_ridge(df, ["a", "b"], "y", "w", "s", ridges=(1.0, 10.0), center=True, use_intercept=True, min_rows=50, weight_cap=1e9)
    assert got.enabled and got.diagnostics["cv_loss"] == pytest.approx(min(losses.values()), rel=1e-6)


def test_kappa_recovers_the_best_grid_point(spark):
    rng = np.random.default_rng(1)
    est, n, y = rng.normal(size=300), rng.uniform(1, 30, 300), rng.normal(size=300)
    y = 0.0 + n / (n + 9.0) * est
    df = spark.createDataFrame([(float(a), 0.0, float(b), float(c), 1.0) for a, b, c in zip(est, n, y)], "est double, prior double, n double, y double, w double")
    kappa, loss, fitted = fit.fit_kappa(df, "est", "prior", "n", "y", "w", default=1.0)
    assert fitted and kappa == pytest.approx(9.0, rel=0.02) and loss < 1e-4
    assert fit.fit_kappa(df.limit(5), "est", "prior", "n", "y", "w", default=77.0) == (77.0, float("inf"), False)


def test_age_curve_recovers_a_quadratic(spark):
    rows = [(a + k * 0.01, 0.5 - 0.1 * (a + k * 0.01 - 27), 1.0) for a in range(20, 38) for k in range(5)]
    c = fit.fit_age_curve(spark.createDataFrame(rows, "age double, delta double, weight double"))
    assert c.coefs == pytest.approx((0.5, -0.1, 0.0), abs=1e-6) and 20 <= c.lo < c.hi <= 38
    moved = spark.range(1).select(c.shift(F.lit(25.0), F.lit(27.0)), c.shift(F.lit(None).cast("double"), F.lit(27.0))).first()
    assert moved[0] == pytest.approx(0.5 * 2 + 0.1 * 2, abs=1e-6) and moved[1] == 0.0


def test_logit_separates_and_falls_back(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=500)
    y = (rng.uniform(size=500) < 1 / (1 + np.exp(-2 * x))).astype(float)
    df = spark.createDataFrame([(float(a), float(b)) for a, b in zip(x, y)], "x double, y double")
    m = fit.fit_logit(df, ["x"], "y", c=100.0)
    assert m.fitted and m.coefs[0] / m.scales[0] == pytest.approx(2.0, abs=0.4)
    assert not fit.fit_logit(df.limit(20), ["x"], "y").fitted


def test_bootstrap_is_repeatable_and_plausible(spark):
    rng = np.random.default_rng(0)
    df = spark.createDataFrame([(i % 3, i, float(v)) for i, v in enumerate(rng.normal(5, 2, 600))], "s int, id long, v double")
    a = resample.mean_interval(df, "v", ["id"], strata=["s"], n_boot=200).first()
    b = resample.mean_interval(df.repartition(7), "v", ["id"], strata=["s"], n_boot=200).first()
    assert a["lo"] == pytest.approx(b["lo"]) and a["lo"] < a["estimate"] < a["hi"]
    assert a["se"] == pytest.approx(2 / math.sqrt(600), rel=0.25)
    per = spark.createDataFrame([(i, float(i)) for i in range(6)], "season int, m double")
    p = resample.period_interval(per, "season", "m", n_boot=300).first()
    assert p["estimate"] == 2.5 and 0 <= p["lo"] < 2.5 < p["hi"] <= 5


def test_water_fill_equals_a_plain_loop(spark):
    rng = random.Random(0)
    rows, want = [], {}
    for case in range(20):
        freed = rng.uniform(5, 60)
        mates = [(rng.uniform(20, 38), rng.choice([1.0, 1.5])) for _ in range(rng.randrange(1, 7))]
        room = [max(36 - m, 0.0) for m, _ in mates]
        w = [r * b for r, (_, b) in zip(room, mates)]
        gain, left = [0.0] * len(mates), freed
        for _ in range(5):
            active = [r - g > 1e-9 for r, g in zip(room, gain)]
            total = sum(x for x, a in zip(w, active) if a)
            if left <= 1e-9 or total <= 0:
                break
            take = [min(x / total * left, r - g) if a else 0.0 for x, r, g, a in zip(w, room, gain, active)]
            gain = [g + t for g, t in zip(gain, take)]
            left -= sum(take)
        for i, g in enumerate(gain):
            want[(case, i)] = g
            rows.append((case, i, freed, room[i], w[i]))
    got = trends.allocate(spark.createDataFrame(rows, "c int, i int, f double, r double, w double"), ["c"], freed="f", room="r", weight="w").collect()
    assert all(r["gain"] == pytest.approx(want[(r["c"], r["i"])], abs=1e-9) for r in got)

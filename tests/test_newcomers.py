"""Logits of all targets against fits made one by one; shares of the run-up; blends that the future leaves alone."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyline.catalog import CATALOG
from tallyline.catalog.base import Tables
from tallyline.catalog.history_queries import APPEARANCE, BASE, appearance_rows, yearly_rates
from tallyline.operators import newcomers, variants

FOLDER = "/root/testdata/sf0.01"


def one_by_one(rows, target, ridge=1.0):
    """The ridge logit on the rows before ``target``, by Newton steps of its own."""
    train = [r for r in rows if r[0] < target]
    x, y = np.array([r[1] for r in train], float), np.array([r[2] for r in train], float)
    mean, sd = x.mean(axis=0), x.std(axis=0)
    sd = np.where(sd < 1e-9, 1.0, sd)
    z = np.column_stack([np.ones(len(x)), (x - mean) / sd])
    beta, pen = np.zeros(z.shape[1]), np.diag([0.0] + [ridge] * x.shape[1])
    for _ in range(60):
        p = 1 / (1 + np.exp(-z @ beta))
        beta = beta + np.linalg.solve((z.T * (p * (1 - p))) @ z + pen + 1e-9 * np.eye(len(beta)), z.T @ (y - p) - pen @ beta)
    return mean, sd, beta


def test_logits_of_all_targets(spark):
    rng = random.Random(4)
    rows = []
    for i in range(900):
        x = [rng.gauss(0, 1), rng.gauss(5, 3), float(rng.random() < 0.3)]
        rows.append((rng.randrange(1, 7), x, int(rng.random() < 1 / (1 + math.exp(-(0.5 * x[0] - 0.3 * (x[1] - 5) + x[2] - 0.5))))))
    df = spark.createDataFrame([(p, *x, y) for p, x, y in rows] + [(2, None, 1.0, 0.0, 1), (None, 1.0, 1.0, 0.0, 1)], "p int, a double, b double, c double, y int")
    fits = newcomers.fold_logits(df, ["a", "b", "c"], "y", "p", [1, 2, 3, 6, 9])
    assert sorted(fits.beta) == [2, 3, 6, 9] and fits.n[1] == 0 and fits.n[9] == 900
    for t in (2, 3, 6, 9):
        mean, sd, beta = one_by_one(rows, t)
        assert np.allclose(fits.mean[t], mean) and np.allclose(fits.scale[t], sd) and np.allclose(fits.beta[t], beta, atol=1e-7)
    said = df.where("p IN (1, 6)").select("p", "a", "b", "c", fits.probability(F.col("p"), low=0.05, high=0.9).alias("q")).collect()
    mean, sd, beta = one_by_one(rows, 6)
    for r in said:
        z = beta[0] + (np.array([r["a"], r["b"], r["c"]]) - mean) / sd @ beta[1:]
        assert abs(r["q"] - (1.0 if r["p"] == 1 else min(max(1 / (1 + math.exp(-z)), 0.05), 0.9))) < 1e-6 or r["a"] is None


def test_appearance_on_the_whole_table(spark):
    rows = appearance_rows(Tables(spark, FOLDER))
    plain = [(r["y"], [r[c] for c in APPEARANCE], r["appeared"]) for r in rows.collect()]
    got = CATALOG["appearance_probability"].run(spark, FOLDER).collect()
    assert len(got) == len(plain)
    fits = {t: one_by_one(plain, t) for t in {p[0] for p in plain} - {min(p[0] for p in plain)}}
    want = []
    for y, x, seen in plain:
        if y in fits:
            mean, sd, beta = fits[y]
            want.append((y, seen, round(min(max(1 / (1 + math.exp(-(beta[0] + (np.array(x, float) - mean) / sd @ beta[1:]))), 0.05), 0.995), 4)))
        else:
            want.append((y, seen, 1.0))
    close = sorted((r["y"], r["appeared"], r["p_appear"]) for r in got)
    assert all(a[:2] == b[:2] and abs(a[2] - b[2]) < 1e-3 for a, b in zip(close, sorted(want)))


def test_nothing_to_learn(spark):
    empty = spark.createDataFrame([], "p int, a double, y int")
    fits = newcomers.fold_logits(empty, ["a"], "y", "p", [1, 2])
    assert fits.beta == {} and fits.steps == 0
    logs = spark.createDataFrame([], "p int, e int, d date, g int, m double, k string")
    assert newcomers.evidence_at_shares(logs, [0.5], period="p", entity="e", day="d", game="g", minutes="m", context="k", cut="a", whole="b").count() == 0


def test_subsets_equal_least_squares():
    rng = np.random.default_rng(3)
    x = np.column_stack([np.ones(200), rng.normal(size=(200, 4))])
    y, w = rng.normal(size=200), rng.uniform(0.5, 2, 200)
    from tallyline.operators.fit import Gram
    g = Gram(200, w.sum(), (x.T * w) @ x, (x.T * w) @ y, float(w @ (y * y)), x.sum(axis=0), (x * x).sum(axis=0))
    for picked in ([], [2], [1, 3], [1, 2, 3, 4]):
        for ridge in (0.0, 5.0):
            cols = [0, *picked]
            a = (x[:, cols].T * w) @ x[:, cols] + ridge * np.diag([0.0] + [1.0] * len(picked))
            want = np.linalg.solve(a, (x[:, cols].T * w) @ y)
            beta, left = variants.solve_subset(g, picked, ridge)
            assert np.allclose(beta, want)
            if ridge == 0:
                assert abs(left - float(w @ (y - x[:, cols] @ want) ** 2)) < 1e-6
    twice = Gram(200, 1, np.pad(g.xx, (0, 1), "edge"), np.append(g.xy, g.xy[-1]), g.yy, np.append(g.s1, g.s1[-1]), np.append(g.s2, g.s2[-1]))
    assert variants.solve_subset(twice, [4, 5], 0.0)[0][2] == 0.0                  # a column that is there already


def test_future_rows_change_nothing(spark):
    rows = yearly_rates(Tables(spark, FOLDER)).withColumn("listed", F.col("e") % 5 != 0).withColumn("projected", F.col("e") % 7 != 3).withColumn("signal", F.col("log_slot") + F.col("e") % 13)
    years = sorted(x["y"] for x in rows.select("y").distinct().collect())

    def blends(df):
        out = variants.fit_from_history(df, BASE, "total", None, "y", years, signal="signal", projected="projected", listed="listed")
        return {(r["y"], r["e"]): (r["oof"], r["blend"], r["blend_rows"]) for r in out.collect()}

    whole, cut = blends(rows), blends(rows.where(F.col("y") <= years[4]))
    shaken = blends(rows.withColumn("total", F.when(F.col("y") > years[4], 1e6).otherwise(F.col("total"))))
    same = [k for k in whole if k[0] <= years[4]]
    assert same and all(cut[k] == pytest.approx(whole[k], nan_ok=True) for k in same if None not in whole[k])
    upto = [k for k in whole if k[0] <= years[5] and None not in whole[k]]
    assert upto and all(shaken[k][0] == pytest.approx(whole[k][0]) and shaken[k][1] == pytest.approx(whole[k][1]) for k in upto)
    assert any(v[2] for v in whole.values())

"""The grid of shrinkage constants and the lags, against the plain forms that copy a row for each constant and lag."""

from tallyline.operators import fit, panel


def _plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_grid_losses_are_the_plain_ones(spark):
    df = spark.range(3000).selectExpr("if(id % 5 = 0, null, id % 5) q", "id % 11 / 7D est", "if(id % 13 = 0, null, 0.4D) prior", "cast(id % 50 as double) n", "id % 17 / 9D y", "cast(id % 3 as double) w")
    grid = fit.log_grid(0.1, 100.0, 12)
    plain = {(r["q"], r["kappa"]): r for r in fit.kappa_losses(df, "est", "prior", "n", "y", "w", grid, by=["q"]).collect()}
    rows = fit.grid_losses(df, "est", "prior", "n", "y", "w", grid, by=["q"]).collect()
    assert {(r["q"], r["kappa"]) for r in rows} == set(plain) and len(rows) == len(plain) == 60
    for r in rows:
        want = plain[r["q"], r["kappa"]]
        assert r["rows"] == want["rows"] and abs(r["loss"] - want["loss"]) < 1e-12
    own = fit.grid_losses(df.where("q < 3"), "est", "prior", "n", "y", "w", {1: [2.0, 3.0], 2: [5.0]}, by=["q"]).collect()
    assert {(r["q"], r["kappa"]) for r in own} == {(1, 2.0), (1, 3.0), (2, 5.0)}
    assert fit.grid_losses(df.limit(0), "est", "prior", "n", "y", "w", grid, by=["q"]).collect() == []


def test_grid_losses_copy_no_rows(spark):
    """Rows that reach the sums are the table's, whatever the number of constants."""
    df = spark.range(1000).selectExpr("1 q", "0.1D est", "0.4D prior", "2D n", "0.5D y", "1D w")
    plan = _plan(fit.grid_losses(df, "est", "prior", "n", "y", "w", fit.log_grid(0.1, 100.0, 80), by=["q"]))
    below = plan[plan.index("MapInArrow"):]
    assert "Generate" not in below and "explode" not in below


def test_lags_copy_no_rows_and_keep_their_rules(spark):
    p = spark.createDataFrame([(1, 1990, 1.0, True), (1, 1991, None, False), (1, 1993, 3.0, None), (1, 1993, 2.0, False), (None, 1990, 3.0, True), (2, None, 4.0, True), (2, 1990, 5.0, True)], "p int, s int, a double, b boolean")
    rows = spark.createDataFrame([(9, 1, 1994), (8, 1, 1994), (7, 1, 1991), (6, None, 1991), (5, 2, 1991), (4, 2, None), (3, 3, 1991)], "x int, p int, s bigint")
    out = panel.attach_lags(rows, p, entity="p", period="s", n_lags=2, columns=["a", "b"])
    assert out.columns == ["p", "s", "x", "a_lag1", "a_lag2", "b_lag1", "b_lag2"]
    got = {r["x"]: tuple(r)[3:] for r in out.collect()}
    none = (None,) * 4
    assert got == {9: (3.0, None, False, None), 8: (3.0, None, False, None), 7: (1.0, None, True, None), 6: none, 5: (5.0, None, True, None), 4: none, 3: none}
    assert "Generate" not in _plan(out)

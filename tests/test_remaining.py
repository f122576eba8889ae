"""The rest of a period: no later event has a part in it, unknown groups, cutoffs that some group never reaches, ties and split ranking."""

import pytest
from pyspark.sql import functions as F

from tallyline.operators import remaining as R

EVENTS = "y int, e int, g int, d date, k int, m double, v double"


def events(spark, rows):
    return spark.createDataFrame(rows, "y int, e int, g int, s string, k int, m double, v double").withColumn("d", F.to_date("s")).drop("s")


ROWS = [(1, e, e % 2, f"2001-01-{1 + 3 * i + e % 2:02d}", 10 * e + i, 20.0, float(e + i)) for e in range(4) for i in range(6)]
SETTINGS = R.grid_settings((20.0,), (2.0,), (5.0,), (3.0,))


def rest(spark, rows, cutoffs=(2, 4), **kw):
    ev = events(spark, rows)
    cuts = R.cutoff_days(ev, list(cutoffs), period="y", group="g", day="d")
    prior = spark.createDataFrame([(1, 0, 30.0, 2.0, 6.0), (1, 9, 10.0, 1.0, 3.0), (1, 8, 0.0, 1.0, 3.0)], "y int, e int, prior_minutes double, prior_rate double, prior_games double")
    placed = spark.createDataFrame([(1, 9, 1)], "y int, e int, g int")
    seen = R.before_and_after(ev, cuts, period="y", entity="e", group="g", day="d", event="k", minutes="m", value="v")
    df = R.with_priors(seen, prior, placed, R.group_progress(ev, cuts, period="y", group="g", day="d"), period="y", entity="e", group="g", length=6.0)
    return R.remaining(R.in_universe(df, period="y", entity="e", length=6.0, top=2, min_games=2, **kw), SETTINGS)


def test_formulas(spark):
    got = {(r["cutoff"], r["e"], r["setting"]): r for r in rest(spark, ROWS).collect()}
    assert len(got) == 2 * 6 * len(SETTINGS)
    one = got[2, 0, "blend m20 g2 s5"]
    assert (one["gp"], one["minutes"], one["fp"], one["played"], one["left"], one["after_games"]) == (2, 40.0, 1.0, 2, 4, 4)
    per_minute, minutes, share = (20 * 2 / 30 + 1.0) / 60, (2 * 30 + 2 * 20) / 4, (5 * 1 + 2 * 1) / 7
    assert one["rest_total"] == pytest.approx(per_minute * minutes * share * 4)
    assert got[2, 0, "direct r3"]["rest_rate"] == pytest.approx((3 * 2 + 2 * 0.5) / 5)
    assert got[2, 0, "prior only"]["rest_total"] == pytest.approx(2.0 * 1.0 * 4) and got[2, 1, "sample only"]["rest_total"] == pytest.approx(1.0 * 1 * 5)
    assert got[2, 1, "prior only"]["rest_rate"] == pytest.approx(0.45 * 12) and not got[2, 1, "prior only"]["has_prior"]
    yet = got[2, 9, "blend m20 g2 s5"]                                          # placed, not yet seen
    assert yet["g"] == 1 and yet["rest_rate"] == pytest.approx(1.0) and yet["played"] == 1
    nowhere = got[2, 8, "blend m20 g2 s5"]                                      # in no group: the most played, the usual left; no minutes in its prior
    assert nowhere["g"] is None and (nowhere["played"], nowhere["left"]) == (2, 4.5) and nowhere["p_per_minute"] == 0.45
    assert {k[1] for k, r in got.items() if r["scored"] and k[0] == 2} == {0, 2, 8}             # the first two priors (ties to the smaller id), and two events


def test_later_events_change_nothing_but_the_outcome(spark):
    late = [(*r[:6], 99.0) if r[3] > "2001-01-08" else r for r in ROWS]
    keep = lambda rows: sorted((r["e"], r["setting"], r["rest_total"]) for r in rest(spark, rows, cutoffs=(2,)).collect())     # noqa: E731
    assert keep(late) == keep(ROWS)


def test_unreached_cutoffs_and_nothing(spark):
    assert rest(spark, ROWS, cutoffs=(6, 7)).count() == 0                        # the last day leaves nothing over
    assert rest(spark, []).count() == 0


@pytest.mark.parametrize("kw", [{}, {"rows_per_task": 3}])
def test_scores_and_choice(spark, kw):
    rows = spark.createDataFrame([(y, 2, s, e, True, float(e * f), 1.0, float(e), 12.0) for y in (1, 2, 3) for s, f in (("a", 1 if y < 2 else 3), ("b", 2)) for e in range(1, 9)],
                                 "y int, cutoff int, setting string, e int, scored boolean, rest_total double, rest_rate double, after_total double, after_games double")
    got = R.score_settings(rows, period="y", entity="e", top=3, **kw)
    by = {(r["y"], r["setting"]): r for r in got.collect()}
    assert by[1, "a"]["mae_total"] == 0 and by[1, "b"]["mae_total"] == 4.5 and by[1, "b"]["spearman"] == pytest.approx(1.0) and by[1, "b"]["top_share"] == 1.0 and by[1, "a"]["n"] == 8
    mine = R.chosen_settings(got, ["a", "b"], period="y")
    assert {r["y"]: r["setting"] for r in mine.collect()} == {2: "a", 3: "a"}
    told = R.paired_settings(got, mine, "b", period="y", metric="mae_total").first()
    assert (told["periods"], told["won"], told["mean_gain"]) == (2, 0, -4.5)
    assert R.with_value(rows.where("setting = 'b' AND y = 1"), period="y", entity="e", pool=3, **kw).where("place = 1").first()["value"] == 4.0


@pytest.mark.parametrize("kw", [{}, {"rows_per_task": 3}])
def test_equal_totals_have_no_correlation(spark, kw):
    rows = spark.createDataFrame([(1, 2, s, e, True, x, 1.0, float(e), 2.0) for s, v in (("flat", [0.0] * 5), ("up", [1.0, 2.0, 3.0, 4.0, 5.0])) for e, x in enumerate(v)],
                                 "y int, cutoff int, setting string, e int, scored boolean, rest_total double, rest_rate double, after_total double, after_games double")
    by = {r["setting"]: r for r in R.score_settings(rows, period="y", entity="e", top=3, min_after=1, **kw).collect()}
    assert by["flat"]["spearman"] is None and by["flat"]["n"] == 5 and by["flat"]["mae_total"] == 2.0
    assert by["up"]["spearman"] == pytest.approx(1.0)

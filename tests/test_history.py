"""States at every period against the fold made anew for each."""

import random

import pytest

from tallyline.operators.folds import deal_state, state_intervals, states


@pytest.mark.parametrize("kw", [{}, {"rows_per_task": 40}])
def test_states_equal_the_fold_at_each_period(spark, kw):
    rng = random.Random(11)
    rows = []
    for e in range(25):
        known = 0
        for i in range(rng.randrange(0, 30 if e else 250)):
            known += rng.choice([0, 0, 1, 2])
            rows.append((e, i, rng.choice(["deal", "extension", "extension", "end", "resume", "other"]), rng.randrange(20), rng.choice([None, 1, 2, 3, 4]), known))
    df = spark.createDataFrame(rows + [(None, 1, "deal", 1, 1, 1)], "e int, i int, kind string, start int, length int, known int")
    universe = spark.createDataFrame([(e, 0, 12) for e in range(27)], "e int, first int, last int")
    made = states(state_intervals(df, "e", order=["i"], kind="kind", start="start", length="length", known="known", **kw), universe, "e", "at").collect()
    got = {(r["at"], r["e"]): tuple(r)[2:] for r in made}
    assert len(made) == len(got) == 13 * 27
    for at in (0, 3, 7, 12):
        want = {r["e"]: tuple(r)[1:] for r in deal_state(df.where(f"known <= {at} AND e IS NOT NULL"), "e", order=["i"], kind="kind", start="start", length="length", at=at).collect()}
        for e in range(27):
            mine = got[at, e]
            assert mine == want.get(e, ("unknown", None, None, False, False, False)), (at, e)


def test_states_of_nothing(spark):
    df = spark.createDataFrame([], "e int, i int, kind string, start int, length int, known int")
    universe = spark.createDataFrame([(1, 2, 3)], "e int, first int, last int")
    made = states(state_intervals(df, "e", order=["i"], kind="kind", start="start", length="length", known="known"), universe, "e", "at").collect()
    assert sorted((r["at"], r["status"]) for r in made) == [(2, "unknown"), (3, "unknown")]

"""Split ranking must give what one plain window gives, whatever group is oversized."""

import pytest
from pyspark.sql import functions as F

from tallyline.operators import ranking as R


@pytest.fixture(scope="module")
def rows(spark):
    # one group holds most rows and one value a third of them
    return spark.range(3000).select(F.when(F.col("id") % 10 < 7, 0).otherwise(F.col("id") % 3).alias("g"), F.when(F.col("id") % 3 == 0, 7.0).otherwise((F.col("id") * 37 % 101).cast("double")).alias("v"), "id").persist()


def pd_sorted(df):
    return df.toPandas().sort_values("id").reset_index(drop=True)


@pytest.mark.parametrize("group", [["g"], []])
def test_row_number(rows, group):
    hot, plain = (pd_sorted(R.with_row_number(rows, group, [R.desc("v"), R.asc("id")], **kw)) for kw in ({"rows_per_task": 100}, {}))
    assert (hot["rank"] == plain["rank"]).all()


@pytest.mark.parametrize("group", [["g"], []])
@pytest.mark.parametrize("method", ["average", "min", "dense"])
def test_tied_rank(rows, group, method):
    hot, plain = (pd_sorted(R.with_tied_rank(rows, group, R.desc("v"), method=method, **kw)) for kw in ({"rows_per_task": 100}, {}))
    assert (hot["rank"] == plain["rank"]).all()


def test_running_sum_and_quantiles(rows):
    hot, plain = (pd_sorted(R.with_running_sum(rows, ["g"], [R.asc("v"), R.asc("id")], F.col("v"), "c", **kw)) for kw in ({"rows_per_task": 100}, {}))
    assert (abs(hot["c"] - plain["c"]) < 1e-6).all()
    probs = {"a": 0.1, "b": 0.5, "c": 0.97}
    for group in (["g"], []):
        a, b = (R.exact_quantiles(rows, group, "v", probs, **kw).toPandas().sort_values(list(probs)).reset_index(drop=True) for kw in ({"rows_per_task": 100}, {}))
        assert (abs(a[list(probs)] - b[list(probs)]) < 1e-9).all().all()


def test_nulls_rank_last_and_stay_null(spark):
    df = spark.createDataFrame([(1, None), (2, 5.0), (3, 5.0), (4, 1.0)], "id long, v double")
    got = {r["id"]: r["rank"] for r in R.with_tied_rank(df, [], R.desc("v")).collect()}
    assert got == {1: None, 2: 1.5, 3: 1.5, 4: 3.0}


def test_top_k_keeps_ties_deterministic(spark):
    df = spark.createDataFrame([(i, 1.0) for i in range(20)], "id long, v double").repartition(5)
    assert sorted(r["id"] for r in R.top_k(df, [], [R.desc("v"), R.asc("id")], 3).collect()) == [0, 1, 2]


def test_exploded_rows_are_probed(spark, monkeypatch):
    few = spark.range(2).select("id", F.col("id").cast("double").alias("v"))
    many = few.select("id", F.explode(F.sequence(F.lit(1), F.lit(500))).alias("v"))
    assert R.surely_small(few) and not R.surely_small(many)
    monkeypatch.setattr(R, "ROWS_PER_TASK", 100)
    assert R.slice_groups(many, ["id"], [R.asc("v")], 100)[1] and not R.slice_groups(few, ["id"], [R.asc("v")], 100)[1]


def test_ranges_follow_the_size_of_the_group(spark):
    df = spark.range(20_000).select(F.when(F.col("id") < 400, 1).otherwise(0).alias("g"), F.col("id").alias("v"))
    sliced, names = R.slice_groups(df, ["g"], [R.asc("v")], 100)
    sizes = sliced.groupBy("g", *names).count().groupBy("g").agg(F.count("*").alias("k"), F.max("count").alias("n")).collect()
    got = {r["g"]: (r["k"], r["n"]) for r in sizes}
    assert got[0][0] > 300 and got[1][0] <= 8 and max(n for _, n in got.values()) <= 100

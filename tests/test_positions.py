"""Stored calibrations, lists with flags, rebuilds after changes, consumers' positions and repeated entries."""

import os

import numpy as np
from pyspark.sql import functions as F

from tallyline.operators import watchlist
from tallyline.operators.ranking import asc, desc
from tallyline.sources import rebuild
from tallyline.streaming import consumer


def test_calibration_versions(spark, tmp_path):
    rng = np.random.default_rng(2)
    score, new = rng.normal(size=600), rng.random(600) < 0.4
    hit = rng.random(600) < 1 / (1 + np.exp(-(score - 0.5 + 0.8 * new)))
    df = spark.createDataFrame([(int(i % 3), float(s), int(n), int(h), 0) for i, (s, n, h) in enumerate(zip(score, new, hit))], "p int, score double, is_new int, hit int, never int")
    xs, path = ["score", "is_new"], str(tmp_path / "calibration")
    assert watchlist.load_calibration(spark, path, model="m", shape="s") is None
    fitted = watchlist.fit_calibration(df, xs, ["hit", "never"], "p", [0, 1, 3])
    assert {(r["outcome"], r["period"]) for r in fitted.collect()} == {("hit", 1), ("hit", 3)}            # one kind of outcome, or no rows, is no calibration
    x = np.column_stack([np.ones(600), score, new])
    beta, scale = np.zeros(3), x[:, 1:].std(axis=0)
    pen = np.diag([0.0, *(1e-3 * scale ** 2)])
    for _ in range(50):
        p = 1 / (1 + np.exp(-x @ beta))
        beta = beta + np.linalg.solve((x.T * (p * (1 - p))) @ x + pen, x.T @ (hit - p) - pen @ beta)
    got = {r["term"]: r["value"] for r in fitted.where("period = 3").collect()}
    assert np.allclose([got["intercept"], got["score"], got["is_new"]], beta, atol=1e-5)
    shape = watchlist.shape_of(xs, ["hit", "never"])
    assert [watchlist.save_calibration(fitted, path, model="m", shape=shape) for _ in range(2)] == [1, 2]
    assert watchlist.load_calibration(spark, path, model="m", shape=shape).count() == fitted.count()
    assert watchlist.load_calibration(spark, path, model="other", shape=shape) is None
    watchlist.save_calibration(fitted, path, model="m", shape="older")
    assert watchlist.load_calibration(spark, path, model="m", shape=shape) is None                       # the newest has another shape: absent
    said = watchlist.with_chances(df.withColumn("p", F.lit(3)), fitted, xs, ["hit", "never"], "p").first()
    assert abs(said["hit_chance"] - 1 / (1 + np.exp(-(beta @ [1, said["score"], said["is_new"]])))) < 1e-5 and said["never_chance"] is None
    assert watchlist.with_chances(df, None, xs, ["hit"], "p").where("hit_chance IS NOT NULL").count() == 0


def test_list_places_with_ties(spark):
    rows = [(i, float(i % 4), i % 3 == 0, None if i % 5 == 0 else bool(i % 2)) for i in range(60)]
    df = spark.createDataFrame(rows, "e int, v double, a boolean, b boolean")
    for kw in ({}, {"rows_per_task": 10}):
        full = watchlist.ranked_watchlist(df, [], {"up": [desc("v"), asc("e")], "id": [asc("e")]}, {"a": F.col("a"), "b": F.col("b")}, **kw).collect()
        for flag, k in (("a", 2), ("b", 3)):
            want = {r[0]: i + 1 for i, r in enumerate(sorted((r for r in rows if r[k]), key=lambda r: (-r[1], r[0])))}
            assert {r["e"]: r[f"up_{flag}"] for r in full if r[f"up_{flag}"]} == want
            assert sorted(r["e"] for r in full if r[f"id_{flag}"]) == sorted(want)
    assert watchlist.select_watchlist(watchlist.ranked_watchlist(df, [], {"up": [desc("v"), asc("e")]}, {"a": F.col("a")}), "up", "a", 3).count() == 3


def test_rebuild_equals_a_full_one(spark, tmp_path):
    source, table = tmp_path / "in", str(tmp_path / "out")
    rows = lambda unit, n, k=0: spark.createDataFrame([(unit, i + k) for i in range(n)], "u string, i int").coalesce(1).write.mode("overwrite").parquet(str(source / unit))     # noqa: E731
    read = rebuild.read_parquet_units("u string, i int")
    rows("a", 3), rows("b", 4), rows("c", 0)
    assert rebuild.read_rebuilt(spark, table) is None
    first = rebuild.rebuild_table(spark, str(source), table, read)
    assert (first.units, first.read, first.gone, first.version) == (3, 3, 0, 1)
    same = rebuild.rebuild_table(spark, str(source), table, read)
    assert (same.hashed, same.read, same.version) == (0, 0, 1)
    for name in os.listdir(source / "a"):                                        # touched, but not changed: hashed, not read
        os.utime(source / "a" / name, (1, 1))
    assert (lambda d: (d.hashed, d.read))(rebuild.rebuild_table(spark, str(source), table, read)) == (1, 0)
    rows("b", 2, 10), rows("d", 1)
    (source / "a").rename(tmp_path / "away")
    third = rebuild.rebuild_table(spark, str(source), table, read)
    assert (third.read, third.gone) == (2, 1)
    got = sorted(tuple(r) for r in rebuild.read_rebuilt(spark, table).collect())
    assert got == [("b", 10), ("b", 11), ("d", 0)]
    rebuild.rebuild_table(spark, str(source), str(tmp_path / "anew"), read)
    assert got == sorted(tuple(r) for r in rebuild.read_rebuilt(spark, str(tmp_path / "anew")).collect())
    assert rebuild.rebuild_table(spark, str(source), table, read, full=True).read == 3
    assert got == sorted(tuple(r) for r in rebuild.read_rebuilt(spark, table).collect())


def test_positions(spark, tmp_path):
    rows = spark.createDataFrame([(1, "2024-01-01 00:00:00"), (2, "2024-01-05 00:00:00"), (3, "2024-01-09 00:00:00")], "k int, s string").select("k", F.to_timestamp("s").alias("first_seen"))
    who = spark.createDataFrame([("x",), ("y",), ("x",)], "consumer string")
    assert sorted((r["consumer"], r["k"]) for r in consumer.unseen(rows, None, who, days=5).collect()) == [("x", 2), ("x", 3), ("y", 2), ("y", 3)]
    acks = spark.createDataFrame([("x", "2024-01-05 00:00:00")], "consumer string, s string").select("consumer", F.to_timestamp("s").alias("acked"))
    assert sorted((r["consumer"], r["k"]) for r in consumer.unseen(rows, acks, who, days=0).collect()) == [("x", 3), ("y", 3)]
    assert consumer.unseen(rows.limit(0), acks, who).count() == 0 and consumer.unseen(rows, acks, who.limit(0)).count() == 0
    merge = consumer.latest(["consumer"], "acked")
    late = spark.createDataFrame([("x", "2024-01-02 00:00:00"), ("z", None)], "consumer string, s string").select("consumer", F.to_timestamp("s").alias("acked"))
    assert merge(merge(None, acks), late).collect() == acks.collect()


def test_entries_once(spark, tmp_path):
    ids = spark.createDataFrame([("ann", 1), ("bob", 2), ("bob", 2)], "key string, id int")
    owners = spark.createDataFrame([("o", 7)], "owner string, owner_id int")
    lists, out, position = (str(tmp_path / x) for x in ("lists", "rows", "position"))
    for part in ([(1, "ann", "o"), (2, "cy", "o"), (None, "ann", "o")], [(1, "ann", "o"), (2, "cy", "o"), (3, "bob", None), (3, "bob", None)], []):
        spark.createDataFrame(part, "entry int, name string, owner string").write.mode("append").parquet(lists)
        stream = spark.readStream.schema("entry int, name string, owner string").parquet(lists)
        consumer.start_detected_entries(stream, ids, owners, out, position, entry="entry", name="name", owner="owner").awaitTermination()
    got = sorted((r["entry"], r["id"], r["owner_id"], r["is_resolved"]) for r in spark.read.parquet(out).collect())
    assert got == [(1, 1, 7, True), (2, None, 7, False), (3, 2, None, False)]

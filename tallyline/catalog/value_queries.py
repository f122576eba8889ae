"""Ranks, levels, tiers, metrics, fits and resampling."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyline.catalog.base import Tables, query, r
from tallyline.catalog.panel_queries import order_panel
from tallyline.operators import diffs, fit, metrics, panel, ranking, resample, studies, value
from tallyline.operators.ranking import asc, desc

SHAPE = value.LeagueShape(10, (("PG", 1), ("SG", 1), ("SF", 1), ("PF", 1), ("C", 1), ("G", 1), ("F", 1), ("UTIL", 3)), 3)
EVAL_SQL = """WITH p AS (SELECT o_custkey c, year(o_orderdate) y, count(*) gp, sum(o_totalprice) fp, avg(o_totalprice) m FROM orders GROUP BY 1, 2),
e AS (SELECT coalesce(a.c, b.c) c, coalesce(a.y + 1, b.y) y, a.fp AS pred, coalesce(b.fp, 0.0) AS act, a.c IS NOT NULL AS projected, b.c IS NOT NULL AS played, a.gp AS pgp, coalesce(b.gp, 0) AS agp, a.m AS pm, b.m AS am
      FROM p a FULL JOIN p b ON a.c = b.c AND b.y = a.y + 1)"""


def projections_and_outcomes(t: Tables):
    """Each customer's year projected by the year before."""
    p = order_panel(t)
    proj = p.select(F.col("cust").alias("player_id"), (F.col("y") + 1).alias("season"), F.col("gp").alias("proj_gp"), F.col("fppg").alias("proj_fppg"), F.col("fp_sum").alias("proj_total_fp"))
    act = p.select(F.col("cust").alias("player_id"), F.col("y").alias("season"), F.col("gp").alias("actual_gp"), F.col("fppg").alias("actual_fppg"), F.col("fp_sum").alias("actual_total_fp"))
    return metrics.eval_frame(proj, act)


@query("vorp_rank", "2.6.1, 2.6.5-9, 2.5.13, 2.4.19", """
WITH p AS (SELECT o_custkey AS cust, count(*) AS gp, sum(round(o_totalprice, 2)) AS total FROM orders GROUP BY 1),
k AS (SELECT *, row_number() OVER (ORDER BY total DESC, cust) AS rk FROM p),
av AS (SELECT least(1, greatest(0, 10 * (1 - avg(gp) / 30.0) / 3)) AS w FROM k WHERE rk <= 100),
rr AS (SELECT 10 * (10 + w * 3) AS r FROM av),
lv AS (SELECT max(CASE WHEN rk = floor(r) + 1 THEN total END) * (1 - (any_value(r) - floor(any_value(r)))) + max(CASE WHEN rk = floor(r) + 2 THEN total END) * (any_value(r) - floor(any_value(r))) AS lvl FROM k, rr)
SELECT rk AS rank, cust AS player_id, gp AS proj_gp, round(total, 2) AS proj_total_fp, round(total - lvl, 4) AS vorp FROM k, lv
""")
def vorp_rank(t: Tables):
    p = t.order_events.groupBy(F.col("cust").alias("player_id")).agg(F.count(F.lit(1)).alias("proj_gp"), F.sum(F.round("price", 2)).alias("proj_total_fp"))
    p = p.withColumn("proj_fppg", F.col("proj_total_fp") / F.col("proj_gp"))
    out = value.compute_vorp(p, SHAPE, season_games=30.0)
    out = ranking.with_row_number(out, [], [desc("vorp"), desc("proj_total_fp"), asc("player_id")], "rank")
    return out.select("rank", "player_id", "proj_gp", r("proj_total_fp", 2).alias("proj_total_fp"), r("vorp", 4).alias("vorp"))


@query("gap_tiers", "2.5.12, 2.6.1")
def gap_tiers(t: Tables):
    p = t.order_events.groupBy(F.col("cust").alias("player_id")).agg(F.sum(F.round("price", 2)).alias("vorp"))
    ranked = ranking.with_row_number(p, [], [desc("vorp"), asc("player_id")], "rank")
    return value.assign_tiers(ranked, floor_value=None).groupBy("tier").agg(F.count(F.lit(1)).alias("n"), r(F.max("vorp"), 2).alias("highest"))


@query("tier_gaps", "2.5.12", """
WITH p AS (SELECT o_custkey c, sum(round(o_totalprice, 2)) v FROM orders GROUP BY 1), k AS (SELECT row_number() OVER (ORDER BY v DESC, c) AS rank, v FROM p),
g AS (SELECT rank, v - lead(v) OVER (ORDER BY rank) AS gap FROM k)
SELECT rank, round(gap, 2) AS gap, round(greatest(quantile_cont(gap, 0.5) OVER (ORDER BY rank ROWS BETWEEN 15 PRECEDING AND 15 FOLLOWING), 1e-9) + 1e-7, 3) AS scale FROM g WHERE gap IS NOT NULL
""")
def tier_gaps(t: Tables):
    p = t.order_events.groupBy(F.col("cust").alias("c")).agg(F.sum(F.round("price", 2)).alias("v"))
    ranked = ranking.with_row_number(p, [], [desc("v"), asc("c")], "rank")
    return value.gap_table(ranked, rank="rank", value="v", chunk=500).select("rank", r("gap", 2).alias("gap"), r(F.col("scale") + 1e-7, 3).alias("scale"))


@query("capacity_rounds", "2.6.10-12, 2.9.14", """
WITH c AS (SELECT c_custkey i, c_acctbal v, ['PG,SG', 'SF,PF', 'C', 'SG,SF', 'PF,C'][CAST(c_nationkey % 5 + 1 AS INTEGER)] AS e FROM customer),
pg AS (SELECT i, 'PG' s FROM c WHERE contains(e, 'PG') ORDER BY v DESC, i LIMIT 10),
sg AS (SELECT i, 'SG' s FROM c WHERE contains(e, 'SG') AND i NOT IN (SELECT i FROM pg) ORDER BY v DESC, i LIMIT 10), a2 AS (SELECT * FROM pg UNION ALL SELECT * FROM sg),
sf AS (SELECT i, 'SF' s FROM c WHERE contains(e, 'SF') AND i NOT IN (SELECT i FROM a2) ORDER BY v DESC, i LIMIT 10), a3 AS (SELECT * FROM a2 UNION ALL SELECT * FROM sf),
pf AS (SELECT i, 'PF' s FROM c WHERE contains(e, 'PF') AND i NOT IN (SELECT i FROM a3) ORDER BY v DESC, i LIMIT 10), a4 AS (SELECT * FROM a3 UNION ALL SELECT * FROM pf),
ce AS (SELECT i, 'C' s FROM c WHERE contains(e, 'C') AND i NOT IN (SELECT i FROM a4) ORDER BY v DESC, i LIMIT 10), a5 AS (SELECT * FROM a4 UNION ALL SELECT * FROM ce),
g AS (SELECT i, 'G' s FROM c WHERE (contains(e, 'PG') OR contains(e, 'SG')) AND i NOT IN (SELECT i FROM a5) ORDER BY v DESC, i LIMIT 10), a6 AS (SELECT * FROM a5 UNION ALL SELECT * FROM g),
f AS (SELECT i, 'F' s FROM c WHERE (contains(e, 'SF') OR contains(e, 'PF')) AND i NOT IN (SELECT i FROM a6) ORDER BY v DESC, i LIMIT 10), a7 AS (SELECT * FROM a6 UNION ALL SELECT * FROM f),
u AS (SELECT i, 'UTIL' s FROM c WHERE i NOT IN (SELECT i FROM a7) ORDER BY v DESC, i LIMIT 30), a8 AS (SELECT * FROM a7 UNION ALL SELECT * FROM u),
b AS (SELECT i, 'BENCH' s FROM c WHERE i NOT IN (SELECT i FROM a8) ORDER BY v DESC, i LIMIT 20)
SELECT i AS id, s AS slot FROM a8 UNION ALL SELECT * FROM b
""")
def capacity_rounds(t: Tables):
    kinds = F.array(*[F.array(*[F.lit(x) for x in k]) for k in (("PG", "SG"), ("SF", "PF"), ("C",), ("SG", "SF"), ("PF", "C"))])
    c = t.customer.select(F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("v"), F.element_at(kinds, (F.col("c_nationkey") % 5 + 1).cast("int")).alias("elig"))
    return value.capacity_rounds(c, entity="id", value="v", eligible="elig", shape=SHAPE, n_bench=20)


@query("lineups_by_group", "2.6.19, 2.9.11-14", """
WITH c AS (SELECT c_custkey i, c_nationkey g, c_acctbal v, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_custkey) rk FROM customer),
s AS (SELECT * FROM c WHERE rk <= 13)
SELECT g AS grp, round(sum(CASE WHEN rk <= 10 THEN v ELSE 0.5 * v END), 3) AS lineup_value, count(*) AS n FROM s GROUP BY 1
""")
def lineups_by_group(t: Tables):
    from tallyline.operators.inseason import fit_to_capacity
    c = t.customer.select(F.col("c_custkey").alias("id"), F.col("c_nationkey").alias("grp"), F.col("c_acctbal").alias("v"), F.array(F.lit("PG")).alias("elig"))
    kept, _ = fit_to_capacity(c, ["grp"], entity="id", value="v", capacity=13, filler_value=0.0)
    out = value.group_value(kept, ["grp"], entity="id", value="v", eligible="elig", slots=[("UTIL", 10)], bench=3, weight=0.5)
    return out.join(kept.groupBy("grp").agg(F.count(F.lit(1)).alias("n")), "grp").select("grp", r("lineup_value", 3).alias("lineup_value"), "n")


@query("top_n_per_category", "2.6.3, 2.6.13, 2.4.63", """
SELECT p_type AS category, p_partkey, p_retailprice, CAST(rn AS INTEGER) AS category_rank FROM (SELECT *, row_number() OVER (PARTITION BY p_type ORDER BY p_retailprice DESC, p_partkey) rn FROM part) WHERE rn <= 5
""")
def top_n_per_category(t: Tables):
    parts = t.part.withColumn("cats", F.array("p_type"))
    return value.best_by_category(parts, None, entity="p_partkey", categories="cats", order=[desc("p_retailprice"), asc("p_partkey")], n=5).select("category", "p_partkey", "p_retailprice", "category_rank")


@query("best_available", "2.2.56-59, 2.4.90, 2.6.14", """
SELECT c_custkey, c_acctbal FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F') ORDER BY c_acctbal DESC, c_custkey LIMIT 100
""")
def best_available(t: Tables):
    taken = t.orders.where(F.col("o_orderstatus") == "F").select(F.col("o_custkey").alias("c_custkey")).distinct()
    left = t.customer.join(taken, "c_custkey", "left_anti")
    return left.orderBy(F.col("c_acctbal").desc(), "c_custkey").limit(100).select("c_custkey", "c_acctbal")


@query("value_at_rank", "2.5.13, 2.6.9, 2.8.81, 2.4.96", """
WITH p AS (SELECT year(o_orderdate) y, o_custkey c, sum(round(o_totalprice, 2)) v FROM orders GROUP BY 1, 2), k AS (SELECT *, row_number() OVER (PARTITION BY y ORDER BY v DESC, c) rk FROM p)
SELECT y, round(coalesce(max(CASE WHEN rk = 151 THEN v END) * 0.75 + max(CASE WHEN rk = 152 THEN v END) * 0.25, arg_max(v, rk)), 4) AS level FROM k WHERE rk <= 152 GROUP BY 1
""")
def value_at_rank(t: Tables):
    p = t.order_events.groupBy("y", "cust").agg(F.sum(F.round("price", 2)).alias("v"))
    return value.value_at_rank(p, "v", 150.25, tie="cust", group=["y"]).select("y", r("level", 4).alias("level"))


@query("average_rank_spearman", "2.5.14, 2.8.74, 2.8.90", EVAL_SQL + """,
k AS (SELECT y, rank() OVER (PARTITION BY y ORDER BY pgp) + (count(*) OVER (PARTITION BY y, pgp) - 1) / 2.0 AS rp, rank() OVER (PARTITION BY y ORDER BY agp) + (count(*) OVER (PARTITION BY y, agp) - 1) / 2.0 AS ra FROM e WHERE projected)
SELECT y, round(corr(rp, ra), 6) AS spearman FROM k WHERE y <= 2001 GROUP BY y
""")
def average_rank_spearman(t: Tables):
    f = projections_and_outcomes(t).where(F.col("projected") & (F.col("season") <= 2001))
    return metrics.spearman(f, ["season"], "proj_gp", "actual_gp").select(F.col("season").alias("y"), r("spearman").alias("spearman"))


@query("tied_ranks", "2.5.14, 2.5.17", """
SELECT p_partkey, rank() OVER (ORDER BY p_size DESC) + (count(*) OVER (PARTITION BY p_size) - 1) / 2.0 AS avg_rank, rank() OVER (ORDER BY p_size DESC) AS min_rank FROM part
""")
def tied_ranks(t: Tables):
    p = t.part.select("p_partkey", "p_size")
    out = ranking.with_tied_rank(ranking.with_tied_rank(p, [], desc("p_size"), "avg_rank"), [], desc("p_size"), "min_rank", method="min")
    return out.select("p_partkey", "avg_rank", F.col("min_rank").cast("long").alias("min_rank"))


@query("topk_hit_capture", "2.8.78-79", EVAL_SQL + """,
a AS (SELECT y, c, CASE WHEN projected THEN row_number() OVER (PARTITION BY y, projected ORDER BY pred DESC, c) END kp, CASE WHEN played THEN row_number() OVER (PARTITION BY y, played ORDER BY act DESC, c) END ka, act FROM e),
ks AS (SELECT unnest([12, 50, 100]) k)
SELECT y, CAST(k AS INTEGER) AS k, round(count(*) FILTER (WHERE kp <= k AND ka <= k) / count(*) FILTER (WHERE ka <= k), 6) AS hit, round(sum(CASE WHEN kp <= k THEN act ELSE 0 END) / sum(CASE WHEN ka <= k THEN act ELSE 0 END), 6) AS capture
FROM a, ks WHERE y BETWEEN 1996 AND 2001 GROUP BY 1, 2
""")
def topk_hit_capture(t: Tables):
    f = metrics.subset_rows(projections_and_outcomes(t).where(F.col("season").between(1996, 2001)), "universe")
    out = metrics.topk_table(f, ["season"], "proj_total_fp", "actual_total_fp", "player_id", [12, 50, 100])
    return out.select(F.col("season").alias("y"), "k", r("hit").alias("hit"), r("capture").alias("capture"))


@query("ndcg_at_50", "2.8.80", EVAL_SQL + """,
d AS (SELECT y, act, row_number() OVER (PARTITION BY y ORDER BY pred DESC NULLS LAST) rp, row_number() OVER (PARTITION BY y ORDER BY act DESC) ra FROM e WHERE y BETWEEN 1996 AND 2001)
SELECT y, round(sum(CASE WHEN rp <= 50 THEN act / log2(rp + 1) ELSE 0 END) / sum(CASE WHEN ra <= 50 THEN act / log2(ra + 1) ELSE 0 END), 6) AS ndcg FROM d GROUP BY 1
""")
def ndcg_at_50(t: Tables):
    f = projections_and_outcomes(t).where(F.col("season").between(1996, 2001))
    return metrics.ndcg(f, ["season"], "proj_total_fp", "actual_total_fp", 50).select(F.col("season").alias("y"), r("ndcg").alias("ndcg"))


@query("auc_by_label", "2.8.110", """
WITH s AS (SELECT lang AS g, n_chars AS x, quality AS y FROM labels JOIN documents USING (doc_id)), k AS (SELECT g, y, rank() OVER (PARTITION BY g ORDER BY x) + (count(*) OVER (PARTITION BY g, x) - 1) / 2.0 AS rk FROM s)
SELECT g AS lang, round((sum(rk) FILTER (WHERE y = 1) - count(*) FILTER (WHERE y = 1) * (count(*) FILTER (WHERE y = 1) + 1) / 2.0) / nullif(count(*) FILTER (WHERE y = 1) * count(*) FILTER (WHERE y = 0), 0), 6) AS auc FROM k GROUP BY 1
""")
def auc_by_label(t: Tables):
    rows = t.labels.join(t.documents.select("doc_id", "lang", "n_chars"), "doc_id")
    return metrics.auc(rows, ["lang"], "n_chars", "quality").select("lang", r("auc").alias("auc"))


@query("precision_at_k", "2.8.111, 2.8.115", """
SELECT lang, round(avg(quality), 6) AS precision FROM (SELECT lang, quality, row_number() OVER (PARTITION BY lang ORDER BY n_chars DESC, doc_id) rn FROM labels JOIN documents USING (doc_id)) WHERE rn <= 20 GROUP BY 1
""")
def precision_at_k(t: Tables):
    rows = t.labels.join(t.documents.select("doc_id", "lang", "n_chars"), "doc_id")
    return metrics.precision_at_k(rows, ["lang"], "n_chars", "quality", "doc_id", 20).select("lang", r("precision").alias("precision"))


@query("error_metrics", "2.8.75-77, 2.3.8, 2.8.92", EVAL_SQL + """
SELECT y, count(*) AS n, round(avg(abs(pred - act)), 4) AS mae, round(sqrt(avg((pred - act) * (pred - act))), 4) AS rmse, round(avg(pred - act), 4) AS bias FROM e WHERE projected AND y <= 2001 GROUP BY 1
""")
def error_metrics(t: Tables):
    f = projections_and_outcomes(t).where(F.col("projected") & (F.col("season") <= 2001))
    p, a = F.col("proj_total_fp"), F.col("actual_total_fp")
    return f.groupBy(F.col("season").alias("y")).agg(F.count(F.lit(1)).alias("n"), r(metrics.mae(p, a), 4).alias("mae"), r(metrics.rmse(p, a), 4).alias("rmse"), r(metrics.bias(p, a), 4).alias("bias"))


@query("period_metrics", "2.8.87-93, 2.8.178, 2.11.4-5", EVAL_SQL + """,
lv AS (SELECT y, coalesce(max(CASE WHEN rk = 183 THEN act END), 0) AS lvl FROM (SELECT y, act, row_number() OVER (PARTITION BY y ORDER BY act DESC, c) rk FROM e WHERE played) GROUP BY 1)
SELECT y, count(*) FILTER (WHERE projected) AS n_projected, count(*) FILTER (WHERE played) AS n_played, count(*) FILTER (WHERE projected AND NOT played) AS n_projected_no_games, count(*) FILTER (WHERE played AND NOT projected) AS n_coverage_miss,
  round(coalesce(sum(act) FILTER (WHERE played AND NOT projected), 0) / sum(act) FILTER (WHERE played), 6) AS coverage_miss_fp_share, round(any_value(lvl), 2) AS replacement_level,
  round(sum(greatest(greatest(pred, act) - lvl, 0) * abs(pred - act)) FILTER (WHERE projected) / sum(greatest(greatest(pred, act) - lvl, 0)) FILTER (WHERE projected), 4) AS vorp_weighted_mae,
  round(avg(abs(pm - am)) FILTER (WHERE projected AND agp >= 5), 4) AS mae_fppg
FROM e JOIN lv USING (y) WHERE y BETWEEN 1996 AND 2001 GROUP BY 1
""")
def period_metrics(t: Tables):
    f = projections_and_outcomes(t).where(F.col("season").between(1996, 2001))
    out = metrics.period_metrics(f, n_rostered=182, min_gp=5)
    return out.select(F.col("season").alias("y"), "n_projected", "n_played", "n_projected_no_games", "n_coverage_miss", r("coverage_miss_fp_share").alias("coverage_miss_fp_share"),
                      r("replacement_level", 2).alias("replacement_level"), r("vorp_weighted_mae", 4).alias("vorp_weighted_mae"), r("mae_fppg", 4).alias("mae_fppg"))


@query("vorp_weighted_error", "2.8.83", EVAL_SQL + """
SELECT y, round(sum(greatest(greatest(pred, act) - 1000000, 0) * (pred - act)) / nullif(sum(greatest(greatest(pred, act) - 1000000, 0)), 0), 4) AS weighted_bias FROM e WHERE projected AND y <= 2001 GROUP BY 1
""")
def vorp_weighted_error(t: Tables):
    f = projections_and_outcomes(t).where(F.col("projected") & (F.col("season") <= 2001))
    w = metrics.weighted_error(F.col("proj_total_fp"), F.col("actual_total_fp"), F.lit(1000000.0), "bias")
    return f.groupBy(F.col("season").alias("y")).agg(r(w, 4).alias("weighted_bias"))


@query("band_coverage", "2.3.9, 2.4.46, 2.8.91", """
WITH b AS (SELECT l_suppkey k, year(l_shipdate) + 1 y, quantile_cont(l_quantity, 0.1) a, quantile_cont(l_quantity, 0.5) m, quantile_cont(l_quantity, 0.9) z FROM lineitem GROUP BY 1, 2)
SELECT y, count(*) AS band_games, round(avg((l_quantity < a)::INT), 6) AS share_below_p10, round(avg((l_quantity > z)::INT), 6) AS share_above_p90, round(avg((l_quantity < m)::INT), 6) AS share_below_p50
FROM lineitem JOIN b ON k = l_suppkey AND y = year(l_shipdate) GROUP BY 1
""")
def band_coverage(t: Tables):
    rows = t.lineitem.select(F.col("l_suppkey").alias("k"), F.year("l_shipdate").alias("y"), "l_quantity")
    bands = ranking.exact_quantiles(rows, ["k", "y"], "l_quantity", {"fppg_p10": 0.1, "fppg_p50": 0.5, "fppg_p90": 0.9}).withColumn("y", F.col("y") + 1)
    out = metrics.calibration_shares(metrics.band_counts(rows, bands, key=["k", "y"], score="l_quantity"), ["y"])
    return out.select("y", "band_games", *[r(c).alias(c) for c in ("share_below_p10", "share_above_p90", "share_below_p50")])


@query("calibration_bins", "2.4.45, 2.4.91, 2.4.94", """
WITH p AS (SELECT least(n_chars / 20000.0, 1) AS p, quality AS y FROM labels JOIN documents USING (doc_id))
SELECT CAST(CASE WHEN p >= 0.5 THEN 3 WHEN p >= 0.2 THEN 2 WHEN p >= 0.05 THEN 1 ELSE 0 END AS INTEGER) AS bin, count(*) AS n, round(avg(p), 6) AS mean_pred, round(avg(y), 6) AS observed FROM p GROUP BY 1
""")
def calibration_bins(t: Tables):
    rows = t.labels.join(t.documents.select("doc_id", "n_chars"), "doc_id").select(F.least(F.col("n_chars") / 20000.0, F.lit(1.0)).alias("p"), "quality")
    return metrics.calibration_bins(rows, "p", "quality", [0.0, 0.05, 0.2, 0.5, 1.0]).select("bin", "n", r("mean_pred").alias("mean_pred"), r("observed").alias("observed"))


@query("decile_bins", "2.4.38-40", """
WITH d AS (SELECT ntile(10) OVER (ORDER BY round(o_totalprice, 2), o_orderkey) AS decile, o_totalprice v, o_orderstatus FROM orders)
SELECT decile AS bin, count(*) AS n, round(avg(v), 4) AS mean_value, count(*) FILTER (WHERE o_orderstatus = 'F') AS n_cohort FROM d GROUP BY 1
""")
def decile_bins(t: Tables):
    rows = t.orders.select(F.round("o_totalprice", 2).alias("v"), "o_orderkey", "o_orderstatus")
    out = studies.equal_bins(rows, [asc("v"), asc("o_orderkey")], 10)
    return out.groupBy("bin").agg(F.count(F.lit(1)).alias("n"), r(F.avg("v"), 4).alias("mean_value"), F.count_if(F.col("o_orderstatus") == "F").alias("n_cohort"))


@query("grouping_sets_win_share", "2.4.46, 2.4.51-52", """
WITH d AS (SELECT year(o_orderdate) y, o_orderstatus s, o_orderpriority p, CASE WHEN o_totalprice > 250000 THEN 1.0 ELSE 0.0 END w FROM orders)
SELECT coalesce(CAST(y AS VARCHAR), 'all') AS y, coalesce(s, 'all') AS status, coalesce(p, 'all') AS priority, count(*) AS n, round(avg(w), 6) AS win_share FROM d GROUP BY GROUPING SETS ((), (y), (s), (p), (y, s))
""")
def grouping_sets_win_share(t: Tables):
    d = t.order_events.select(F.col("y").cast("string").alias("y"), F.col("o_orderstatus").alias("status"), F.col("o_orderpriority").alias("priority"), (F.col("price") > 250000).alias("won"))
    return studies.win_shares(d, ["y", "status", "priority"], [[], ["y"], ["status"], ["priority"], ["y", "status"]], "won").withColumn("win_share", r("win_share"))


@query("disagreement_top_n", "2.6.4, 2.3.53-54, 2.4.56", """
WITH a AS (SELECT c_custkey c, row_number() OVER (ORDER BY c_acctbal DESC, c_custkey) ra FROM customer), b AS (SELECT o_custkey c, row_number() OVER (ORDER BY sum(round(o_totalprice, 2)) DESC, o_custkey) rb FROM orders GROUP BY o_custkey)
SELECT a.c AS cust, CAST(rb - ra AS BIGINT) AS delta FROM a JOIN b USING (c) ORDER BY abs(rb - ra) DESC, a.c LIMIT 50
""")
def disagreement_top_n(t: Tables):
    a = ranking.with_row_number(t.customer.select(F.col("c_custkey").alias("cust"), "c_acctbal"), [], [desc("c_acctbal"), asc("cust")], "ra")
    b = ranking.with_row_number(t.order_events.groupBy("cust").agg(F.sum(F.round("price", 2)).alias("v")), [], [desc("v"), asc("cust")], "rb")
    j = a.join(b, "cust").select("cust", (F.col("rb") - F.col("ra")).cast("long").alias("delta"))
    return j.orderBy(F.abs("delta").desc(), "cust").limit(50)


@query("rank_movers", "2.3.80, 2.3.82, 2.3.86", EVAL_SQL + """,
r AS (SELECT c, y, row_number() OVER (PARTITION BY y ORDER BY round(fp, 2) DESC, c) rk FROM p),
j AS (SELECT coalesce(a.c, b.c) c, a.rk pa, b.rk pb FROM (SELECT * FROM r WHERE y = 1997) a FULL JOIN (SELECT * FROM r WHERE y = 1998) b ON a.c = b.c)
SELECT c AS cust, CASE WHEN pa IS NULL THEN 'gained' WHEN pb IS NULL THEN 'lost' WHEN pa - pb >= 100 THEN 'riser' ELSE 'faller' END AS kind, CAST(pa - pb AS BIGINT) AS move FROM j WHERE pa IS NULL OR pb IS NULL OR abs(pa - pb) >= 100
""")
def rank_movers(t: Tables):
    p = order_panel(t).where(F.col("y").isin(1997, 1998)).withColumn("v", F.round("fp_sum", 2))
    k = ranking.with_row_number(p, ["y"], [desc("v"), asc("cust")], "rk").withColumn("rk", F.col("rk").cast("long"))
    out = diffs.rank_moves(k.where(F.col("y") == 1997), k.where(F.col("y") == 1998), entity="cust", rank="rk", min_move=100)
    return out.select("cust", "kind", "move")


@query("rank_movers_by_year", "2.3.80, 2.3.82, 2.3.86", EVAL_SQL + """,
r AS (SELECT c, y, row_number() OVER (PARTITION BY y ORDER BY round(fp, 2) DESC, c) rk FROM p),
j AS (SELECT coalesce(a.y, b.y) y, coalesce(a.c, b.c) c, a.rk pa, b.rk pb FROM (SELECT c, y + 1 AS y, rk FROM r WHERE y + 1 IN (SELECT y FROM r)) a
      FULL JOIN (SELECT * FROM r WHERE y - 1 IN (SELECT y FROM r)) b ON a.c = b.c AND a.y = b.y)
SELECT y, c AS cust, CASE WHEN pa IS NULL THEN 'gained' WHEN pb IS NULL THEN 'lost' WHEN pa - pb >= 100 THEN 'riser' ELSE 'faller' END AS kind, CAST(pa - pb AS BIGINT) AS move FROM j WHERE pa IS NULL OR pb IS NULL OR abs(pa - pb) >= 100
""")
def rank_movers_by_year(t: Tables):
    p = order_panel(t).withColumn("v", F.round("fp_sum", 2))
    k = ranking.with_row_number(p, ["y"], [desc("v"), asc("cust")], "rk").select("cust", "y", F.col("rk").cast("long").alias("rk"))
    years = t.order_events.select("y").distinct()
    last = k.withColumn("y", F.col("y") + 1).join(F.broadcast(years), "y", "left_semi")
    now = k.join(F.broadcast(years.select((F.col("y") + 1).alias("y"))), "y", "left_semi")
    return diffs.rank_moves(last, now, entity="cust", rank="rk", min_move=100, period="y").select("y", "cust", "kind", "move")


@query("wls_coefficients", "2.8.10, 2.8.26, 2.8.16", """
WITH s AS (SELECT sum(l_quantity) w, sum(l_quantity * l_discount) wx, sum(l_quantity * l_extendedprice / 1000) wy, sum(l_quantity * l_discount * l_discount) wxx, sum(l_quantity * l_discount * l_extendedprice / 1000) wxy FROM lineitem)
SELECT round((w * wxy - wx * wy) / (w * wxx - wx * wx), 4) AS slope, round((wy - wx * (w * wxy - wx * wy) / (w * wxx - wx * wx)) / w, 4) AS intercept FROM s
""")
def wls_coefficients(t: Tables):
    rows = t.lineitem.select("l_quantity", "l_discount", (F.col("l_extendedprice") / 1000).alias("y"))
    beta = fit.wls(rows, ["l_discount"], "y", "l_quantity", ridge=0.0)
    return t.spark.createDataFrame([(round(float(beta[1]), 4), round(float(beta[0]), 4))], "slope double, intercept double")


@query("kappa_grid", "2.8.8-9, 2.8.13, 2.2.1", """
WITH p AS (SELECT o_custkey c, year(o_orderdate) y, count(*) n, avg(o_totalprice) m FROM orders GROUP BY 1, 2), pr AS (SELECT avg(o_totalprice) g FROM orders),
j AS (SELECT a.n, a.m, b.n AS w, b.m AS y FROM p a JOIN p b ON b.c = a.c AND b.y = a.y + 1), ks AS (SELECT unnest([0.5, 1.0, 2.0, 4.0, 8.0, 16.0, 32.0, 64.0])::DOUBLE kappa)
SELECT kappa, count(*) AS n_rows, round(sum(w * power(y - (g + n / (n + kappa) * (m - g)), 2)) / sum(w) / 1e6, 4) AS loss FROM j, ks, pr GROUP BY 1
""")
def kappa_grid(t: Tables):
    p = order_panel(t).select("cust", "y", "gp", "fppg")
    both = panel.attach_lags(p, p, entity="cust", period="y", n_lags=1, columns=["gp", "fppg"]).where(F.col("gp_lag1").isNotNull())
    mean = t.orders.agg(F.avg("o_totalprice")).scalar()
    rows = both.select(F.col("fppg_lag1").alias("est"), F.col("gp_lag1").alias("n"), F.col("fppg").alias("target"), F.col("gp").alias("w")).withColumn("prior", mean)
    out = fit.kappa_losses(rows, "est", "prior", "n", "target", "w", [0.5, 1.0, 2.0, 4.0, 8.0, 16.0, 32.0, 64.0])
    return out.select("kappa", F.col("rows").alias("n_rows"), r(F.col("loss") / 1e6, 4).alias("loss"))


@query("expanding_fit", "2.8.104, 2.8.124, 2.8.141", """
WITH l AS (SELECT year(l_shipdate) y, l_quantity x, l_extendedprice / 1000 v FROM lineitem), s AS (SELECT y, count(*) n, sum(x) sx, sum(v) sv, sum(x * x) sxx, sum(x * v) sxv FROM l GROUP BY 1),
c AS (SELECT y, sum(n) OVER w n, sum(sx) OVER w sx, sum(sv) OVER w sv, sum(sxx) OVER w sxx, sum(sxv) OVER w sxv FROM s WINDOW w AS (ORDER BY y ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
b AS (SELECT y, (n * sxv - sx * sv) / (n * sxx - sx * sx) slope, (sv - sx * (n * sxv - sx * sv) / (n * sxx - sx * sx)) / n icpt FROM c WHERE n IS NOT NULL)
SELECT y, round(avg(abs(v - icpt - slope * x)), 4) AS mae, count(*) AS n FROM l JOIN b USING (y) GROUP BY 1
""")
def expanding_fit(t: Tables):
    rows = t.lineitem.select(F.year("l_shipdate").alias("y"), F.col("l_quantity").alias("x"), (F.col("l_extendedprice") / 1000).alias("v"))
    grams = fit.gram(rows, ["x"], "v", by="y")
    betas = fit.expanding_fits(grams, sorted(grams), ridge=0.0)
    pred = fit.by_period({k: b[0] for k, b in betas.items()}, F.col("y")) + fit.by_period({k: b[1] for k, b in betas.items()}, F.col("y")) * F.col("x")
    scored = rows.withColumn("pred", pred).where(F.col("pred").isNotNull())
    return scored.groupBy("y").agg(r(F.avg(F.abs(F.col("v") - F.col("pred"))), 4).alias("mae"), F.count(F.lit(1)).alias("n"))


@query("loso_ridge_gate", "2.8.57-65, 2.8.163-164")
def loso_ridge_gate(t: Tables):
    p = order_panel(t).select("cust", "y", "gp", "fppg")
    both = panel.attach_lags(p, p, entity="cust", period="y", n_lags=2, columns=["gp", "fppg"]).where(F.col("fppg_lag1").isNotNull())
    rows = both.join(t.customer.select(F.col("c_custkey").alias("cust"), "c_acctbal"), "cust").withColumn("resid", (F.col("fppg") - F.col("fppg_lag1")) / 1000)
    rows = rows.withColumn("x1", F.col("fppg_lag1") / 1000).withColumn("x2", F.coalesce("gp_lag2", F.lit(0)).cast("double")).withColumn("x3", F.col("c_acctbal") / 1000)
    gate = fit.gated_ridge(rows, ["x1", "x2", "x3"], "resid", "gp", "y", center=True, use_intercept=True)
    return rows.withColumn("adj", gate.adjustment()).groupBy("y").agg(F.count(F.lit(1)).alias("n"), r(F.avg(F.abs("resid")), 4).alias("mae_before"), r(F.avg(F.abs(F.col("resid") - F.col("adj"))), 4).alias("mae_after"))


@query("bootstrap_interval", "2.8.84-86, 2.8.112, 2.8.129")
def bootstrap_interval(t: Tables):
    f = projections_and_outcomes(t).where(F.col("projected") & F.col("season").between(1996, 2001)).withColumn("err", F.abs(F.col("proj_total_fp") - F.col("actual_total_fp")))
    out = resample.mean_interval(f, "err", ["player_id"], strata=["season"], n_boot=200)
    return out.select(*[r(c, 3).alias(c) for c in ("estimate", "lo", "hi", "se", "p_le_zero")], "n_reps")


@query("t_interval_by_group", "2.4.48-49, 2.8.156", """
WITH m AS (SELECT o_orderpriority p, year(o_orderdate) y, avg(CASE WHEN o_orderstatus = 'F' THEN o_totalprice END) - avg(CASE WHEN o_orderstatus = 'O' THEN o_totalprice END) AS d FROM orders GROUP BY 1, 2)
SELECT p AS priority, round(avg(d), 3) AS mean, round(avg(d) - 2.447 * stddev_samp(d) / sqrt(count(*)), 3) AS lo, round(avg(d) + 2.447 * stddev_samp(d) / sqrt(count(*)), 3) AS hi, count(*) AS n, count(*) FILTER (WHERE d > 0) AS n_positive FROM m GROUP BY 1
""")
def t_interval_by_group(t: Tables):
    st = lambda s: F.avg(F.when(F.col("o_orderstatus") == s, F.col("price")))
    m = t.order_events.groupBy(F.col("o_orderpriority").alias("priority"), "y").agg((st("F") - st("O")).alias("d"))
    return resample.t_interval(m, "d", ["priority"]).select("priority", *[r(c, 3).alias(c) for c in ("mean", "lo", "hi")], "n", "n_positive")


@query("demeaned_effect", "2.8.121-123, 2.4.77-78", """
WITH d AS (SELECT year(l_shipdate) y, l_quantity q, l_discount x FROM lineitem), m AS (SELECT y, avg(q) mq, avg(x) mx FROM d GROUP BY 1), e AS (SELECT d.y, q - mq AS q, x - mx AS x FROM d JOIN m USING (y))
SELECT y, count(*) AS n, round(sum(x * q) / sum(x * x), 4) AS slope FROM e GROUP BY 1
""")
def demeaned_effect(t: Tables):
    rows = t.lineitem.select(F.year("l_shipdate").alias("y"), F.col("l_quantity").alias("q"), F.col("l_discount").alias("x"))
    return studies.slope_within(rows, ["y"], "x", "q").select("y", "n", r("slope", 4).alias("slope"))


@query("mad_spread", "2.4.92", """
WITH b AS (SELECT l_returnflag b, l_quantity v FROM lineitem), m AS (SELECT b, quantile_cont(v, 0.5) med FROM b GROUP BY 1)
SELECT b AS bucket, count(*) AS n, round(any_value(med), 6) AS median, round(1.4826 * quantile_cont(abs(v - med), 0.5), 6) AS robust_sd FROM b JOIN m USING (b) GROUP BY 1
""")
def mad_spread(t: Tables):
    rows = t.lineitem.select(F.col("l_returnflag").alias("bucket"), F.col("l_quantity").alias("v"))
    return studies.robust_spread(rows, ["bucket"], "v").select("bucket", "n", r("median").alias("median"), r("robust_sd").alias("robust_sd"))


@query("weighted_quantile", "2.8.11", """
WITH g AS (SELECT l_extendedprice v, sum(l_quantity) w FROM lineitem GROUP BY 1), c AS (SELECT v, sum(w) OVER (ORDER BY v) cw, sum(w) OVER () tw FROM g)
SELECT min(v) FILTER (WHERE cw >= 0.25 * tw) AS q25, min(v) FILTER (WHERE cw >= 0.75 * tw) AS q75 FROM c
""")
def weighted_quantile(t: Tables):
    q = fit.weighted_quantile(t.lineitem, "l_extendedprice", "l_quantity", [0.25, 0.75])
    return t.spark.createDataFrame([tuple(q)], "q25 double, q75 double")


@query("largest_misses", "2.4.56-57", EVAL_SQL + """,
k AS (SELECT y, c, pred - act AS err, row_number() OVER (PARTITION BY y ORDER BY abs(round(pred - act, 2)) DESC, c) rk, sum(abs(pred - act)) OVER (PARTITION BY y) tot FROM e WHERE projected AND y BETWEEN 1996 AND 2001)
SELECT y, c AS cust, round(err, 2) AS err, round(abs(err) / tot, 6) AS share, CASE WHEN err > 0 THEN 'over' ELSE 'under' END AS tag FROM k WHERE rk <= 10
""")
def largest_misses(t: Tables):
    f = projections_and_outcomes(t).where(F.col("projected") & F.col("season").between(1996, 2001)).withColumn("err", F.col("proj_total_fp") - F.col("actual_total_fp"))
    out = studies.largest_misses(f, period="season", entity="player_id", err="err", n=10)
    return out.select(F.col("season").alias("y"), F.col("player_id").alias("cust"), r("err", 2).alias("err"), r("share").alias("share"), F.when(F.col("err") > 0, "over").otherwise("under").alias("tag"))


@query("need_scores", "2.4.79-85", """
WITH cap AS (SELECT unnest(['PG', 'SG', 'SF', 'PF', 'C']) AS need_position, unnest([2.7, 2.7, 2.7, 2.7, 2.2])::DOUBLE AS need_capacity),
mine AS (SELECT ['PG', 'SG', 'SF', 'PF', 'C'][CAST(c_nationkey % 5 + 1 AS INTEGER)] AS p FROM customer WHERE c_acctbal > 9990)
SELECT need_position, round(need_capacity, 4) AS need_capacity, count(p) AS need_filled, round(greatest(0, least(1, (need_capacity - count(p)) / need_capacity)), 6) AS need_score FROM cap LEFT JOIN mine ON p = need_position GROUP BY cap.need_position, cap.need_capacity
""")
def need_scores(t: Tables):
    config = {"league": {"roster": {"starters": {"PG": 1, "SG": 1, "SF": 1, "PF": 1, "C": 1, "G": 1, "F": 1, "UTIL": 3}, "bench": 3}}}
    names = F.array(*[F.lit(x) for x in ("PG", "SG", "SF", "PF", "C")])
    board = t.customer.select(F.col("c_custkey").alias("player_id"), F.element_at(names, (F.col("c_nationkey") % 5 + 1).cast("int")).alias("position"), "c_acctbal")
    out = value.position_need(board, board.where(F.col("c_acctbal") > 9990), value.position_capacity(config))
    return out.select("need_position", r("need_capacity", 4).alias("need_capacity"), "need_filled", r("need_score").alias("need_score"))


@query("late_window_shares", "2.4.58-60", """
WITH g AS (SELECT DISTINCT user_id u, user_id % 10 AS t, CAST(ts AS DATE) d FROM events),
a AS (SELECT t, count(DISTINCT d) FILTER (WHERE d < DATE '2024-01-21') te, count(DISTINCT d) FILTER (WHERE d >= DATE '2024-01-21') tl FROM g GROUP BY 1),
o AS (SELECT u, t, count(*) FILTER (WHERE d < DATE '2024-01-21') e, count(*) FILTER (WHERE d >= DATE '2024-01-21') l FROM g GROUP BY 1, 2)
SELECT u, t AS grp, round(e / te, 6) AS early_share, round(l / tl, 6) AS late_share, round(l / tl - e / te, 6) AS gap FROM o JOIN a USING (t)
""")
def late_window_shares(t: Tables):
    days = t.user_days.select(F.col("user_id").alias("u"), (F.col("user_id") % 10).alias("grp"), F.lit(1).alias("p"), "d")
    late = F.col("d") >= F.lit("2024-01-21").cast("date")
    out = studies.two_window_shares(days, days, entity="u", group="grp", period="p", in_late=late, event="d")
    return out.select("u", "grp", *[r(c).alias(c) for c in ("early_share", "late_share", "gap")])


@query("newcomer_classes", "2.3.20, 2.3.21", """
WITH f AS (SELECT o_custkey c, min(year(o_orderdate)) y FROM orders GROUP BY 1), k AS (SELECT DISTINCT o_custkey c FROM orders WHERE year(o_orderdate) < 1997)
SELECT CASE WHEN y = 1997 THEN 'rookie' WHEN y < 1997 THEN 'stash' ELSE 'undrafted' END AS newcomer_class, count(*) AS n FROM f WHERE c NOT IN (SELECT c FROM k) GROUP BY 1
""")
def newcomer_classes(t: Tables):
    ev = t.order_events
    listed = ev.groupBy(F.col("cust").alias("player_id")).agg(F.min("y").alias("first")).select("player_id", F.when(F.col("first") <= 1997, F.col("first")).alias("draft_year"))
    known = ev.where(F.col("y") < 1997).select(F.col("cust").alias("player_id"))
    return studies.newcomer_candidates(listed, known, season=1997).groupBy("newcomer_class").agg(F.count(F.lit(1)).alias("n"))


@query("pair_win_share", "2.4.60-61", """
WITH p AS (SELECT l_orderkey, sum(l_extendedprice) s FROM lineitem GROUP BY l_orderkey HAVING count(*) = 2)
SELECT l_suppkey AS k, count(*) AS n, round(avg(CASE WHEN l_extendedprice > p.s - l_extendedprice THEN 1.0 ELSE 0 END), 6) AS win_pct FROM lineitem JOIN p USING (l_orderkey) GROUP BY 1
""")
def pair_win_share(t: Tables):
    pairs = t.lineitem.groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("n"), F.sum("l_extendedprice").alias("s")).where(F.col("n") == 2).drop("n")
    rows = t.lineitem.join(pairs, "l_orderkey").select(F.col("l_suppkey").alias("k"), F.col("l_extendedprice").alias("own"), (F.col("s") - F.col("l_extendedprice")).alias("other"))
    return studies.win_share(rows, ["k"], "own", "other").withColumn("win_pct", r("win_pct"))

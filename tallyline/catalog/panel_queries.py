"""Panels, point-in-time views, lags, joins and group context."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyline.catalog.base import Tables, query, r, text_day
from tallyline.functions.periods import season_label, season_year
from tallyline.functions.positions import eligible_slots, position_group
from tallyline.functions.scoring import weighted_score
from tallyline.operators import calendar, matching, merge, panel, rosters, views
from tallyline.operators.ranking import exact_quantiles
from tallyline.operators.sequences import Roles, flag_back_to_backs

PANEL_SQL = "WITH p AS (SELECT o_custkey cust, year(o_orderdate) y, count(*) gp, sum(o_totalprice) fp_sum, avg(o_totalprice) fppg, stddev_samp(o_totalprice) sd FROM orders GROUP BY 1, 2)"
WEIGHTS = {"l_quantity": 1.0, "l_extendedprice": 0.01, "l_discount": -2.0}


def order_panel(t: Tables):
    return panel.entity_period_panel(t.order_events, entity="cust", period="y", score="price", sums=[])


@query("weighted_score", "2.2.1-3, 2.4.5", """
SELECT l_orderkey, l_linenumber, round(l_quantity + 0.01 * l_extendedprice - 2 * l_discount, 4) AS score FROM lineitem
""")
def weighted_score_rows(t: Tables):
    lines = t.lineitem
    return lines.select("l_orderkey", "l_linenumber", r(weighted_score(lines, WEIGHTS), 4).alias("score"))


@query("season_labels", "2.2.4-8, 2.2.74, 2.1.10", """
SELECT year(o_orderdate) || '-' || lpad(CAST((year(o_orderdate) + 1) % 100 AS VARCHAR), 2, '0') AS season, year(o_orderdate) AS start_year, count(*) AS n FROM orders GROUP BY 1, 2
""")
def season_labels(t: Tables):
    out = t.order_events.groupBy("y").agg(F.count(F.lit(1)).alias("n")).select(season_label(F.col("y")).alias("season"), "n")
    return out.withColumn("start_year", season_year(F.col("season")))


@query("as_of_view", "2.3.1-4, 2.3.89-92, 2.8.96", """
SELECT o_custkey AS player_id, min(year(o_orderdate)) AS from_year, max(CASE WHEN year(o_orderdate) < 1998 THEN year(o_orderdate) END) AS to_year
FROM orders GROUP BY 1 HAVING min(year(o_orderdate)) < 1998
""")
def as_of_view(t: Tables):
    ev = t.order_events
    past = views.before_period(ev, 1998, period=F.col("y"))
    dims = ev.groupBy(F.col("cust").alias("player_id")).agg(F.min("y").alias("from_year"), F.max("y").alias("to_year"), F.lit(None).cast("int").alias("draft_year"))
    clean = views.sanitize_entities(dims, 1998, past.select(F.col("cust").alias("player_id"))).drop("draft_year")
    # a capped last year is only an upper bound; the newest visible event is the known one
    newest = past.groupBy(F.col("cust").alias("player_id")).agg(F.max("y").alias("_last"))
    return clean.join(newest, "player_id").select("player_id", "from_year", F.least("to_year", "_last").alias("to_year"))


@query("scrambled_future_is_ignored", "2.8.97-99", """
SELECT o_custkey AS cust, round(sum(o_totalprice), 2) AS before_sum, CAST(0 AS BIGINT) AS n_changed FROM orders WHERE year(o_orderdate) < 1998 GROUP BY 1
""")
def scrambled_future_is_ignored(t: Tables):
    def build(ev):
        return views.before_period(ev, 1998, period=F.col("y")).groupBy("cust").agg(r(F.sum("price"), 2).alias("before_sum"))
    ev = t.order_events
    shaken = views.scramble_future(ev, 1998, ["price"], period=F.col("y"), key=["o_orderkey"])
    n = views.frames_differ(build(ev), build(shaken), ["cust"], tolerance=1e-6).agg(F.count(F.lit(1))).scalar()
    return build(ev).withColumn("n_changed", n)


@query("entity_period_panel", "2.4.1, 2.4.4, 2.4.6, 2.4.9", PANEL_SQL + """
SELECT cust, y, gp, round(fp_sum, 2) AS fp_sum, round(fppg, 4) AS fppg, round(sd, 4) AS fp_sd FROM p
""")
def entity_period_panel(t: Tables):
    return order_panel(t).select("cust", "y", "gp", r("fp_sum", 2).alias("fp_sum"), r("fppg", 4).alias("fppg"), r("fp_sd", 4).alias("fp_sd"))


@query("lag_matrix", "2.3.5, 2.5.16, 2.8.17-18, 2.8.169", PANEL_SQL + """
SELECT p.cust, p.y, a.gp AS gp_lag1, b.gp AS gp_lag2, c.gp AS gp_lag3, round((coalesce(a.fppg, 0) + 0.5 * coalesce(b.fppg, 0) + 0.25 * coalesce(c.fppg, 0))
  / nullif((a.fppg IS NOT NULL)::INT + 0.5 * (b.fppg IS NOT NULL)::INT + 0.25 * (c.fppg IS NOT NULL)::INT, 0), 4) AS recent
FROM p LEFT JOIN p a ON a.cust = p.cust AND a.y = p.y - 1 LEFT JOIN p b ON b.cust = p.cust AND b.y = p.y - 2 LEFT JOIN p c ON c.cust = p.cust AND c.y = p.y - 3
""")
def lag_matrix(t: Tables):
    from tallyline.functions.scoring import recency_weighted
    p = order_panel(t).select("cust", "y", "gp", "fppg")
    out = panel.attach_lags(p.select("cust", "y"), p, entity="cust", period="y", n_lags=3, columns=["gp", "fppg"])
    return out.select("cust", "y", "gp_lag1", "gp_lag2", "gp_lag3", r(recency_weighted(panel.lags("fppg", 3), 0.5), 4).alias("recent"))


@query("consecutive_pairs", "2.3.7, 2.4.54", PANEL_SQL + """
SELECT a.cust, a.y, round(b.fp_sum / b.gp - a.fp_sum / a.gp, 4) AS delta, round(a.gp * b.gp / (a.gp + b.gp), 6) AS weight FROM p a JOIN p b ON b.cust = a.cust AND b.y = a.y + 1
""")
def consecutive_pairs(t: Tables):
    out = panel.consecutive_pairs(order_panel(t), "fp_sum", "gp", entity="cust", period="y", age=None)
    return out.select("cust", "y", r("delta", 4).alias("delta"), r("weight").alias("weight"))


@query("style_persistence", "2.4.54, 2.8.74", PANEL_SQL + """
SELECT a.y, count(*) AS n, round(corr(a.fppg, b.fppg), 6) AS persistence FROM p a JOIN p b ON b.cust = a.cust AND b.y = a.y + 1 GROUP BY 1
""")
def style_persistence(t: Tables):
    p = order_panel(t).select("cust", "y", "fppg")
    both = panel.attach_lags(p, p, entity="cust", period="y", n_lags=1, columns=["fppg"]).where(F.col("fppg_lag1").isNotNull())
    return both.groupBy((F.col("y") - 1).alias("y")).agg(F.count(F.lit(1)).alias("n"), r(F.corr("fppg_lag1", "fppg")).alias("persistence"))


@query("nearest_period_fill", "2.1.20, 2.3.6", """
WITH rows AS (SELECT o_custkey cust, year(o_orderdate) y FROM orders GROUP BY 1, 2),
known AS (SELECT o_custkey cust, year(o_orderdate) y, max(o_totalprice) v FROM orders WHERE o_orderstatus = 'F' GROUP BY 1, 2),
c AS (SELECT r.cust, r.y, k.v, row_number() OVER (PARTITION BY r.cust, r.y ORDER BY abs(k.y - r.y), k.y) rn FROM rows r LEFT JOIN known k ON k.cust = r.cust)
SELECT cust, y, v AS filled FROM c WHERE rn = 1
""")
def nearest_period_fill(t: Tables):
    ev = t.order_events
    rows = ev.select("cust", "y").distinct()
    known = ev.where(F.col("o_orderstatus") == "F").groupBy("cust", "y").agg(F.max("price").alias("v"))
    return panel.nearest_period_value(rows, known, entity="cust", period="y", value="v", name="filled")


@query("period_lengths", "2.4.2-3, 2.4.95", """
WITH g AS (SELECT year(o_orderdate) y, c_nationkey k, count(*) n FROM orders JOIN customer ON c_custkey = o_custkey GROUP BY 1, 2),
m AS (SELECT y, quantile_cont(n, 0.5) AS len FROM g GROUP BY 1)
SELECT y, CAST(len AS DOUBLE) AS season_len, CAST(round(max(len) OVER (ORDER BY y ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING)) AS INTEGER) AS target_len FROM m
""")
def period_lengths(t: Tables):
    ev = t.order_events.join(t.customer.select(F.col("c_custkey").alias("cust"), F.col("c_nationkey").alias("k")), "cust")
    lengths = panel.period_lengths(ev, group="k", period="y")
    return lengths.join(panel.target_period_length(lengths, period="y"), "y")


@query("first_timers", "2.3.14, 2.3.20, 2.4.7", """
SELECT y, count(*) AS n_rows, count(*) FILTER (WHERE first < y) AS n_veterans, count(*) FILTER (WHERE first = y) AS n_first
FROM (SELECT DISTINCT o_custkey c, year(o_orderdate) y FROM orders) JOIN (SELECT o_custkey c, min(year(o_orderdate)) first FROM orders GROUP BY 1) USING (c) GROUP BY 1
""")
def first_timers(t: Tables):
    ev = t.order_events
    flagged = panel.veteran_flag(ev.select("cust", "y").distinct(), ev, entity="cust", period="y")
    return flagged.groupBy("y").agg(F.count(F.lit(1)).alias("n_rows"), F.count_if("veteran").alias("n_veterans"), F.count_if(~F.col("veteran")).alias("n_first"))


@query("as_of_latest", "2.3.26, 2.3.70, 2.6.17", """
SELECT user_id, event_type, round(value, 2) AS value FROM (
  SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC) rn FROM events WHERE CAST(ts AS DATE) <= DATE '2024-01-15') WHERE rn = 1
""")
def as_of_latest(t: Tables):
    return merge.as_of_latest(t.events, ["user_id"], "ts", ["event_type", "value"], "2024-01-15").select("user_id", "event_type", r("value", 2).alias("value"))


@query("to_date_and_rest", "2.4.8-10, 2.4.14", """
SELECT o_custkey AS cust, count(*) FILTER (WHERE o_orderdate <= DATE '1998-06-30') AS n_to_date, count(*) FILTER (WHERE o_orderdate > DATE '1998-06-30') AS n_rest,
       round(coalesce(sum(o_totalprice) FILTER (WHERE o_orderdate <= DATE '1998-06-30'), 0), 2) AS value_to_date
FROM orders WHERE year(o_orderdate) = 1998 GROUP BY 1
""")
def to_date_and_rest(t: Tables):
    ev = t.order_events.where(F.col("y") == 1998)
    past, rest = panel.split_by_date(ev, "d", "1998-06-30")
    a = past.groupBy("cust").agg(F.count(F.lit(1)).alias("n_to_date"), F.sum("price").alias("v"))
    b = rest.groupBy("cust").agg(F.count(F.lit(1)).alias("n_rest"))
    j = a.join(b, "cust", "full").na.fill({"n_to_date": 0, "n_rest": 0, "v": 0.0})
    return j.select("cust", "n_to_date", "n_rest", r("v", 2).alias("value_to_date"))


@query("median_event_date", "2.4.11", """
WITH d AS (SELECT DISTINCT c_nationkey k, year(o_orderdate) y, CAST(o_orderdate AS DATE) d FROM orders JOIN customer ON c_custkey = o_custkey),
n AS (SELECT *, row_number() OVER (PARTITION BY k, y ORDER BY d) nth FROM d)
SELECT y, CAST(nth AS INTEGER) AS nth, strftime(DATE '1970-01-01' + CAST(floor(quantile_cont(date_diff('day', DATE '1970-01-01', d), 0.5)) AS INTEGER), '%Y-%m-%d') AS cutoff
FROM n WHERE nth IN (5, 10, 20) GROUP BY 1, 2
""")
def median_event_date(t: Tables):
    ev = t.order_events.join(t.customer.select(F.col("c_custkey").alias("cust"), F.col("c_nationkey").alias("k")), "cust").select("k", "y", "d").withColumn("e", F.col("d"))
    return panel.median_event_date(ev, group="k", period="y", day="d", event="e", nth=[5, 10, 20]).withColumn("cutoff", text_day("cutoff"))


@query("quantile_band", "2.4.17-18, 2.4.32", """
SELECT l_suppkey, year(l_shipdate) AS y, round(quantile_cont(l_quantity, 0.1), 6) AS p10, round(quantile_cont(l_quantity, 0.5), 6) AS p50, round(quantile_cont(l_quantity, 0.9), 6) AS p90
FROM lineitem GROUP BY 1, 2
""")
def quantile_band(t: Tables):
    rows = t.lineitem.select("l_suppkey", F.year("l_shipdate").alias("y"), "l_quantity")
    out = exact_quantiles(rows, ["l_suppkey", "y"], "l_quantity", {"p10": 0.1, "p50": 0.5, "p90": 0.9})
    return out.select("l_suppkey", "y", *[r(c).alias(c) for c in ("p10", "p50", "p90")])


@query("naive_projection", "2.4.17-20", """
WITH p AS (SELECT l_partkey k, year(l_shipdate) y, count(*) gp, avg(l_extendedprice) m, quantile_cont(l_extendedprice, 0.1) a, quantile_cont(l_extendedprice, 0.9) b FROM lineitem GROUP BY 1, 2)
SELECT k, y + 1 AS y, gp AS proj_gp, round(m + 1e-7, 4) AS proj_fppg, round(CASE WHEN gp >= 5 THEN a END, 4) AS fppg_p10, round(CASE WHEN gp >= 5 THEN b END, 4) AS fppg_p90 FROM p
""")
def naive_projection(t: Tables):
    rows = t.lineitem.select(F.col("l_partkey").alias("k"), F.year("l_shipdate").alias("y"), "l_extendedprice")
    out = panel.naive_last_period(rows, entity="k", period="y", score="l_extendedprice", min_events=5)
    return out.select("k", "y", "proj_gp", r(F.col("proj_fppg") + 1e-7, 4).alias("proj_fppg"), r("fppg_p10", 4).alias("fppg_p10"), r("fppg_p90", 4).alias("fppg_p90"))


@query("cohort_weighted_z", "2.4.29-30, 2.4.55", """
WITH g AS (SELECT l_partkey k, year(l_shipdate) y, sum(l_quantity) w, avg(l_extendedprice) x FROM lineitem GROUP BY 1, 2),
m AS (SELECT y, sum(w * x) / sum(w) mu, count(*) n FROM g WHERE w >= 40 GROUP BY y),
s AS (SELECT g.y, sqrt(sum(w * (x - mu) * (x - mu)) / sum(w)) sd FROM g JOIN m USING (y) WHERE w >= 40 GROUP BY g.y)
SELECT g.k, g.y, round(CASE WHEN n >= 5 AND sd > 1e-9 THEN greatest(-2.5, least(2.5, (x - mu) / sd)) END, 4) AS z FROM g LEFT JOIN m USING (y) LEFT JOIN s USING (y)
""")
def cohort_weighted_z(t: Tables):
    g = t.lineitem.groupBy(F.col("l_partkey").alias("k"), F.year("l_shipdate").alias("y")).agg(F.sum("l_quantity").alias("w"), F.avg("l_extendedprice").alias("x"))
    return matching.cohort_z(g, ["y"], {"z": "x"}, "w", min_weight=40.0, clip_at=2.5).select("k", "y", r("z", 4).alias("z"))


@query("top1_top5_depth", "2.4.22", """
WITH l AS (SELECT l_orderkey o, year(o_orderdate) y, o_custkey c, l_quantity q, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_quantity DESC) rk, count(*) OVER (PARTITION BY l_orderkey) n
           FROM lineitem JOIN orders ON o_orderkey = l_orderkey),
g AS (SELECT o, y, max(q) star, avg(CASE WHEN rk <= 5 THEN q END) top5, count(*) FILTER (WHERE q >= 10) depth FROM l WHERE n >= 3 GROUP BY 1, 2),
s AS (SELECT y, o % 25 AS k, count(*) games, avg(star) star, avg(top5) top5, avg(depth) depth FROM g GROUP BY 1, 2 HAVING count(*) >= 20)
SELECT y, k, games, round(star, 6) AS star, round(top5, 6) AS top5, round(depth, 6) AS depth10, round(star - avg(star) OVER (PARTITION BY y), 6) AS star_x FROM s
""")
def top1_top5_depth(t: Tables):
    lines = t.lineitem.join(t.orders, F.col("l_orderkey") == F.col("o_orderkey")).select(
        F.col("l_orderkey").alias("e"), F.year("o_orderdate").alias("y"), (F.col("l_orderkey") % 25).alias("k"), F.col("l_quantity").alias("q"))
    out = rosters.group_style(lines, Roles(entity="q", group="k", period="y", event="e"), minutes="q", rotation=10.0, min_events=20, min_members=3)
    return out.select("y", "k", "games", *[r(c).alias(c) for c in ("star", "top5", "depth10", "star_x")])


@query("share_and_crowding", "2.4.21, 2.3.31", """
WITH l AS (SELECT l_partkey e, l_suppkey g, year(l_shipdate) y, l_orderkey o, l_quantity q FROM lineitem),
m AS (SELECT e, y, g, sum(q) s, count(*) n FROM l GROUP BY 1, 2, 3),
t AS (SELECT g, y, sum(s) total, count(*) FILTER (WHERE s / n >= 30) regulars FROM m GROUP BY 1, 2)
SELECT e, y, g, round(s / total, 6) AS share, t.regulars - CASE WHEN s / n >= 30 THEN 1 ELSE 0 END AS crowd, round(total - s, 2) AS others FROM m JOIN t USING (g, y)
""")
def share_and_crowding(t: Tables):
    m = t.lineitem.groupBy(F.col("l_partkey").alias("e"), F.year("l_shipdate").alias("y"), F.col("l_suppkey").alias("g")).agg(F.sum("l_quantity").alias("s"), F.count(F.lit(1)).alias("n"))
    m = m.withColumn("reg", (F.col("s") / F.col("n") >= 30).cast("long"))
    out = rosters.sum_excluding_self(rosters.sum_excluding_self(m, ["g", "y"], "s", "others"), ["g", "y"], "reg", "crowd")
    return out.select("e", "y", "g", r(F.col("s") / (F.col("s") + F.col("others"))).alias("share"), "crowd", r("others", 2).alias("others"))


@query("roster_panel", "2.4.21, 2.8.53", """
WITH l AS (SELECT o_custkey e, c_nationkey g, year(o_orderdate) y, o_orderdate ev, o_totalprice / 10000 m FROM orders JOIN customer ON c_custkey = o_custkey),
pe AS (SELECT g, y, ev, sum(m) m FROM l GROUP BY 1, 2, 3), pg AS (SELECT g, y, avg(m) gm FROM pe GROUP BY 1, 2),
own AS (SELECT e, g, y, sum(m) / count(*) mpg FROM l GROUP BY 1, 2, 3),
cl AS (SELECT c_custkey e, substr(c_mktsegment, 1, 1) p FROM customer),
crowd AS (SELECT g, y, p, count(*) n FROM own JOIN cl USING (e) WHERE mpg >= 15 GROUP BY 1, 2, 3)
SELECT e, y, own.g, round(mpg / (gm / 5), 6) AS role_share, coalesce(n, 0) - CASE WHEN mpg >= 15 THEN 1 ELSE 0 END AS pos_crowding
FROM own JOIN pg USING (g, y) JOIN cl USING (e) LEFT JOIN crowd USING (g, y, p)
""")
def roster_panel(t: Tables):
    cust = t.customer.select(F.col("c_custkey").alias("e"), F.col("c_nationkey").alias("g"), F.substring("c_mktsegment", 1, 1).alias("pos_group"))
    logs = t.order_events.withColumnRenamed("cust", "e").join(cust.drop("pos_group"), "e").select("e", "g", "y", "d", (F.col("price") / 10000).alias("m"))
    logs = logs.withColumn("ev", F.col("d")).withColumn("fga", F.lit(0.0)).withColumn("oreb", F.lit(0.0)).withColumn("tov", F.lit(0.0)).withColumn("fta", F.lit(0.0))
    out = rosters.roster_panel(logs, cust, Roles("e", "g", "y", "ev", "d"), minutes="m", crowd_mpg=15.0)
    return out.select("e", "y", "g", r("role_share").alias("role_share"), "pos_crowding")


@query("prior_leader_mean", "2.3.34-35, 2.4.53, 2.8.56", """
WITH s AS (SELECT l_suppkey k, year(l_shipdate) y, avg(l_quantity) q FROM lineitem GROUP BY 1, 2)
SELECT k, y, round(q, 6) AS q, count(*) OVER w AS n_prior, round(avg(q) OVER w, 6) AS prior_q FROM s WINDOW w AS (PARTITION BY k ORDER BY y ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
""")
def prior_leader_mean(t: Tables):
    s = t.lineitem.groupBy(F.col("l_suppkey").alias("k"), F.year("l_shipdate").alias("y")).agg(F.avg("l_quantity").alias("q"))
    return rosters.prior_leader_mean(s, ["q"], leader="k", period="y").select("k", "y", r("q").alias("q"), "n_prior", r("prior_q").alias("prior_q"))


@query("group_moves", "2.1.45, 2.3.30, 2.3.42, 2.4.33", """
WITH m AS (SELECT o_custkey c, year(o_orderdate) y, o_orderpriority p, count(*) n, sum(o_totalprice) v FROM orders GROUP BY 1, 2, 3),
p AS (SELECT c, y, p, n, row_number() OVER (PARTITION BY c, y ORDER BY n DESC, p) rn, sum(v) OVER (PARTITION BY c, y) v FROM m),
a AS (SELECT c, y, p, v FROM p WHERE rn = 1),
j AS (SELECT a.p AS old, b.p AS new, a.v FROM a LEFT JOIN a b ON b.c = a.c AND b.y = a.y + 1 WHERE a.y = 1997 AND a.p IS DISTINCT FROM b.p)
SELECT coalesce(o.g, i.g) AS g, round(coalesce(opened, 0), 2) AS opened, round(coalesce(incoming, 0), 2) AS incoming, round(coalesce(opened, 0) - coalesce(incoming, 0), 2) AS net
FROM (SELECT old AS g, sum(v) opened FROM j GROUP BY 1) o FULL JOIN (SELECT new AS g, sum(v) incoming FROM j WHERE new IS NOT NULL GROUP BY 1) i ON o.g = i.g
""")
def group_moves(t: Tables):
    from tallyline.operators.sequences import primary_group
    ev = t.order_events
    home = primary_group(ev, Roles("cust", "o_orderpriority", "y")).join(ev.groupBy("cust", "y").agg(F.sum("price").alias("v")), ["cust", "y"])
    last, now = home.where(F.col("y") == 1997), home.where(F.col("y") == 1998)
    out = rosters.minutes_opened(last, now, entity="cust", group="o_orderpriority", minutes="v")
    return out.select(F.col("o_orderpriority").alias("g"), *[r(c, 2).alias(c) for c in ("opened", "incoming", "net")])


@query("group_moves_by_year", "2.1.45, 2.3.30, 2.3.42, 2.4.33", """
WITH m AS (SELECT o_custkey c, year(o_orderdate) y, o_orderpriority p, count(*) n, sum(o_totalprice) v FROM orders GROUP BY 1, 2, 3),
p AS (SELECT c, y, p, n, row_number() OVER (PARTITION BY c, y ORDER BY n DESC, p) rn, sum(v) OVER (PARTITION BY c, y) v FROM m),
a AS (SELECT c, y, p, v FROM p WHERE rn = 1),
j AS (SELECT a.y + 1 AS y, a.p AS old, b.p AS new, a.v FROM a LEFT JOIN a b ON b.c = a.c AND b.y = a.y + 1 WHERE a.y + 1 IN (SELECT y FROM a) AND a.p IS DISTINCT FROM b.p)
SELECT coalesce(o.y, i.y) AS y, coalesce(o.g, i.g) AS g, round(coalesce(opened, 0), 2) AS opened, round(coalesce(incoming, 0), 2) AS incoming, round(coalesce(opened, 0) - coalesce(incoming, 0), 2) AS net
FROM (SELECT y, old AS g, sum(v) opened FROM j GROUP BY 1, 2) o FULL JOIN (SELECT y, new AS g, sum(v) incoming FROM j WHERE new IS NOT NULL GROUP BY 1, 2) i ON o.g = i.g AND o.y = i.y
""")
def group_moves_by_year(t: Tables):
    from tallyline.operators.sequences import primary_group
    ev = t.order_events
    home = primary_group(ev, Roles("cust", "o_orderpriority", "y")).join(ev.groupBy("cust", "y").agg(F.sum("price").alias("v")), ["cust", "y"])
    last = home.withColumn("y", F.col("y") + 1).join(F.broadcast(ev.select("y").distinct()), "y", "left_semi")   # years
    out = rosters.minutes_opened(last, home, entity="cust", group="o_orderpriority", minutes="v", period="y")
    return out.select("y", F.col("o_orderpriority").alias("g"), *[r(c, 2).alias(c) for c in ("opened", "incoming", "net")])


@query("self_excluded_departures", "2.3.30-33, 2.8.54-55", """
WITH a AS (SELECT o_custkey c, year(o_orderdate) y, arg_max(o_orderpriority, (o_orderdate, o_orderkey)) g, sum(o_totalprice) v FROM orders GROUP BY 1, 2),
m AS (SELECT a.c, a.y + 1 AS y, a.g, a.v FROM a JOIN a b ON b.c = a.c AND b.y = a.y + 1 WHERE a.g <> b.g)
SELECT b.c AS cust, b.y, round(coalesce(l.s, 0) - coalesce(m.v, 0), 2) AS departures_lost
FROM a JOIN a b ON b.c = a.c AND b.y = a.y + 1 LEFT JOIN (SELECT g, y, sum(v) s FROM m GROUP BY 1, 2) l ON l.g = a.g AND l.y = b.y LEFT JOIN m ON m.c = b.c AND m.y = b.y
""")
def self_excluded_departures(t: Tables):
    ev = t.order_events
    a = ev.groupBy("cust", "y").agg(F.max_by("o_orderpriority", F.struct("d", "o_orderkey")).alias("g"), F.sum("price").alias("v"))
    prev = a.select("cust", (F.col("y") + 1).alias("y"), F.col("g").alias("old"), F.col("v").alias("w"))
    rows = a.select("cust", "y", "g").join(prev, ["cust", "y"]).withColumn("left_v", F.when(F.col("old") != F.col("g"), F.col("w")))
    return rosters.sum_excluding_self(rows, ["old", "y"], "left_v", "lost").select("cust", "y", r(F.coalesce("lost", F.lit(0.0)), 2).alias("departures_lost"))


@query("range_join_weeks", "2.3.28, 2.4.12-16, 2.9.15-17", """
WITH days AS (SELECT DISTINCT c_nationkey k, CAST(o_orderdate AS DATE) d, o_orderkey FROM orders JOIN customer ON c_custkey = o_custkey),
b AS (SELECT min(d) lo, max(d) hi FROM days),
w AS (SELECT CAST(row_number() OVER (ORDER BY s) AS INTEGER) AS week, CAST(s AS DATE) s, least(CAST(s AS DATE) + 6, hi) e FROM b, generate_series(lo::TIMESTAMP, hi::TIMESTAMP, INTERVAL 7 DAY) g(s)),
k AS (SELECT DISTINCT k FROM days)
SELECT w.week, k.k AS grp, count(days.d) AS games FROM w CROSS JOIN k LEFT JOIN days ON days.k = k.k AND days.d BETWEEN w.s AND w.e GROUP BY 1, 2
""")
def range_join_weeks(t: Tables):
    days = t.order_events.join(t.customer.select(F.col("c_custkey").alias("cust"), F.col("c_nationkey").alias("grp")), "cust").select("grp", "d", "o_orderkey")
    weeks = calendar.even_weeks(days, "d")
    return calendar.weekly_counts(days, weeks, group="grp", day="d").select("week", "grp", "games")


@query("back_to_backs", "2.5.5, 2.4.16", """
WITH d AS (SELECT DISTINCT user_id, CAST(ts AS DATE) d FROM events)
SELECT user_id, strftime(d, '%Y-%m-%d') AS day, coalesce(d - lag(d) OVER (PARTITION BY user_id ORDER BY d) = 1, false) AS b2b FROM d
""")
def back_to_backs(t: Tables):
    return flag_back_to_backs(t.user_days.select("user_id", "d"), ["user_id"], "d", "d").select("user_id", text_day("d").alias("day"), "b2b")


@query("small_day_threshold", "2.4.12-13", """
WITH n AS (SELECT CAST(ts AS DATE) d, count(DISTINCT user_id) n FROM events GROUP BY 1)
SELECT count(*) AS n_days, CAST(floor(quantile_cont(n, 0.35)) AS BIGINT) AS small_day, count(*) FILTER (WHERE n <= (SELECT floor(quantile_cont(n, 0.35)) FROM n)) AS n_small FROM n
""")
def small_day_threshold(t: Tables):
    n = calendar.events_per_day(t.events.withColumn("d", F.to_date("ts")), "d", "user_id")
    limit = calendar.small_day_limit(n, 0.35)
    return n.withColumn("lim", limit.scalar()).agg(F.count(F.lit(1)).alias("n_days"), F.max("lim").alias("small_day"), F.count_if(F.col("n") <= F.col("lim")).alias("n_small"))


@query("caliper_match", "2.3.9-11", """
WITH c AS (SELECT c_custkey i, c_mktsegment g, c_acctbal x FROM customer WHERE c_acctbal > 6000 AND c_nationkey < 5), p AS (SELECT c_custkey j, c_mktsegment g, c_acctbal x FROM customer WHERE c_nationkey >= 5),
m AS (SELECT i, j, abs(c.x - p.x) AS dist, row_number() OVER (PARTITION BY i ORDER BY round(abs(c.x - p.x), 6), j) rk FROM c JOIN p USING (g) WHERE abs(c.x - p.x) <= 200)
SELECT i AS case_id, j AS control_id, round(dist, 4) AS dist FROM m WHERE rk <= 3
""")
def caliper_match(t: Tables):
    rows = t.customer.select(F.col("c_custkey").alias("id"), F.col("c_mktsegment").alias("g"), F.col("c_acctbal").alias("x"), "c_nationkey")
    cases = rows.where((F.col("x") > 6000) & (F.col("c_nationkey") < 5))
    pool = rows.where(F.col("c_nationkey") >= 5)
    return matching.nearest_controls(cases, pool, group=["g"], value="x", entity="id", k=3, caliper=200.0).select("case_id", "control_id", r("dist", 4).alias("dist"))


@query("leave_one_out_means", "2.4.47, 2.8.132", """
WITH m AS (SELECT year(o_orderdate) y, avg(o_totalprice) v FROM orders GROUP BY 1)
SELECT y, round(v, 4) AS v, round(((SELECT sum(v) FROM m) - v) / ((SELECT count(*) FROM m) - 1), 4) AS loo_mean FROM m
""")
def leave_one_out_means(t: Tables):
    from tallyline.operators.metrics import leave_one_out
    m = t.order_events.groupBy("y").agg(F.avg("price").alias("v"))
    return leave_one_out(m, "v", period="y").select("y", r("v", 4).alias("v"), r("loo_mean", 4).alias("loo_mean"))


@query("self_excluded_mean", "2.3.42, 2.8.118", """
WITH s AS (SELECT c_nationkey g, c_custkey c, c_acctbal v FROM customer), t AS (SELECT g, sum(v) s, count(*) n FROM s GROUP BY 1)
SELECT c AS cust, round((t.s - v) / (n - 1) + 1e-7, 4) AS others_mean FROM s JOIN t USING (g) WHERE n > 1
""")
def self_excluded_mean(t: Tables):
    return rosters.mean_excluding_self(t.customer, ["c_nationkey"], "c_acctbal", "others_mean").where(F.col("others_mean").isNotNull()).select(
        F.col("c_custkey").alias("cust"), r(F.col("others_mean") + 1e-7, 4).alias("others_mean"))


@query("slot_eligibility", "2.2.20-23, 2.2.12, 2.4.80", """
WITH p AS (SELECT c_custkey c, ['G', 'F', 'C', 'G-F', 'F-C', 'PG', 'Guard-Forward', 'x'][CAST(c_nationkey % 8 + 1 AS INTEGER)] AS pos FROM customer)
SELECT pos, CASE pos WHEN 'G' THEN 'PG,SG,G,UTIL' WHEN 'F' THEN 'SF,PF,F,UTIL' WHEN 'C' THEN 'C,UTIL' WHEN 'G-F' THEN 'SG,SF,G,F,UTIL' WHEN 'F-C' THEN 'PF,C,F,UTIL'
       WHEN 'PG' THEN 'PG,G,UTIL' WHEN 'Guard-Forward' THEN 'SG,SF,G,F,UTIL' ELSE 'UTIL' END AS slots,
       CASE pos WHEN 'G' THEN 'G' WHEN 'F' THEN 'F' WHEN 'C' THEN 'C' WHEN 'G-F' THEN 'G' WHEN 'F-C' THEN 'F' WHEN 'PG' THEN 'G' WHEN 'Guard-Forward' THEN 'G' ELSE 'U' END AS grp, count(*) AS n FROM p GROUP BY 1
""")
def slot_eligibility(t: Tables):
    names = F.array(*[F.lit(x) for x in ("G", "F", "C", "G-F", "F-C", "PG", "Guard-Forward", "x")])
    p = t.customer.select(F.element_at(names, (F.col("c_nationkey") % 8 + 1).cast("int")).alias("pos"))
    return p.groupBy("pos").agg(F.count(F.lit(1)).alias("n")).select("pos", F.array_join(eligible_slots(F.col("pos")), ",").alias("slots"), position_group(F.col("pos")).alias("grp"), "n")



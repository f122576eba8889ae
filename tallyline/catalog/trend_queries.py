"""Sequences, absences, recent form, allocation and rest-of-period blends."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyline.catalog.base import Tables, query, r, text_day
from tallyline.operators import folds, inseason, sequences, trends
from tallyline.operators.sequences import Roles

USER = Roles("user_id", "grp", "p", "d", "d")
# the group of a user is its number modulo ten; its schedule is every day on which any member has an event
DAYS_SQL = """WITH days AS (SELECT user_id, user_id % 10 AS grp, CAST(ts AS DATE) d, sum(value) v, count(*) n FROM events GROUP BY 1, 2, 3),
sched AS (SELECT grp, d, row_number() OVER (PARTITION BY grp ORDER BY d) - 1 AS idx, count(*) OVER (PARTITION BY grp) AS len,
          coalesce(d - lag(d) OVER (PARTITION BY grp ORDER BY d) = 1, false) AS b2b FROM (SELECT DISTINCT grp, d FROM days)),
placed AS (SELECT days.user_id, days.grp, sched.idx, sched.len, sched.d, idx - lag(idx) OVER (PARTITION BY user_id ORDER BY idx) - 1 AS gap FROM days JOIN sched USING (grp, d))"""


def presence(t: Tables):
    return t.user_days.select("user_id", (F.col("user_id") % 10).alias("grp"), F.lit(1).alias("p"), "d", "v", "n")


def profile(t: Tables):
    days = presence(t)
    return sequences.absence_profile(days, days.select("grp", "p", "d").distinct(), USER)


@query("lead_block_and_tail", "2.4.26, 2.4.37, 2.3.62, 2.8.133", DAYS_SQL + """
SELECT user_id, count(*) AS gp, any_value(len) AS n_events, min(idx) AS first_idx, any_value(len) - min(idx) AS tail_len, coalesce(max(gap), 0) AS block_len FROM placed GROUP BY 1
""")
def lead_block_and_tail(t: Tables):
    return profile(t).select("user_id", "gp", "n_events", "first_idx", "tail_len", "block_len")


@query("longest_run", "2.5.1-2, 2.5.4, 2.4.25", DAYS_SQL + """,
grid AS (SELECT u.user_id, s.idx, p.user_id IS NULL AS missed FROM (SELECT DISTINCT user_id, grp FROM days) u JOIN sched s USING (grp) LEFT JOIN placed p ON p.user_id = u.user_id AND p.idx = s.idx),
isl AS (SELECT user_id, idx - row_number() OVER (PARTITION BY user_id ORDER BY idx) g, count(*) len FROM (SELECT * FROM grid WHERE missed) GROUP BY user_id, idx, g QUALIFY true),
runs AS (SELECT user_id, g, count(*) len FROM (SELECT user_id, idx - row_number() OVER (PARTITION BY user_id ORDER BY idx) g FROM grid WHERE missed) GROUP BY 1, 2)
SELECT u.user_id, coalesce(max(len), 0) AS longest_run, count(len) AS n_runs, CAST(coalesce(sum(len), 0) AS BIGINT) AS missed FROM (SELECT DISTINCT user_id FROM days) u LEFT JOIN runs USING (user_id) GROUP BY 1
""".replace("isl AS (SELECT user_id, idx - row_number() OVER (PARTITION BY user_id ORDER BY idx) g, count(*) len FROM (SELECT * FROM grid WHERE missed) GROUP BY user_id, idx, g QUALIFY true),\n", ""))
def longest_run(t: Tables):
    return profile(t).select("user_id", "longest_run", "n_runs", "missed")


@query("presence_runs", "2.5.1, 2.10.10", """
WITH d AS (SELECT user_id, CAST(ts AS DATE) d, count(*) n FROM events GROUP BY 1, 2),
busy AS (SELECT user_id, d, d - CAST(row_number() OVER (PARTITION BY user_id ORDER BY d) AS INTEGER) AS g FROM d WHERE n >= 2),
runs AS (SELECT user_id, g, count(*) len FROM busy GROUP BY 1, 2)
SELECT u.user_id, coalesce(max(len), 0) AS longest, count(len) AS n_runs, CAST(coalesce(sum(len), 0) AS BIGINT) AS n_true FROM (SELECT DISTINCT user_id FROM d) u LEFT JOIN runs USING (user_id) GROUP BY 1
""")
def presence_runs(t: Tables):
    days = t.user_days.select("user_id", F.unix_date("d").alias("i"), (F.col("n") >= 2).alias("busy"))
    return sequences.run_stats(days, ["user_id"], "i", "busy")


@query("isolated_absences", "2.5.3, 2.4.23-24, 2.3.66", DAYS_SQL + """
SELECT p.user_id, CAST(coalesce(sum(gap) FILTER (WHERE gap BETWEEN 1 AND 2), 0) AS BIGINT) AS iso_n, count(*) FILTER (WHERE gap BETWEEN 1 AND 2) AS iso_runs,
       count(*) FILTER (WHERE gap = 1 AND s.b2b) AS rest_n FROM placed p LEFT JOIN sched s ON s.grp = p.grp AND s.idx = p.idx - 1 GROUP BY 1
""")
def isolated_absences(t: Tables):
    return profile(t).select("user_id", "iso_n", "iso_runs", "rest_n")


@query("share_since_first", "2.5.10", DAYS_SQL + """
SELECT u.user_id, round(least(1.0, n_in / count(s.d)), 6) AS share FROM (SELECT user_id, grp, min(d) f, count(*) n_in FROM days GROUP BY 1, 2) u JOIN sched s ON s.grp = u.grp AND s.d >= u.f GROUP BY u.user_id, n_in
""")
def share_since_first(t: Tables):
    days = presence(t)
    return sequences.share_since_first(days, days.select("grp", "p", "d").distinct(), USER).select("user_id", r("share").alias("share"))


@query("trend_flags", "2.5.6, 2.4.88", """
WITH d AS (SELECT user_id, CAST(ts AS DATE) d, sum(value) v, count(*) n FROM events GROUP BY 1, 2), k AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY d DESC) b FROM d),
a AS (SELECT user_id, avg(v) FILTER (WHERE b <= 5) rm, avg(v) FILTER (WHERE b > 5) bm, stddev_samp(v) FILTER (WHERE b > 5) sd, count(*) FILTER (WHERE b <= 5) nr, count(*) FILTER (WHERE b > 5) nb FROM k GROUP BY 1)
SELECT user_id, nr AS n_recent, nb AS n_base, round(rm - bm, 4) AS v_delta, round((rm - bm) / (greatest(coalesce(sd, 3), 3) / sqrt(nr)), 4) AS v_z,
       rm - bm >= 3 AND (rm - bm) / (greatest(coalesce(sd, 3), 3) / sqrt(nr)) >= 1.5 AS rising_v FROM a WHERE nb >= 8
""")
def trend_flags(t: Tables):
    out = trends.rising(trends.recent_against_base(t.user_days, "user_id", ["d"], ["v"]), "v", trends.MIN_DELTA)
    return out.select("user_id", "n_recent", "n_base", r("v_delta", 4).alias("v_delta"), r("v_z", 4).alias("v_z"), "rising_v")


@query("absent_streak", "2.5.7, 2.9.7", DAYS_SQL + """,
u AS (SELECT user_id, grp, avg(v) mpg, count(*) gp, max(d) last FROM days GROUP BY 1, 2 HAVING avg(v) >= 18 AND count(*) >= 8)
SELECT u.user_id, u.grp, gp, count(*) AS streak, count(*) >= 10 AS long_term FROM u JOIN sched s ON s.grp = u.grp AND s.d > u.last GROUP BY 1, 2, 3
""")
def absent_streak(t: Tables):
    days = presence(t)
    return trends.absent_entities(days, days.select("grp", "p", "d").distinct(), USER, minutes="v").select("user_id", "grp", "gp", "streak", "long_term")


@query("with_without", "2.5.8, 2.9.5", DAYS_SQL + """,
f AS (SELECT user_id, grp, min(d) f FROM days GROUP BY 1, 2),
g AS (SELECT f.user_id AS o, s.grp, s.d, days.user_id IS NOT NULL AS inn FROM f JOIN sched s ON s.grp = f.grp AND s.d >= f.f LEFT JOIN days ON days.user_id = f.user_id AND days.d = s.d),
n AS (SELECT o, count(*) FILTER (WHERE NOT inn) n_out FROM g GROUP BY 1 HAVING count(*) FILTER (WHERE NOT inn) >= 3 AND count(*) FILTER (WHERE inn) >= 3),
p AS (SELECT g.o, days.user_id AS m, any_value(n_out) n_out, avg(v) FILTER (WHERE NOT inn) a, avg(v) FILTER (WHERE inn) b, count(*) FILTER (WHERE NOT inn) ka, count(*) FILTER (WHERE inn) kb
      FROM g JOIN n USING (o) JOIN days ON days.grp = g.grp AND days.d = g.d AND days.user_id <> g.o GROUP BY 1, 2)
SELECT o AS out_id, m AS mate_id, n_out, round(a - b + 1e-7, 4) AS observed_gain FROM p WHERE ka >= 2 AND kb >= 3
""")
def with_without(t: Tables):
    days = presence(t).withColumn("e", F.concat_ws("|", "grp", "d"))
    roles = Roles("user_id", "grp", "p", "e", "d")
    out = trends.with_without(days, days.select("grp", "p", "e", "d").distinct(), days.select("user_id", "grp").distinct(), roles, minutes="v")
    return out.select("out_id", "mate_id", "n_out", r(F.col("observed_gain") + 1e-7, 4).alias("observed_gain"))


@query("trailing_10_baseline", "2.5.9", """
WITH d AS (SELECT user_id, CAST(ts AS DATE) d, sum(value) v FROM events GROUP BY 1, 2)
SELECT user_id, strftime(d, '%Y-%m-%d') AS day, round(v, 2) AS v, CASE WHEN count(*) OVER w >= 5 THEN round(avg(v) OVER w + 1e-7, 4) END AS base_v
FROM d WINDOW w AS (PARTITION BY user_id ORDER BY d ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING)
""")
def trailing_10_baseline(t: Tables):
    out = trends.trailing_baseline(t.user_days, "user_id", ["d"], ["v"])
    return out.select("user_id", text_day("d").alias("day"), r("v", 2).alias("v"), r(F.col("base_v") + 1e-7, 4).alias("base_v"))


@query("missing_regulars", "2.5.9, 2.8.158", DAYS_SQL + """,
g AS (SELECT u.user_id, s.grp, s.idx, s.d, days.v FROM (SELECT DISTINCT user_id, grp FROM days) u JOIN sched s USING (grp) LEFT JOIN days ON days.user_id = u.user_id AND days.d = s.d),
t AS (SELECT *, count(v) OVER w AS app, sum(v) OVER w / nullif(count(v) OVER w, 0) AS tr FROM g WINDOW w AS (PARTITION BY user_id ORDER BY idx ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING))
SELECT grp, strftime(d, '%Y-%m-%d') AS day, round(sum(tr) + 1e-7, 4) AS miss_min, count(*) AS n_missing FROM t WHERE idx >= 10 AND app >= 4 AND tr >= 15 AND v IS NULL GROUP BY 1, 2
""")
def missing_regulars(t: Tables):
    days = presence(t)
    out = trends.missing_regulars(days, days.select("grp", "p", "d").distinct(), USER, minutes="v", min_app=4)
    return out.select("grp", text_day("d").alias("day"), r(F.col("miss_min") + 1e-7, 4).alias("miss_min"), "n_missing")


@query("forward_7_day_mean", "2.3.29", """
WITH d AS (SELECT user_id, CAST(ts AS DATE) d, sum(value) v FROM events GROUP BY 1, 2)
SELECT user_id, strftime(d, '%Y-%m-%d') AS day, round(avg(v) OVER (PARTITION BY user_id ORDER BY d RANGE BETWEEN CURRENT ROW AND INTERVAL 6 DAY FOLLOWING) + 1e-7, 4) AS forward_mean FROM d
""")
def forward_7_day_mean(t: Tables):
    return trends.forward_mean(t.user_days, "user_id", "d", "v").select("user_id", text_day("d").alias("day"), r(F.col("forward_mean") + 1e-7, 4).alias("forward_mean"))


@query("mean_of_last_events", "2.4.34", """
SELECT user_id, round(avg(value) + 1e-7, 4) AS last5 FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC) rn FROM events) WHERE rn <= 5 GROUP BY 1
""")
def mean_of_last_events(t: Tables):
    return trends.mean_of_last(t.events, ["user_id"], ["ts"], "value", 5, "m").select("user_id", r(F.col("m") + 1e-7, 4).alias("last5"))


@query("water_fill", "2.9.3-4", """
WITH m AS (SELECT l_orderkey o, l_linenumber n, sum(l_quantity) q, sum(l_extendedprice) e FROM lineitem GROUP BY 1, 2),
b AS (SELECT o, n, greatest(36 - q, 0) room, greatest(36 - q, 0) * (CASE WHEN n % 2 = 0 THEN 1.5 ELSE 1.0 END) w, sum(e) OVER (PARTITION BY o) / 5000 freed FROM m),
r1 AS (SELECT *, least(coalesce(w / nullif(sum(w) OVER (PARTITION BY o), 0) * freed, 0), room) AS g1 FROM b),
r1b AS (SELECT o, n, room, w, coalesce(g1, 0) g, freed - sum(coalesce(g1, 0)) OVER (PARTITION BY o) AS l FROM r1),
r2 AS (SELECT *, CASE WHEN room - g > 1e-9 AND l > 1e-9 THEN w ELSE 0 END AS a FROM r1b),
r2b AS (SELECT o, n, room, w, g + least(coalesce(a / nullif(sum(a) OVER (PARTITION BY o), 0) * l, 0), room - g) AS g2, g, l FROM r2),
r2c AS (SELECT o, n, room, w, g2 AS g, l - sum(g2 - g) OVER (PARTITION BY o) AS l FROM r2b),
r3 AS (SELECT *, CASE WHEN room - g > 1e-9 AND l > 1e-9 THEN w ELSE 0 END AS a FROM r2c),
r3b AS (SELECT o, n, room, w, g + least(coalesce(a / nullif(sum(a) OVER (PARTITION BY o), 0) * l, 0), room - g) AS g2, g, l FROM r3),
r3c AS (SELECT o, n, room, w, g2 AS g, l - sum(g2 - g) OVER (PARTITION BY o) AS l FROM r3b),
r4 AS (SELECT *, CASE WHEN room - g > 1e-9 AND l > 1e-9 THEN w ELSE 0 END AS a FROM r3c),
r4b AS (SELECT o, n, room, w, g + least(coalesce(a / nullif(sum(a) OVER (PARTITION BY o), 0) * l, 0), room - g) AS g2, g, l FROM r4),
r4c AS (SELECT o, n, room, w, g2 AS g, l - sum(g2 - g) OVER (PARTITION BY o) AS l FROM r4b),
r5 AS (SELECT *, CASE WHEN room - g > 1e-9 AND l > 1e-9 THEN w ELSE 0 END AS a FROM r4c)
SELECT o, n, round(g + least(coalesce(a / nullif(sum(a) OVER (PARTITION BY o), 0) * l, 0), room - g) + 1e-7, 4) AS gain FROM r5
""")
def water_fill(t: Tables):
    m = t.lineitem.groupBy(F.col("l_orderkey").alias("o"), F.col("l_linenumber").alias("n")).agg(F.sum("l_quantity").alias("q"), F.sum("l_extendedprice").alias("e"))
    freed = m.groupBy("o").agg((F.sum("e") / 5000).alias("freed"))
    rows = m.join(freed, "o").withColumn("room", F.greatest(36 - F.col("q"), F.lit(0.0)))
    rows = rows.withColumn("w", F.col("room") * F.when(F.col("n") % 2 == 0, 1.5).otherwise(1.0))
    return trends.allocate(rows, ["o"], freed="freed", room="room", weight="w").select("o", "n", r(F.col("gain") + 1e-7, 4).alias("gain"))


@query("posterior_blend", "2.9.1, 2.9.8, 2.2.46, 2.8.7", """
WITH p AS (SELECT o_custkey c, count(*) n, avg(o_totalprice) m FROM orders WHERE year(o_orderdate) = 1997 GROUP BY 1),
s AS (SELECT o_custkey c, count(*) n, avg(o_totalprice) m FROM orders WHERE o_orderdate BETWEEN DATE '1998-01-01' AND DATE '1998-06-30' GROUP BY 1)
SELECT coalesce(p.c, s.c) AS cust, coalesce(s.n, 0) AS n_to_date, round(CASE WHEN s.n IS NULL THEN coalesce(p.m, 100000) ELSE (5 * coalesce(p.m, 100000) + s.n * s.m) / (5 + s.n) END + 1e-7, 4) AS ros_mean,
       round(coalesce(s.n, 0) / (5.0 + coalesce(s.n, 0)), 6) AS w_sample
FROM p FULL JOIN s ON p.c = s.c
""")
def posterior_blend(t: Tables):
    ev = t.order_events
    prior = ev.where(F.col("y") == 1997).groupBy("cust").agg(F.avg("price").alias("prior_mean"))
    now = ev.where(F.col("d").between(F.lit("1998-01-01").cast("date"), F.lit("1998-06-30").cast("date"))).groupBy("cust").agg(F.count(F.lit(1)).alias("n_to_date"), F.avg("price").alias("sample_mean"))
    out = inseason.blend(prior, now, ["cust"], prior="prior_mean", sample="sample_mean", n="n_to_date", pseudo=5.0, weak_prior=100000.0, name="ros_mean")
    return out.select("cust", "n_to_date", r(F.col("ros_mean") + 1e-7, 4).alias("ros_mean"), r("w_sample").alias("w_sample"))


@query("state_fold", "2.3.36-37, 2.3.93, 2.8.64", """
WITH RECURSIVE e AS (SELECT user_id u, event_id, event_type k, CAST(floor(value) AS INTEGER) % 5 + 1 AS yrs, CAST(ts AS DATE) - DATE '2024-01-01' AS day,
    row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) i FROM events),
w AS (
  SELECT u, i, CASE WHEN k IN ('signup', 'purchase') THEN day + yrs - 1 END AS fin, k IN ('signup', 'purchase') AS have, k IN ('signup', 'purchase') AS active, k = 'purchase' AS ext FROM e WHERE i = 1
  UNION ALL
  SELECT e.u, e.i, CASE WHEN k = 'signup' THEN day + yrs - 1 WHEN k = 'purchase' THEN (CASE WHEN w.active AND w.fin IS NOT NULL THEN greatest(w.fin, day) ELSE day END) + yrs ELSE w.fin END,
         w.have OR k IN ('signup', 'purchase'), CASE WHEN k IN ('signup', 'purchase') THEN true WHEN k = 'error' AND w.have THEN false WHEN k = 'click' AND w.have THEN true ELSE w.active END,
         CASE WHEN k IN ('signup', 'purchase') THEN k = 'purchase' ELSE w.ext END
  FROM w JOIN e ON e.u = w.u AND e.i = w.i + 1),
l AS (SELECT u, max(i) i FROM e GROUP BY 1)
SELECT u AS user_id, CASE WHEN NOT have THEN 'unknown' WHEN NOT active OR fin < 28 THEN 'lapsed' ELSE 'known' END AS status, CASE WHEN have AND active AND fin >= 28 THEN fin - 28 + 1 END AS remaining,
       CASE WHEN have AND active AND fin >= 28 THEN ext ELSE false END AS extension FROM w JOIN l USING (u, i)
""".replace("CASE WHEN k IN ('signup', 'purchase') THEN day + yrs - 1 END AS fin,", "CASE WHEN k = 'signup' THEN day + yrs - 1 WHEN k = 'purchase' THEN day + yrs END AS fin,"))
def state_fold(t: Tables):
    e = t.events.select("user_id", "event_id", "event_type", "ts", (F.floor("value").cast("int") % 5 + 1).alias("yrs"),
                        F.datediff(F.to_date("ts"), F.lit("2024-01-01").cast("date")).alias("day"))
    kind = F.when(F.col("event_type") == "signup", "deal").when(F.col("event_type") == "purchase", "extension").when(F.col("event_type") == "error", "end").when(F.col("event_type") == "click", "resume")
    return folds.deal_state(e.withColumn("kind", kind), "user_id", order=["ts", "event_id"], kind="kind", start="day", length="yrs", at=28).select("user_id", "status", "remaining", "extension")


@query("weekly_tumbling", "2.10.8-9, 2.4.12", """
SELECT strftime(CAST(DATE '1970-01-01' + CAST(floor(date_diff('day', DATE '1970-01-01', CAST(ts AS DATE)) / 7) * 7 AS INTEGER) AS DATE), '%Y-%m-%d') AS week_start, event_type, count(*) AS n, round(sum(value), 2) AS v
FROM events GROUP BY 1, 2
""")
def weekly_tumbling(t: Tables):
    from tallyline.streaming.windows import tumbling_counts
    out = tumbling_counts(t.events.withColumn("ts", F.col("ts").cast("timestamp")), "ts", ["event_type"], "7 days", value="value", watermark=None)
    return out.select(text_day("start").alias("week_start"), "event_type", "n", r("v", 2).alias("v"))


@query("session_runs", "2.10.10", """
WITH e AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) <= INTERVAL 8 HOUR THEN 0 ELSE 1 END AS fresh FROM events),
s AS (SELECT user_id, ts, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) sid FROM e)
SELECT user_id, n_sessions, longest FROM (SELECT user_id, count(*) n_sessions, max(n) longest FROM (SELECT user_id, sid, count(*) n FROM s GROUP BY 1, 2) GROUP BY 1)
""")
def session_runs(t: Tables):
    from tallyline.streaming.windows import sessions
    s = sessions(t.events.withColumn("ts", F.col("ts").cast("timestamp")), "ts", ["user_id"], "8 hours", watermark=None)
    return s.groupBy("user_id").agg(F.count(F.lit(1)).alias("n_sessions"), F.max("n").alias("longest"))

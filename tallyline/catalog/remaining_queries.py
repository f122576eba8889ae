"""The rest of every year from several cutoffs, for customers in nations."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyline.catalog.base import Tables, query, r
from tallyline.operators import remaining
from tallyline.session import cut_lineage

CUTOFFS, LENGTH, TOP, MIN_GAMES, POOL = [4, 12, 30], 60.0, 300, 3, 100
SETTINGS = remaining.grid_settings((20.0, 60.0), (2.0, 6.0), (5.0, 30.0), (2.0, 6.0))
BLENDS = [s.name for s in SETTINGS if s.mode == remaining.BLEND]
ROLES = dict(period="y", entity="e", group="g", day="d")


def seasons(t: Tables):
    """Every year and cutoff: all customers with an order that year or the year before, whose mean is the prior."""
    home = t.customer.select(F.col("c_custkey").alias("e"), F.col("c_nationkey").alias("g"))
    ev = t.orders.select(F.year("o_orderdate").alias("y"), F.col("o_custkey").alias("e"), F.to_date("o_orderdate").alias("d"), F.col("o_orderkey").alias("k"), (10 + F.col("o_orderkey") % 20).cast("double").alias("m"), (F.col("o_totalprice") / 10000).alias("v")).join(home, "e")
    cuts = cut_lineage(remaining.cutoff_days(ev, CUTOFFS, period="y", group="g", day="d"))
    prior = ev.groupBy((F.col("y") + 1).alias("y"), "e").agg(F.avg("m").alias("prior_minutes"), F.avg("v").alias("prior_rate"), (F.count(F.lit(1)) * 5.0).alias("prior_games"))
    seen = remaining.before_and_after(ev, cuts, event="k", minutes="m", value="v", **ROLES)
    progress = remaining.group_progress(ev, cuts, period="y", group="g", day="d")
    df = remaining.with_priors(seen, prior, prior.select("y", "e").union(ev.select("y", "e")).distinct().join(home, "e"), progress, period="y", entity="e", group="g", length=LENGTH)
    return remaining.in_universe(df, period="y", entity="e", length=LENGTH, top=TOP, min_games=MIN_GAMES)


def pseudo(name: str) -> str:
    return "VALUES " + ", ".join(f"('{s.name}', '{s.mode}', {s.minutes_pseudo}::DOUBLE, {s.games_pseudo}::DOUBLE, {s.share_pseudo}::DOUBLE, {s.rate_pseudo}::DOUBLE)" for s in SETTINGS) + f") {name}(setting, mode, pm, pg, ps, pr)"


SEASONS = """
WITH ev AS (SELECT year(o_orderdate) y, o_custkey e, CAST(o_orderdate AS DATE) d, o_orderkey k, (10 + o_orderkey % 20)::DOUBLE m, o_totalprice / 10000 AS v, c_nationkey g FROM orders JOIN customer ON c_custkey = o_custkey),
gd AS (SELECT y, g, d, row_number() OVER (PARTITION BY y, g ORDER BY d) k, count(*) OVER (PARTITION BY y, g) n FROM (SELECT DISTINCT y, g, d FROM ev)),
c AS (SELECT y, k AS cutoff, DATE '1970-01-01' + floor(median(d - DATE '1970-01-01'))::INT AS cd FROM gd WHERE k IN (4, 12, 30) GROUP BY y, k HAVING k < (SELECT min(n) FROM gd x WHERE x.y = gd.y)),
pr AS (SELECT y + 1 AS y, e, avg(m) pm, avg(v) pv, count(*) * 5.0::DOUBLE pg FROM ev GROUP BY 1, 2),
se AS (SELECT ev.y, cutoff, e, count(*) FILTER (d <= cd) gp, coalesce(sum(m) FILTER (d <= cd), 0) mi, coalesce(sum(v) FILTER (d <= cd), 0) fp, count(*) FILTER (d > cd) ag, coalesce(sum(v) FILTER (d > cd), 0) aft FROM ev JOIN c USING (y) GROUP BY ALL),
go AS (SELECT gd.y, cutoff, g, count(*) FILTER (d <= cd)::DOUBLE played, count(*) FILTER (d > cd)::DOUBLE AS lef FROM gd JOIN c USING (y) GROUP BY ALL),
ev2 AS (SELECT y, cutoff, e, coalesce(gp, 0)::DOUBLE gp, coalesce(mi, 0) mi, coalesce(fp, 0) fp, coalesce(ag, 0)::DOUBLE ag, coalesce(aft, 0) AS aft, pm, pv, pg, pm IS NOT NULL AS has FROM se FULL JOIN (SELECT * FROM pr JOIN c USING (y)) USING (y, cutoff, e)),
us AS (SELECT y, cutoff, max(played) most, median(lef) usual FROM go GROUP BY 1, 2),
q AS (SELECT ev2.*, coalesce(played, most) played, coalesce(lef, usual) lef, CASE WHEN has THEN pv / pm ELSE 0.45 END::DOUBLE ppm, CASE WHEN has THEN pm ELSE 12 END::DOUBLE pmi, CASE WHEN has THEN least(pg / 60, 1) ELSE 0.55 END::DOUBLE psh,
       CASE WHEN has THEN pv ELSE 0.45 * 12 END::DOUBLE prt FROM ev2 JOIN customer ON c_custkey = e JOIN us USING (y, cutoff) LEFT JOIN go ON go.y = ev2.y AND go.cutoff = ev2.cutoff AND go.g = c_nationkey),
u AS (SELECT *, (has AND row_number() OVER (PARTITION BY y, cutoff ORDER BY CASE WHEN has THEN prt * psh * 60 END DESC NULLS LAST, e) <= 300) OR gp >= 3 AS scored, CASE WHEN mi > 0 THEN fp / mi ELSE ppm END AS spm, CASE WHEN gp > 0 THEN mi / gp ELSE pmi END AS smi,
       CASE WHEN gp > 0 THEN fp / gp ELSE prt END AS srt, CASE WHEN played > 0 THEN least(gp / greatest(played, 1), 1) ELSE psh END AS ssh FROM q),
s AS (SELECT * FROM (""" + pseudo("s") + """),
r AS (SELECT u.*, setting, mode, CASE mode WHEN 'prior' THEN prt WHEN 'sample' THEN srt WHEN 'blend' THEN (s.pm * ppm + mi * spm) / (s.pm + mi) * (s.pg * pmi + gp * smi) / (s.pg + gp) ELSE (s.pr * prt + gp * srt) / (s.pr + gp) END AS rate,
       least(greatest(CASE mode WHEN 'prior' THEN psh WHEN 'sample' THEN ssh ELSE (s.ps * psh + played * ssh) / (s.ps + played) END, 0), 1) * lef AS games FROM u, s),
t AS (SELECT *, rate * games AS total FROM r),
k AS (SELECT *, rank() OVER (PARTITION BY y, cutoff, setting ORDER BY total) + (count(*) OVER (PARTITION BY y, cutoff, setting, total) - 1) / 2.0 AS ra, rank() OVER (PARTITION BY y, cutoff, setting ORDER BY aft) + (count(*) OVER (PARTITION BY y, cutoff, setting, aft) - 1) / 2.0 AS rb,
       row_number() OVER (PARTITION BY y, cutoff, setting ORDER BY total DESC, e) AS tp, row_number() OVER (PARTITION BY y, cutoff, setting ORDER BY aft DESC, e) AS tq FROM t WHERE scored),
sc AS (SELECT y, cutoff, setting, count(*) AS n, avg(abs(total - aft)) AS mae_total, avg(abs(rate - aft / ag)) FILTER (ag >= 2) AS mae_rate, corr(ra, rb) AS spearman, count(*) FILTER (tp <= 50 AND tq <= 50) / least(50, count(*))::DOUBLE AS top_share FROM k GROUP BY 1, 2, 3),
pe AS (SELECT y, setting, sum(mae_total) s, count(*) n FROM sc WHERE setting LIKE 'blend%' GROUP BY 1, 2),
ru AS (SELECT y, setting, sum(s) OVER w AS s, sum(n) OVER w AS n, count(*) OVER w AS earlier FROM pe WINDOW w AS (PARTITION BY setting ORDER BY y ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
ch AS (SELECT y, first(setting ORDER BY round(s / n, 9), setting) AS setting, max(earlier) AS earlier FROM ru WHERE n > 0 GROUP BY y)
"""


def scores(t: Tables):
    return remaining.score_settings(remaining.remaining(seasons(t), SETTINGS), period="y", entity="e", top=50, min_after=2)


@query("rest_of_year_scores", "2.8.151-153, 2.8.157, 2.9.1", SEASONS + """
SELECT y, cutoff, setting, n, round(mae_total, 5) AS mae_total, round(mae_rate, 5) AS mae_rate, round(spearman, 5) AS spearman, round(top_share, 5) AS top_share FROM sc
""")
def rest_of_year_scores(t: Tables):
    return scores(t).select("y", "cutoff", "setting", "n", *[r(c, 5).alias(c) for c in ("mae_total", "mae_rate", "spearman", "top_share")])


@query("rest_of_year_choice", "2.8.154-156", SEASONS + """,
m AS (SELECT y, setting, avg(mae_total) AS m FROM sc GROUP BY 1, 2),
g AS (SELECT o.setting AS other, b.m - a.m AS gain FROM ch JOIN m a ON a.y = ch.y AND a.setting = ch.setting JOIN m b ON b.y = ch.y JOIN (SELECT unnest(['prior only', 'sample only']) AS setting) o ON o.setting = b.setting) SELECT g.other, count(*) AS periods, round(avg(gain), 5) AS mean_gain, count(*) FILTER (gain > 0) AS won, (SELECT string_agg(y || ' ' || setting, '; ' ORDER BY y) FROM ch) AS choices FROM g GROUP BY g.other
""")
def rest_of_year_choice(t: Tables):
    found = cut_lineage(scores(t))
    mine = cut_lineage(remaining.chosen_settings(found, BLENDS, period="y"))
    said = mine.agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("y", "setting"))), lambda x: F.concat_ws(" ", x["y"].cast("string"), x["setting"])), "; ").alias("choices"))       # one row per period
    parts = [remaining.paired_settings(found, mine, other, period="y", metric="mae_total").withColumn("other", F.lit(other)) for other in ("prior only", "sample only")]
    out = parts[0].unionByName(parts[1]).where("periods > 0").withColumn("_1", F.lit(1)).join(F.broadcast(said.withColumn("_1", F.lit(1))), "_1")
    return out.select("other", "periods", r("mean_gain", 5).alias("mean_gain"), "won", "choices")


@query("rest_of_year_values", "2.9.1-2", SEASONS + """,
v AS (SELECT y, cutoff, e, total, rate, games, row_number() OVER (PARTITION BY y, cutoff ORDER BY round(total, 6) DESC, e) AS place FROM t WHERE setting = 'blend m60 g6 s30')
SELECT v.y, v.cutoff, v.e, round(v.rate + 1e-7, 5) AS rest_rate, round(v.games + 1e-7, 5) AS rest_games, round(v.total + 1e-7, 5) AS rest_total, round(v.total - coalesce(l.total, 0) + 1e-7, 5) AS value, v.place FROM v LEFT JOIN v l ON l.y = v.y AND l.cutoff = v.cutoff AND l.place = 100
""")
def rest_of_year_values(t: Tables):
    rows = remaining.remaining(seasons(t), [s for s in SETTINGS if s.name == "blend m60 g6 s30"])
    out = remaining.with_value(rows, period="y", entity="e", pool=POOL)
    return out.select("y", "cutoff", "e", *[r(F.col(c) + 1e-7, 5).alias(c) for c in ("rest_rate", "rest_games", "rest_total", "value")], "place")

"""States, descriptors, newcomers and out-of-fold fits over all periods of the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyline.catalog.base import Tables, query, r
from tallyline.operators import folds, newcomers, variants


def user_steps(t: Tables):
    """Every user's events as dated steps; what happens on a day is known the day after."""
    kind = F.when(F.col("event_type") == "signup", "deal").when(F.col("event_type") == "purchase", "extension").when(F.col("event_type") == "error", "end").when(F.col("event_type") == "click", "resume")
    day = F.datediff(F.to_date("ts"), F.lit("2024-01-01").cast("date"))
    return t.events.select("user_id", "event_id", "ts", kind.alias("kind"), day.alias("day"), (day + 1).alias("known"), (F.floor("value").cast("int") % 5 + 1).alias("yrs"))


@query("states_every_day", "2.3.77", """
WITH RECURSIVE e AS (SELECT user_id u, event_type k, CAST(floor(value) AS INTEGER) % 5 + 1 AS yrs, CAST(ts AS DATE) - DATE '2024-01-01' AS day,
    row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) i FROM events WHERE user_id IS NOT NULL AND event_type IN ('signup', 'purchase', 'error', 'click')),
w AS (
  SELECT u, i, day, CASE k WHEN 'signup' THEN day + yrs - 1 WHEN 'purchase' THEN day + yrs END AS fin, k IN ('signup', 'purchase') AS have, k IN ('signup', 'purchase') AS active, k = 'purchase' AS ext,
         CASE WHEN k IN ('signup', 'purchase') THEN day END AS cov FROM e WHERE i = 1
  UNION ALL
  SELECT e.u, e.i, e.day, CASE WHEN k = 'signup' THEN e.day + yrs - 1 WHEN k = 'purchase' THEN (CASE WHEN w.active AND w.fin IS NOT NULL THEN greatest(w.fin, e.day) ELSE e.day END) + yrs ELSE w.fin END,
         w.have OR k IN ('signup', 'purchase'), CASE WHEN k IN ('signup', 'purchase') THEN true WHEN k = 'error' AND w.have THEN false WHEN k = 'click' AND w.have THEN true ELSE w.active END,
         CASE WHEN k IN ('signup', 'purchase') THEN k = 'purchase' ELSE w.ext END, CASE WHEN k IN ('signup', 'purchase') THEN e.day ELSE w.cov END
  FROM w JOIN e ON e.u = w.u AND e.i = w.i + 1),
l AS (SELECT u, day, arg_max(fin, i) fin, arg_max(have, i) have, arg_max(active, i) active, arg_max(ext, i) ext, arg_max(cov, i) cov FROM w WHERE fin IS NOT NULL OR NOT have GROUP BY u, day),
d AS (SELECT DISTINCT user_id u, unnest(range(0, (SELECT max(CAST(ts AS DATE)) - DATE '2024-01-01' + 2 FROM events))) AS day FROM events WHERE user_id IS NOT NULL),
a AS (SELECT d.u, d.day, l.fin, coalesce(l.have, false) have, l.active, l.ext, l.cov FROM d ASOF LEFT JOIN l ON d.u = l.u AND d.day > l.day),
s AS (SELECT *, CASE WHEN NOT have THEN 'unknown' WHEN NOT active OR fin < day THEN 'lapsed' ELSE 'known' END AS status FROM a)
SELECT u AS user_id, day, status, CASE WHEN status = 'known' THEN fin - day + 1 END AS remaining, CASE WHEN have THEN fin END AS last_covered, status = 'known' AND cov = day AS new_deal,
       status = 'known' AND ext AS extension, status = 'known' AND ext AND cov >= day - 1 AS recent_extension FROM s
""")
def states_every_day(t: Tables):
    steps = user_steps(t)
    last = steps.agg((F.max("day") + 1).alias("last"))                          # one row
    universe = steps.where("user_id IS NOT NULL").select("user_id").distinct().join(F.broadcast(last)).withColumn("first", F.lit(0))
    intervals = folds.state_intervals(steps, "user_id", order=["ts", "event_id"], kind="kind", start="day", length="yrs", known="known")
    return folds.states(intervals, universe, "user_id", "day")


# ------------------------------------------------------------------------------------------------ newcomers

def yearly_logs(t: Tables):
    """Orders as logs: the first two months of a year are always known ('early'), the next three are the run-up that may be cut ('runup'), the rest is the period itself."""
    month = F.month("o_orderdate")
    return t.orders.select(F.year("o_orderdate").alias("y"), F.col("o_custkey").alias("cust"), F.to_date("o_orderdate").alias("d"), F.col("o_orderkey").alias("game"), (F.col("o_totalprice") / 1000).alias("minutes"),
                           F.when(month <= 2, "early").when(month <= 5, "runup").otherwise("period").alias("context"))


SHARES = [0.0, 0.25, 0.5, 1.0]

LOGS = """
WITH g AS (SELECT year(o_orderdate) y, o_custkey cust, CAST(o_orderdate AS DATE) d, o_orderkey game, o_totalprice / 1000 AS minutes,
    CASE WHEN month(o_orderdate) <= 2 THEN 'early' WHEN month(o_orderdate) <= 5 THEN 'runup' ELSE 'period' END AS context FROM orders),
"""


@query("appearance_evidence", "2.8.29-30", LOGS + """
k AS (SELECT y, d, dense_rank() OVER (PARTITION BY y ORDER BY d) AS place FROM (SELECT DISTINCT y, d FROM g WHERE context = 'runup')),
n AS (SELECT y, max(place) AS days FROM k GROUP BY y), s AS (SELECT unnest([0.0, 0.25, 0.5, 1.0]::DOUBLE[]) AS share),
c AS (SELECT share, g.y, cust, count(DISTINCT game) AS n, sum(minutes) AS m FROM g JOIN k USING (y, d) JOIN n USING (y), s WHERE context = 'runup' AND share > 0 AND place <= greatest(ceil(share * days), 1) GROUP BY ALL),
w AS (SELECT share, y, cust, count(DISTINCT game) AS n, sum(minutes) AS m FROM g, s WHERE context = 'early' GROUP BY ALL)
SELECT share, y, cust, coalesce(c.n, 0) AS cut_games, round(c.m / c.n, 6) AS cut_mean, coalesce(w.n, 0) AS whole_games, round(w.m / w.n, 6) AS whole_mean FROM c FULL JOIN w USING (share, y, cust)
""")
def appearance_evidence(t: Tables):
    out = newcomers.evidence_at_shares(yearly_logs(t), SHARES, period="y", entity="cust", day="d", game="game", minutes="minutes", context="context", cut="runup", whole="early")
    return out.withColumn("cut_mean", r("cut_mean")).withColumn("whole_mean", r("whole_mean"))


@query("runup_share_seen", "2.8.32-33", LOGS + """
n AS (SELECT y, count(DISTINCT d) AS days FROM g WHERE context = 'runup' GROUP BY y),
u AS (SELECT y, days, median(days) OVER (ORDER BY y ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING) AS usual FROM n)
SELECT y, days, round(usual, 6) AS usual_days, round(CASE WHEN usual IS NULL THEN 1.0 ELSE least(1.0, days / usual) END, 6) AS share FROM u
""")
def runup_share_seen(t: Tables):
    out = newcomers.share_seen(yearly_logs(t).where("context = 'runup'"), "y", "d")
    return out.select("y", "days", r("usual_days").alias("usual_days"), r("share").alias("share"))


def appearance_rows(t: Tables):
    """One row per customer and year: evidence before the period, and whether the customer appears in it (all years and customers)."""
    logs = yearly_logs(t)
    ev = newcomers.evidence_at_shares(logs, [1.0], period="y", entity="cust", day="d", game="game", minutes="minutes", context="context", cut="runup", whole="early")
    seen = logs.where("context = 'period'").groupBy("y", "cust").agg(F.lit(1).alias("appeared"))
    every = t.customer.select(F.col("c_custkey").alias("cust"), (1 + F.col("c_custkey") * 7 % 60).alias("slot")).join(F.broadcast(logs.select("y").distinct()))       # one row per year
    rows = every.join(ev, ["y", "cust"], "left").join(seen, ["y", "cust"], "left")
    return rows.select("y", "cust", F.log("slot").alias("log_slot"), F.coalesce("cut_games", F.lit(0)).alias("cut_games"), F.coalesce("cut_mean", F.lit(0.0)).alias("cut_mean"),
                       F.coalesce("whole_games", F.lit(0)).alias("whole_games"), F.coalesce("whole_mean", F.lit(0.0)).alias("whole_mean"), F.coalesce("appeared", F.lit(0)).alias("appeared"))


APPEARANCE = ["log_slot", "cut_games", "cut_mean", "whole_games", "whole_mean"]


@query("appearance_probability", "2.8.31, 2.8.34")
def appearance_probability(t: Tables):
    """The chance to appear in every year from the years before it; tests/test_newcomers.py holds the fits against brute force."""
    rows = appearance_rows(t)
    years = [x["y"] for x in rows.select("y").distinct().collect()]
    fits = newcomers.fold_logits(rows, APPEARANCE, "appeared", "y", years)
    return rows.select("y", "cust", "appeared", r(fits.probability(F.col("y"), low=0.05, high=0.995), 6).alias("p_appear"))


def quarter(day):
    return ((F.year(day) - 1995) * 4 + F.quarter(day) - 1).cast("long")


def newcomer_tables(t: Tables):
    """(rows of entities and quarters, candidates, quarters): a customer is a candidate in its listing quarter if it never ordered before."""
    about = t.customer.select(F.col("c_custkey").alias("e"), F.element_at(F.array(F.lit("stash"), F.lit("undrafted"), F.lit("rookie")), (F.col("c_nationkey") % 3 + 1).cast("int")).alias("klass"),
                              (1 + F.col("c_custkey") * 7 % 60).alias("slot"), (F.col("c_custkey") % 4).alias("years"), (F.col("c_mktsegment") == "BUILDING").alias("foreign"), (F.col("c_custkey") % 12).alias("listed"))
    spans = t.orders.groupBy(F.col("o_custkey").alias("e"), quarter("o_orderdate").alias("q")).agg(F.count(F.lit(1)).alias("games"), (F.avg("o_totalprice") / 1000).alias("rate"))
    first = spans.groupBy("e").agg(F.min("q").alias("fq"))
    listed = about.join(first, "e", "left").where(F.col("fq").isNull() | (F.col("fq") >= F.col("listed"))).withColumnRenamed("listed", "q").drop("fq")
    candidates = listed.join(spans, ["e", "q"], "left").withColumn("played", F.col("games").isNotNull()).withColumn("share", F.col("slot") / 61.0)
    quarters = spans.select("q").union(about.select(F.col("listed"))).distinct()
    return spans.join(about.select("e", "slot"), "e"), candidates, quarters


NEWCOMERS = """
WITH c AS (SELECT c_custkey e, CASE c_nationkey % 3 WHEN 0 THEN 'stash' WHEN 1 THEN 'undrafted' ELSE 'rookie' END klass, 1 + c_custkey * 7 % 60 AS slot, c_custkey % 4 AS years, c_mktsegment = 'BUILDING' AS fo, c_custkey % 12 AS listed FROM customer),
o AS (SELECT o_custkey e, (year(o_orderdate) - 1995) * 4 + quarter(o_orderdate) - 1 AS q, count(*) games, avg(o_totalprice) / 1000 rate FROM orders GROUP BY 1, 2),
f AS (SELECT e, min(q) fq FROM o GROUP BY e),
n AS (SELECT listed AS q, c.e, klass, slot, years, fo, o.games, o.rate, o.games IS NOT NULL AS played FROM c LEFT JOIN f USING (e) LEFT JOIN o ON o.e = c.e AND o.q = listed WHERE fq IS NULL OR fq >= listed),
p AS (SELECT q FROM o UNION SELECT listed FROM c),
s AS (SELECT q, sum(games)::DOUBLE w, sum(games * ln(slot)) x, sum(games * rate) y, sum(games * ln(slot) * ln(slot)) xx, sum(games * ln(slot) * rate) xy FROM o JOIN c USING (e) GROUP BY q),
t AS (SELECT q, sum(w) OVER b w, sum(x) OVER b x, sum(y) OVER b y, sum(xx) OVER b xx, sum(xy) OVER b xy FROM p LEFT JOIN s USING (q) WINDOW b AS (ORDER BY q ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
v AS (SELECT *, CASE WHEN w * xx - x * x > 1e-9 * w * w THEN (w * xy - x * y) / (w * xx - x * x) END AS slope FROM t),
k AS (SELECT q, slope, (y - slope * x) / w AS one FROM v),
d AS (SELECT unnest([0.5, 0.6, 0.7, 0.8, 0.9, 1.0]::DOUBLE[]) AS decay),
l AS (SELECT q, decay, count(*) n, sum(abs(pr - rate)) err, count(*) FILTER (fo) nf, sum(least(games, 30) * rate) FILTER (fo) fy, sum(least(games, 30) * pr) FILTER (fo) fp
      FROM (SELECT n.*, decay, one + slope * ln(61 - (61 - slot) * pow(decay, years)) AS pr FROM n JOIN k USING (q), d WHERE klass = 'stash' AND played) WHERE pr IS NOT NULL GROUP BY ALL),
m AS (SELECT q, decay, coalesce(sum(n) OVER b, 0) n, coalesce(sum(err) OVER b, 0) err, coalesce(sum(nf) OVER b, 0) nf, coalesce(sum(fy) OVER b, 0) fy, coalesce(sum(fp) OVER b, 0) fp
      FROM (SELECT * FROM p, d) LEFT JOIN l USING (q, decay) WINDOW b AS (PARTITION BY decay ORDER BY q ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
b AS (SELECT q, max(n) n_stash, max(err / nullif(n, 0)) FILTER (decay = 1) loss_plain, min(err / nullif(n, 0)) loss_best, first(decay ORDER BY err / nullif(n, 0), decay DESC) AS best FROM m GROUP BY q),
a AS (SELECT q, n_stash, loss_plain, loss_best, CASE WHEN n_stash >= 10 AND (loss_plain - loss_best) / nullif(loss_plain, 0) >= 0.01 THEN best ELSE 1.0 END AS decay FROM b),
u AS (SELECT q, count(*) camp, count(*) FILTER (played) ever, count(*) FILTER (ok) m, sum(least(games, 30)) FILTER (ok) w, sum(least(games, 30) * rate) FILTER (ok) wy, sum(least(games, 30) * pr) FILTER (ok) wp, sum(pr) FILTER (ok) p,
             sum(games / 10.0::DOUBLE) FILTER (ok) g FROM (SELECT *, played AND pr IS NOT NULL AS ok FROM (SELECT n.*, one + slope * ln(61) AS pr FROM n JOIN k USING (q) WHERE klass = 'undrafted')) GROUP BY q),
z AS (SELECT q, coalesce(sum(camp) OVER b, 0) camp, coalesce(sum(ever) OVER b, 0) ever, coalesce(sum(m) OVER b, 0)::DOUBLE m, coalesce(sum(w) OVER b, 0)::DOUBLE w, coalesce(sum(wy) OVER b, 0) wy, coalesce(sum(wp) OVER b, 0) wp,
             coalesce(sum(u.p) OVER b, 0) pr, coalesce(sum(g) OVER b, 0) g FROM p LEFT JOIN u USING (q) WINDOW b AS (ORDER BY q ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
x AS (SELECT a.q, n_stash, a.decay, loss_plain, loss_best, CASE WHEN n_stash >= 10 AND nf >= 3 THEN (nf * fy / fp + 25) / (nf + 25) ELSE 1.0 END AS foreign_scale, z.m::BIGINT AS n_undrafted,
             CASE WHEN z.m >= 10 THEN (wy / w * z.m + 25 * pr / z.m) / (wp / w * z.m + 25 * pr / z.m) ELSE 1.0 END AS scale, CASE WHEN z.m >= 10 THEN (g + 25 * 0.25) / (z.m + 25) ELSE 0.25 END AS game_share, ever / nullif(camp, 0) AS played_share
      FROM a JOIN m ON m.q = a.q AND m.decay = a.decay JOIN z ON z.q = a.q)
"""
LENGTH = 10.0


@query("newcomer_multipliers", "2.8.37", NEWCOMERS + """
SELECT q, n_stash::BIGINT AS n_stash, decay, round(loss_plain, 6) AS loss_plain, round(loss_best, 6) AS loss_best, round(foreign_scale, 6) AS foreign_scale, n_undrafted, round(scale, 6) AS scale, round(game_share, 6) AS game_share, round(played_share, 6) AS played_share FROM x
""")
def newcomer_multipliers(t: Tables):
    rows, candidates, quarters = newcomer_tables(t)
    curves = newcomers.slot_curves(rows, quarters, period="q", slot="slot", y="rate", w="games")
    out = newcomers.class_multipliers(candidates, curves, period="q", length=LENGTH)
    return out.select("q", "n_stash", "decay", "n_undrafted", *[r(c).alias(c) for c in ("loss_plain", "loss_best", "foreign_scale", "scale", "game_share", "played_share")])


@query("newcomer_projection", "2.8.38-39, 2.8.45", NEWCOMERS + """,
r AS (SELECT n.q, e, klass, greatest((one + slope * ln(CASE WHEN klass = 'stash' THEN 61 - (61 - slot) * pow(decay, years) ELSE 61 END)) * CASE WHEN klass <> 'stash' THEN scale WHEN fo THEN foreign_scale ELSE 1 END, 0) AS rate,
             least(greatest(CASE WHEN klass = 'stash' THEN 0.5 ELSE coalesce(played_share, 0.3) END, 0.02), 0.98) AS p_play, CASE WHEN klass = 'stash' THEN least(greatest(slot / 61.0, 0.02), 0.985) ELSE game_share END AS share
      FROM n JOIN k USING (q) JOIN x USING (q) WHERE klass <> 'rookie'),
h AS (SELECT q + 1 AS q, e, rate, games::DOUBLE AS games FROM o)
SELECT q, e, 'veteran' AS projection_class, round(rate, 6) AS rate, games, round(rate * games, 5) AS total, NULL::DOUBLE AS p_play FROM h UNION ALL
SELECT q, e, klass, round(rate, 6), round(10 * least(greatest(p_play * share, 0.005), 0.985), 6), round(rate * 10 * least(greatest(p_play * share, 0.005), 0.985), 5), round(p_play, 6) FROM r WHERE NOT EXISTS (FROM h WHERE h.q = r.q AND h.e = r.e)
""")
def newcomer_projection(t: Tables):
    rows, candidates, quarters = newcomer_tables(t)
    curves = newcomers.slot_curves(rows, quarters, period="q", slot="slot", y="rate", w="games")
    learned = newcomers.class_multipliers(candidates, curves, period="q", length=LENGTH)
    made = newcomers.newcomer_rows(candidates.where("klass <> 'rookie'"), curves, learned, period="q", entity="e", length=LENGTH)
    before = rows.select((F.col("q") + 1).alias("q"), "e", "rate", F.col("games").cast("double").alias("games"), (F.col("rate") * F.col("games")).alias("total"))
    out = newcomers.with_newcomers(before, made, period="q", entity="e")
    return out.select("q", "e", "projection_class", r("rate").alias("rate"), r("games").alias("games"), r("total", 5).alias("total"), r("p_play").alias("p_play"))


# ------------------------------------------------------------------------------------------------ regressions of all periods

def yearly_rates(t: Tables):
    """One row per customer and year: mean price, orders, and facts that were known before; the size of every third customer is not."""
    about = t.customer.select(F.col("c_custkey").alias("e"), F.log(1 + F.col("c_custkey") * 7 % 60).alias("log_slot"), (F.col("c_nationkey") % 3 == 0).cast("double").alias("stash"), (F.col("c_nationkey") % 3 == 1).cast("double").alias("undrafted"),
                              (F.col("c_custkey") % 11).cast("double").alias("era"), (F.col("c_mktsegment") == "BUILDING").cast("double").alias("foreign"), (F.col("c_mktsegment") == "MACHINERY").cast("double").alias("other"),
                              F.when(F.col("c_custkey") % 3 > 0, F.col("c_acctbal") / 1000).alias("size"), F.col("c_custkey"))
    rates = t.orders.groupBy(F.year("o_orderdate").alias("y"), F.col("o_custkey").alias("e")).agg(F.count(F.lit(1)).alias("w"), (F.avg("o_totalprice") / 1000).alias("rate"), (F.sum("o_totalprice") / 1000).alias("total"))
    return rates.join(about, "e")


BASE = ["log_slot", "stash", "undrafted", "era"]
SIZE = [variants.KNOWN + "size", variants.FILLED + "size"]
VARIANTS = {"base": BASE, "origin": BASE + ["foreign", "other"], "combine": BASE + SIZE, "both": BASE + ["foreign", "other"] + SIZE}


def solved(width: int) -> str:
    """CTEs ``g`` and ``z``: solutions of the systems in ``q`` (any keys, n, k = 1, m: rows of n + 1 numbers) by elimination, in the last column."""
    return f"""
g AS (SELECT * FROM q UNION ALL SELECT * REPLACE (k + 1 AS k, list_transform(m, lambda row, i: CASE WHEN i = k THEN list_transform(row, lambda v: v / row[k]) ELSE list_transform(row, lambda v, j: v - row[k] * m[k][j] / m[k][k]) END) AS m) FROM g WHERE k <= n),
z AS (SELECT * EXCLUDE (m, k), list_transform(m, lambda row: row[n + 1]) AS beta FROM g WHERE k = n + 1 AND n <= {width})
"""


RATES = """
WITH RECURSIVE r AS (SELECT year(o_orderdate) y, o_custkey e, count(*)::DOUBLE w, avg(o_totalprice) / 1000 v, sum(o_totalprice) / 1000 total FROM orders GROUP BY 1, 2),
x AS (SELECT y, e, w, v, total, ln(1 + c_custkey * 7 % 60) ls, (c_nationkey % 3 = 0)::INT::DOUBLE st, (c_nationkey % 3 = 1)::INT::DOUBLE un, (c_custkey % 11)::DOUBLE era, (c_mktsegment = 'BUILDING')::INT::DOUBLE fo, (c_mktsegment = 'MACHINERY')::INT::DOUBLE ma,
             CASE WHEN c_custkey % 3 > 0 THEN c_acctbal / 1000 END sz FROM r JOIN customer ON e = c_custkey),
t AS (SELECT DISTINCT y AS t FROM x),
mu AS (SELECT t, avg(sz) AS mu, count(*) AS rows FROM t JOIN x ON y < t GROUP BY t HAVING count(*) >= 60),
"""
MATRICES = """
f AS (SELECT t, rows, w, v, [1, ls, st, un, era, fo, ma, (sz IS NOT NULL)::INT, coalesce(sz, mu)]::DOUBLE[] AS f FROM mu JOIN x ON y < t),
i AS (SELECT unnest(range(1, 10)) AS i), j AS (SELECT unnest(range(1, 10)) AS j),
ma AS (SELECT t, list(a ORDER BY i, j) AS a FROM (SELECT t, i, j, sum(w * f[i] * f[j]) AS a FROM f, i, j GROUP BY ALL) GROUP BY t),
mb AS (SELECT t, any_value(rows) AS rows, list(b ORDER BY i) AS b FROM (SELECT t, rows, i, sum(w * f[i] * v) AS b FROM f, i GROUP BY ALL) GROUP BY t),
d AS (SELECT * FROM (VALUES ('base', [1, 2, 3, 4, 5]), ('origin', [1, 2, 3, 4, 5, 6, 7]), ('combine', [1, 2, 3, 4, 5, 8, 9]), ('both', [1, 2, 3, 4, 5, 6, 7, 8, 9])) v(variant, cols), (VALUES (1.0::DOUBLE), (100.0::DOUBLE)) r(ridge)),
q AS (SELECT variant, cols, ridge, t, rows, len(cols) AS n, 1 AS k, list_transform(cols, lambda i: list_concat(list_transform(cols, lambda j: a[(i - 1) * 9 + j] + CASE WHEN i = j AND i > 1 THEN ridge ELSE 0 END), [b[i]])) AS m FROM ma JOIN mb USING (t), d),
"""


@query("variant_fits", "2.8.35-36", RATES + MATRICES + solved(9) + """
SELECT variant, ridge, t AS y, rows, ['intercept', 'log_slot', 'stash', 'undrafted', 'era', 'foreign', 'other', '_known_size', '_filled_size'][unnest(cols)] AS term, round(unnest(beta), 5) AS coefficient FROM z
""")
def variant_fits(t: Tables):
    df = variants.with_gaps(yearly_rates(t), ["size"])
    fits = variants.fit_variants(df, VARIANTS, "rate", "w", "y", [x["y"] for x in df.select("y").distinct().collect()], gaps=("size",), ridges=(1.0, 100.0))
    return t.spark.createDataFrame(fits.table(), "variant string, ridge double, y int, rows long, term string, coefficient double").withColumn("coefficient", r("coefficient", 5))


@query("variant_predictions", "2.8.35-36", RATES + MATRICES + solved(9) + """,
o AS (SELECT x.y, e, variant, list_dot_product(beta, list_transform(cols, lambda c: ([1, ls, st, un, era, fo, ma, (sz IS NOT NULL)::INT, coalesce(sz, mu)]::DOUBLE[])[c])) AS p FROM x JOIN z ON z.t = x.y AND ridge = 1 JOIN mu ON mu.t = x.y)
SELECT y, e, round(max(p) FILTER (variant = 'base'), 5) AS base, round(max(p) FILTER (variant = 'origin'), 5) AS origin, round(max(p) FILTER (variant = 'combine'), 5) AS combine, round(max(p) FILTER (variant = 'both'), 5) AS "both" FROM o GROUP BY y, e
""")
def variant_predictions(t: Tables):
    df = variants.with_gaps(yearly_rates(t), ["size"])
    fits = variants.fit_variants(df, VARIANTS, "rate", "w", "y", [x["y"] for x in df.select("y").distinct().collect()], gaps=("size",))
    return df.select("y", "e", *[r(fits.predict(v, 1.0, F.col("y")), 5).alias(v) for v in VARIANTS]).where("base IS NOT NULL")


@query("history_blend", "2.8.171, 2.8.40", RATES + """
f AS (SELECT t, [1, ls, st, un, era]::DOUBLE[] AS f, total AS v FROM mu JOIN x ON y < t),
i AS (SELECT unnest(range(1, 6)) AS i), j AS (SELECT unnest(range(1, 6)) AS j),
ma AS (SELECT t, list(a ORDER BY i, j) AS a FROM (SELECT t, i, j, sum(f[i] * f[j]) AS a FROM f, i, j GROUP BY ALL) GROUP BY t),
mb AS (SELECT t, list(b ORDER BY i) AS b FROM (SELECT t, i, sum(f[i] * v) AS b FROM f, i GROUP BY ALL) GROUP BY t),
q AS (SELECT t, 5 AS n, 1 AS k, list_transform(range(1, 6), lambda i: list_concat(list_transform(range(1, 6), lambda j: a[(i - 1) * 5 + j] + CASE WHEN i = j AND i > 1 THEN 1 ELSE 0 END), [b[i]])) AS m FROM ma JOIN mb USING (t)),
""" + solved(5) + """,
s AS (SELECT x.y, x.e, x.total, ln(1 + x.e * 13 % 200) AS sig, x.e % 5 <> 0 AS listed, CASE WHEN b.e IS NOT NULL THEN list_dot_product(beta, [1, ls, st, un, era]::DOUBLE[]) END AS oof, beta IS NOT NULL AS fitted
      FROM x LEFT JOIN z ON z.t = x.y LEFT JOIN r b ON b.e = x.e AND b.y = x.y - 1),
mu2 AS (SELECT t, avg(oof) AS fill, count(*) AS n2 FROM t JOIN s ON s.y < t WHERE listed AND fitted GROUP BY t HAVING count(*) >= 60),
f2 AS (SELECT t, [1, sig, coalesce(oof, fill), (oof IS NOT NULL)::INT]::DOUBLE[] AS f, total AS v FROM mu2 JOIN s ON s.y < t WHERE listed AND fitted),
ma2 AS (SELECT t, list(a ORDER BY i, j) AS a FROM (SELECT t, i, j, sum(f[i] * f[j]) AS a FROM f2, i, j WHERE i < 5 AND j < 5 GROUP BY ALL) GROUP BY t),
mb2 AS (SELECT t, list(b ORDER BY i) AS b FROM (SELECT t, i, sum(f[i] * v) AS b FROM f2, i WHERE i < 5 GROUP BY ALL) GROUP BY t),
q2 AS (SELECT t, 4 AS n, 1 AS k, list_transform(range(1, 5), lambda i: list_concat(list_transform(range(1, 5), lambda j: a[(i - 1) * 4 + j] + CASE WHEN i = j AND i > 1 THEN 1e-6 ELSE 0 END), [b[i]])) AS m FROM ma2 JOIN mb2 USING (t)),
""" + solved(4).replace("g AS", "g2 AS").replace("FROM q ", "FROM q2 ").replace("FROM g ", "FROM g2 ").replace("z AS", "z2 AS") + """
SELECT s.y, s.e, round(oof, 4) AS oof, round(greatest(CASE WHEN listed AND z2.t IS NOT NULL THEN list_dot_product(z2.beta, [1, sig, coalesce(oof, fill), (oof IS NOT NULL)::INT]::DOUBLE[]) ELSE oof END, 0), 4) AS blend, n2 AS blend_rows
FROM s LEFT JOIN z2 ON z2.t = s.y LEFT JOIN mu2 ON mu2.t = s.y
""")
def history_blend(t: Tables):
    rows = yearly_rates(t)
    before = rows.select("e", (F.col("y") + 1).alias("y"), F.lit(True).alias("projected"))
    df = rows.join(before, ["e", "y"], "left").withColumn("projected", F.coalesce("projected", F.lit(False))).withColumn("listed", F.col("e") % 5 != 0).withColumn("signal", F.log(1 + F.col("e") * 13 % 200))
    out = variants.fit_from_history(df, BASE, "total", None, "y", [x["y"] for x in df.select("y").distinct().collect()], signal="signal", projected="projected", listed="listed")
    return out.select("y", "e", r("oof", 4).alias("oof"), F.round("blend", 4).alias("blend"), "blend_rows")

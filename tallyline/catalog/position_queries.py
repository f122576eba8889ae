"""Descriptors, calibrated lists, incremental rebuilds and consumers' positions on the driver's tables."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tallyline.catalog.base import Tables, query, r, text_day
from tallyline.catalog.history_queries import yearly_rates
from tallyline.operators import descriptors, watchlist
from tallyline.operators.ranking import asc, desc
from tallyline.session import ensure_checkpoint_dir
from tallyline.sources import rebuild
from tallyline.streaming import consumer, ledger


def scratch(t: Tables, name: str) -> str:
    return f"{ensure_checkpoint_dir(t.spark)}/{name}_{uuid.uuid4().hex}"


@query("period_descriptors", "2.3.78", """
WITH o AS (SELECT o_custkey e, year(o_orderdate) y, month(o_orderdate) m, o_orderkey k, o_totalprice / 1000 v, o_orderpriority g, CAST(o_orderdate AS DATE) d FROM orders),
s AS (SELECT e, y, count(DISTINCT k) games, sum(v) / count(DISTINCT k) rate, first(g ORDER BY d, k) AS fg, last(g ORDER BY d, k) AS lg FROM o GROUP BY e, y),
u AS (SELECT e, y, count(DISTINCT k) n, sum(v) / count(DISTINCT k) rate FROM o WHERE m <= 4 GROUP BY e, y),
q AS (SELECT c_custkey e, y FROM customer, (SELECT DISTINCT y FROM o))
SELECT q.e, q.y, (SELECT count(*) FROM s WHERE s.e = q.e AND s.y < q.y) AS earlier, round(CASE WHEN p.games IS NOT NULL THEN least(p.games / 6.0, 1) END, 6) AS prior_share, round(p.rate + 1e-8, 6) AS prior_rate, coalesce(s.fg <> p.lg, false) AS changed_group, round(CASE WHEN u.n >= 2 THEN u.rate - p.rate END + 1e-7, 5) AS delta
FROM q LEFT JOIN s ON s.e = q.e AND s.y = q.y LEFT JOIN s p ON p.e = q.e AND p.y = q.y - 1 LEFT JOIN u ON u.e = q.e AND u.y = q.y
""")
def period_descriptors(t: Tables):
    logs = t.orders.select(F.col("o_custkey").alias("e"), F.year("o_orderdate").alias("y"), F.month("o_orderdate").alias("m"), F.col("o_orderkey").alias("k"), (F.col("o_totalprice") / 1000).alias("v"), F.col("o_orderpriority").alias("g"), F.to_date("o_orderdate").alias("d"))
    roles = dict(entity="e", period="y", event="k", value="v", group="g", day="d")
    keys = t.customer.select(F.col("c_custkey").alias("e")).withColumn("y", F.explode(F.array(*[F.lit(x["y"]) for x in logs.select("y").distinct().collect()])))        # the years of the data
    out = descriptors.period_descriptors(keys, descriptors.period_summaries(logs, **roles), entity="e", period="y", length=6.0, runup=descriptors.period_summaries(logs.where("m <= 4"), **roles))
    return out.select("e", "y", "earlier", r("prior_share").alias("prior_share"), r(F.col("prior_rate") + 1e-8).alias("prior_rate"), "changed_group", r(F.col("delta") + 1e-7, 5).alias("delta"))


OUTCOMES = ["breakout", "useful"]


def uplifts(t: Tables):
    """Customers with an order in a year and the one before: the change of their mean price, and what came of it the year after."""
    now = yearly_rates(t).select("e", "y", "rate", "era")
    before, after = now.select("e", (F.col("y") + 1).alias("y"), F.col("rate").alias("base")), now.select("e", (F.col("y") - 1).alias("y"), F.col("rate").alias("next_rate"))
    rows = now.join(before, ["e", "y"]).join(after, ["e", "y"], "left").withColumn("uplift", F.col("rate") - F.col("base"))
    return rows.withColumn("breakout", (F.col("next_rate") - F.col("base") >= 20).cast("int")).withColumn("useful", (F.col("next_rate") > 250).cast("int"))


UPLIFTS = """
WITH RECURSIVE r AS (SELECT year(o_orderdate) y, o_custkey e, avg(o_totalprice) / 1000 v FROM orders GROUP BY 1, 2),
u AS (SELECT a.y, a.e, a.v - b.v AS up, (n.v - b.v >= 20)::INT AS breakout, (n.v > 250)::INT AS useful FROM r a JOIN r b ON b.e = a.e AND b.y = a.y - 1 LEFT JOIN r n ON n.e = a.e AND n.y = a.y + 1),
l AS (SELECT y, e, up, 'breakout' AS outcome, breakout AS hit FROM u WHERE breakout IS NOT NULL UNION ALL SELECT y, e, up, 'useful', useful FROM u WHERE useful IS NOT NULL),
t AS (SELECT DISTINCT y AS t FROM u),
m AS (SELECT t, outcome, avg(up) AS mu, stddev_pop(up) AS sd, count(*) AS n FROM t JOIN l ON l.y < t GROUP BY ALL HAVING count(*) >= 50 AND min(hit) < max(hit)),
z AS (SELECT t, outcome, (up - mu) / sd AS z, hit FROM m JOIN l USING (outcome) WHERE l.y < t),
f AS (SELECT t, outcome, 0 AS it, 0.0::DOUBLE AS b0, 0.0::DOUBLE AS b1 FROM m UNION ALL
      SELECT t, outcome, it + 1, b0 + (h11 * g0 - h01 * g1) / (h00 * h11 - h01 * h01), b1 + (h00 * g1 - h01 * g0) / (h00 * h11 - h01 * h01) FROM (
        SELECT t, outcome, it, b0, b1, sum(hit - p) AS g0, sum(z * (hit - p)) - 0.001 * b1 AS g1, sum(p * (1 - p)) AS h00, sum(z * p * (1 - p)) AS h01, sum(z * z * p * (1 - p)) + 0.001 AS h11
        FROM (SELECT f.*, z, hit, 1 / (1 + exp(-(b0 + b1 * z))) AS p FROM f JOIN z USING (t, outcome) WHERE it < 12) GROUP BY t, outcome, it, b0, b1)),
c AS (SELECT t, outcome, b0 - b1 * mu / sd AS intercept, b1 / sd AS slope FROM f JOIN m USING (t, outcome) WHERE it = 12),
w AS (SELECT u.y, u.e, up, 1 / (1 + exp(-(b.intercept + b.slope * up))) AS breakout_chance, 1 / (1 + exp(-(g.intercept + g.slope * up))) AS useful_chance, u.e % 11 <= 5 AS is_young, u.e % 11 <= 5 AND u.e * 13 % 200 > 100 AND up > 0 AS is_hidden
      FROM u LEFT JOIN c b ON b.t = u.y AND b.outcome = 'breakout' LEFT JOIN c g ON g.t = u.y AND g.outcome = 'useful')
"""


@query("calibrated_watchlist", "2.6.16, 2.8.72, 2.8.172-173", UPLIFTS + """
SELECT y, e, round(up + 1e-7, 5) AS uplift, round(breakout_chance, 5) AS breakout_chance, round(useful_chance, 5) AS useful_chance, is_young, is_hidden,
       CASE WHEN is_young THEN row_number() OVER (PARTITION BY y, is_young ORDER BY useful_chance DESC NULLS LAST, up DESC, e) END AS by_chance_young, CASE WHEN is_hidden THEN row_number() OVER (PARTITION BY y, is_hidden ORDER BY useful_chance DESC NULLS LAST, up DESC, e) END AS by_chance_hidden,
       CASE WHEN is_young THEN row_number() OVER (PARTITION BY y, is_young ORDER BY up DESC, e) END AS by_uplift_young, CASE WHEN is_hidden THEN row_number() OVER (PARTITION BY y, is_hidden ORDER BY up DESC, e) END AS by_uplift_hidden FROM w
""")
def calibrated_watchlist(t: Tables):
    rows = uplifts(t)
    years = [x["y"] for x in rows.select("y").distinct().collect()]
    table, shape = scratch(t, "calibration"), watchlist.shape_of(["uplift"], OUTCOMES)
    watchlist.save_calibration(watchlist.fit_calibration(rows, ["uplift"], OUTCOMES, "y", years), table, model="uplift", shape=shape)
    said = watchlist.with_chances(rows, watchlist.load_calibration(t.spark, table, model="uplift", shape=shape), ["uplift"], OUTCOMES, "y")
    young = F.col("era") <= 5
    orders = {"by_chance": [desc("useful_chance"), desc("uplift"), asc("e")], "by_uplift": [desc("uplift"), asc("e")]}
    full = watchlist.ranked_watchlist(said, ["y"], orders, {"young": young, "hidden": young & (F.col("e") * 13 % 200 > 100) & (F.col("uplift") > 0)})
    return full.select("y", "e", r(F.col("uplift") + 1e-7, 5).alias("uplift"), *[r(f"{o}_chance", 5).alias(f"{o}_chance") for o in OUTCOMES], "is_young", "is_hidden", *[f"{o}_{f}" for o in orders for f in ("young", "hidden")])


def event_day():
    return F.dayofmonth("ts")


@query("rebuilt_events", "2.1.103", """
SELECT event_type, CAST(ts AS DATE) - DATE '2024-01-01' AS day, count(*) AS n, round(sum(CASE WHEN day(ts) BETWEEN 11 AND 20 THEN 2 * value ELSE value END), 4) AS v FROM events WHERE day(ts) BETWEEN 6 AND 31 GROUP BY ALL
""")
def rebuilt_events(t: Tables):
    """Units of ten days: a run over two of them, then one changes, one comes and one goes, and a second run reads what is new. A third one reads nothing."""
    source, table = scratch(t, "units"), scratch(t, "rebuilt")

    def write(unit: str, first: int, last: int, factor: int = 1) -> None:
        rows = t.events.where(event_day().between(first, last)).withColumn("value", F.col("value") * factor)
        rows.select("event_id", "ts", "event_type", "value").write.mode("overwrite").parquet(f"{source}/{unit}")

    read = rebuild.read_parquet_units("event_id bigint, ts timestamp, event_type string, value double")
    write("early", 1, 5), write("first", 6, 10), write("middle", 11, 20)
    rebuild.rebuild_table(t.spark, source, table, read)
    write("middle", 11, 20, factor=2), write("last", 21, 31), write("early", 40, 41)             # the third keeps a unit without rows
    done = rebuild.rebuild_table(t.spark, source, table, read)
    again = rebuild.rebuild_table(t.spark, source, table, read)
    if (done.read, again.read, again.version) != (3, 0, done.version):
        raise RuntimeError(f"read {done} and then {again}")
    rows = rebuild.read_rebuilt(t.spark, table)
    return rows.groupBy("event_type", F.datediff(F.to_date("ts"), F.lit("2024-01-01").cast("date")).cast("long").alias("day")).agg(F.count(F.lit(1)).alias("n"), r(F.sum("value"), 4).alias("v"))


@query("unseen_since_acknowledged", "2.10.3", """
WITH l AS (SELECT user_id, event_type, CAST(floor(value) AS BIGINT) % 10 AS band, min(ts) AS first_seen, count(*) AS n_seen FROM events GROUP BY ALL),
p AS (SELECT 'daily' AS consumer, max(ts) AS acked FROM events WHERE day(ts) <= 20 UNION ALL SELECT 'weekly', max(ts) FROM events WHERE day(ts) <= 10 UNION ALL SELECT 'new', NULL)
SELECT consumer, user_id, event_type, band, strftime(first_seen, '%Y-%m-%d') AS first_seen, n_seen FROM l, p
WHERE CASE WHEN acked IS NULL THEN CAST(first_seen AS DATE) >= (SELECT max(CAST(first_seen AS DATE)) FROM l) - 7 ELSE first_seen > acked END
""")
def unseen_since_acknowledged(t: Tables):
    """Three consumers of a ledger: one acknowledges twice, one once, one never."""
    base, key = scratch(t, "acknowledged"), ["user_id", "event_type", "band"]
    stream = t.spark.readStream.schema(t.events.schema).option("pathGlobFilter", "events.parquet").parquet(t.folder).withColumn("band", F.floor("value") % 10)
    ledger.start_ledger(stream.select(*key, "ts"), f"{base}/rows", f"{base}/position", key, ledger.sightings(key, "ts", []), buckets=8).awaitTermination()
    said = lambda who, day: t.events.where(event_day() <= day).agg(F.max(F.col("ts").cast("timestamp")).alias("acked")).select(F.lit(who).alias("consumer"), "acked")      # noqa: E731
    for acks in (said("daily", 10).unionByName(said("weekly", 10)), said("daily", 20), said("daily", 15)):                # the last one comes late
        acks.write.mode("append").parquet(f"{base}/said")
        consumer.start_acknowledgements(t.spark.readStream.schema("consumer string, acked timestamp").parquet(f"{base}/said"), f"{base}/acks", f"{base}/acks_position", buckets=2).awaitTermination()
    consumers = t.spark.createDataFrame([("daily",), ("weekly",), ("new",)], "consumer string")
    out = consumer.unseen(ledger.read_ledger(t.spark, f"{base}/rows").withColumn("first_seen", F.col("first_seen").cast("timestamp")), ledger.read_ledger(t.spark, f"{base}/acks"), consumers)
    return out.select("consumer", *key, text_day("first_seen").alias("first_seen"), "n_seen")


@query("detected_entries", "2.3.88", """
SELECT event_id, c_custkey AS id, r_regionkey::BIGINT AS owner_id, c_custkey IS NOT NULL AND r_regionkey IS NOT NULL AS is_resolved
FROM events LEFT JOIN customer ON c_custkey = user_id AND c_nationkey % 2 = 0 LEFT JOIN region ON r_regionkey = CAST(floor(value) AS BIGINT) % 7
""")
def detected_entries(t: Tables):
    """Entries in two lists, the second of which repeats the first: each is resolved and shown once."""
    base = scratch(t, "detected")
    ids = t.customer.where("c_nationkey % 2 = 0").select(F.col("c_custkey").alias("key"), F.col("c_custkey").alias("id"))
    owners = t.region.select(F.col("r_regionkey").cast("long").alias("owner"), F.col("r_regionkey").cast("long").alias("owner_id"))
    rows = t.events.select("event_id", "user_id", (F.floor("value") % 7).cast("long").alias("owner"), "ts")
    for part in (rows.where(event_day() <= 15), rows):
        part.drop("ts").write.mode("append").parquet(f"{base}/lists")
        stream = t.spark.readStream.schema("event_id bigint, user_id bigint, owner bigint").parquet(f"{base}/lists")
        consumer.start_detected_entries(stream, ids, owners, f"{base}/rows", f"{base}/position", entry="event_id", name="user_id", owner="owner").awaitTermination()
    return t.spark.read.parquet(f"{base}/rows").select("event_id", "id", "owner_id", "is_resolved")

"""Contracts, audits and maintenance."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyline.catalog.base import Tables, query, r, text_day
from tallyline.operators import merge, quality
from tallyline.operators.diffs import compare
from tallyline.operators.sequences import anchored_dedupe
from tallyline.operators.views import content_hash
from tallyline.sources.contracts import TableSpec, table_problems

LINE_SPEC = TableSpec("lineitem", ("l_orderkey", "l_linenumber"),
                      {"l_orderkey": ("int", False), "l_linenumber": ("int", False), "l_quantity": ("float", False), "l_shipdate": ("date", True)},
                      {"quantity above 45": "l_quantity > 45", "discount above tax": "l_discount > l_tax", "price below zero": "l_extendedprice < 0"})
ORDER_SPEC = TableSpec("orders", ("o_orderkey",), {"o_orderkey": ("int", False), "o_totalprice": ("float", False)},
                       {"price above 450000": "o_totalprice > 450000", "unknown status": "o_orderstatus not in ('F', 'O', 'P')"})


@query("contract_problems", "2.1.1-3, 2.1.29-32, 2.4.68", """
WITH l AS (
  SELECT 'lineitem' AS table_name, unnest(['quantity above 45', 'discount above tax', 'price below zero', 'duplicate key']) AS rule,
         unnest([(SELECT count(*) FROM lineitem WHERE l_quantity > 45), (SELECT count(*) FROM lineitem WHERE l_discount > l_tax),
                 (SELECT count(*) FROM lineitem WHERE l_extendedprice < 0),
                 (SELECT CAST(sum(n - 1) AS BIGINT) FROM (SELECT count(*) n FROM lineitem GROUP BY l_orderkey, l_linenumber))]) AS n_bad),
o AS (
  SELECT 'orders' AS table_name, unnest(['price above 450000', 'unknown status', 'duplicate key']) AS rule,
         unnest([(SELECT count(*) FROM orders WHERE o_totalprice > 450000), (SELECT count(*) FROM orders WHERE o_orderstatus NOT IN ('F', 'O', 'P')),
                 (SELECT CAST(sum(n - 1) AS BIGINT) FROM (SELECT count(*) n FROM orders GROUP BY o_orderkey))]) AS n_bad)
SELECT * FROM (SELECT * FROM l UNION ALL SELECT * FROM o) WHERE n_bad > 0
""")
def contract_problems(t: Tables):
    parts = [table_problems(df, spec).select(F.lit(spec.name).alias("table_name"), "rule", "n_bad") for df, spec in ((t.lineitem, LINE_SPEC), (t.orders, ORDER_SPEC))]
    return parts[0].unionByName(parts[1])


@query("drop_reason_counts", "2.1.13, 2.1.26, 2.1.111", """
SELECT CASE WHEN event_type = 'error' THEN 'error event' WHEN value < 5 THEN 'value too small'
            WHEN CAST(json_extract_string(props, '$.k') AS INTEGER) >= 90 THEN 'k out of range' END AS reason, count(*) AS n_rows
FROM events GROUP BY 1 HAVING reason IS NOT NULL
""")
def drop_reason_counts(t: Tables):
    k = F.get_json_object("props", "$.k").cast("int")
    return merge.drop_report(t.events, F.when(F.col("event_type") == "error", "error event").when(F.col("value") < 5, "value too small").when(k >= 90, "k out of range"))


@query("opponent_value", "2.1.14, 2.1.27, 2.1.79", """
WITH p AS (SELECT l_orderkey, sum(l_extendedprice) s FROM lineitem GROUP BY l_orderkey HAVING count(*) = 2)
SELECT l.l_orderkey, l.l_linenumber, round(l.l_extendedprice, 2) AS own_value, round(p.s - l.l_extendedprice, 2) AS other_value
FROM lineitem l JOIN p USING (l_orderkey)
""")
def opponent_value(t: Tables):
    pairs = t.lineitem.groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("n"), F.sum("l_extendedprice").alias("s")).where(F.col("n") == 2).drop("n")
    return t.lineitem.join(pairs, "l_orderkey").select("l_orderkey", "l_linenumber", r("l_extendedprice", 2).alias("own_value"),
                                                       r(F.col("s") - F.col("l_extendedprice"), 2).alias("other_value"))


@query("layered_coalesce", "2.1.19, 2.1.38, 2.1.41", """
SELECT coalesce(s.s_suppkey, c.c_custkey) AS id, coalesce(s.s_name, c.c_name) AS name, coalesce(CASE WHEN s.s_acctbal > 0 THEN s.s_acctbal END, c.c_acctbal) AS balance
FROM supplier s FULL JOIN customer c ON s.s_suppkey = c.c_custkey
""")
def layered_coalesce(t: Tables):
    first = t.supplier.select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"), F.when(F.col("s_acctbal") > 0, F.col("s_acctbal")).alias("balance"))
    second = t.customer.select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.col("c_acctbal").alias("balance"))
    return merge.layered([first, second], ["id"], ["name", "balance"])


@query("table_content_hash", "2.1.25, 2.1.88, 2.7.7")
def table_content_hash(t: Tables):
    return content_hash(t.orders).withColumn("table_name", F.lit("orders")).unionByName(content_hash(t.lineitem).withColumn("table_name", F.lit("lineitem")))


@query("replace_window_merge", "2.1.22, 2.1.83-84, 2.1.74, 2.7.1", """
SELECT o_orderkey, round(o_totalprice, 2) AS price, 'stored' AS copy FROM orders
WHERE NOT (o_orderdate >= DATE '1998-03-01' AND o_orderdate < DATE '1998-09-01') OR o_orderstatus = 'P'
UNION ALL
SELECT o_orderkey, round(o_totalprice + 1, 2), 'fresh' FROM orders
WHERE o_orderdate >= DATE '1998-03-01' AND o_orderdate < DATE '1998-09-01' AND o_orderstatus <> 'P'
""")
def replace_window_merge(t: Tables):
    day = F.to_date("o_orderdate")
    inside = (day >= F.lit("1998-03-01").cast("date")) & (day < F.lit("1998-09-01").cast("date"))
    stored = t.orders.select("o_orderkey", "o_orderdate", "o_orderstatus", r("o_totalprice", 2).alias("price"), F.lit("stored").alias("copy"))
    fresh = t.orders.where(inside).select("o_orderkey", "o_orderdate", "o_orderstatus", r(F.col("o_totalprice") + 1, 2).alias("price"), F.lit("fresh").alias("copy"))
    pending = t.orders.where(inside & (F.col("o_orderstatus") == "P"))
    return merge.replace_window_keep(stored, fresh, in_window=inside, key=["o_orderkey"], keep=pending).select("o_orderkey", "price", "copy")


@query("upsert_keeps_known", "2.1.23-24, 2.1.65, 2.1.68", """
SELECT c_custkey, coalesce(CASE WHEN c_custkey % 3 = 0 THEN c_acctbal + 1 END, c_acctbal) AS c_acctbal, c_mktsegment FROM customer
""")
def upsert_keeps_known(t: Tables):
    old = t.customer.select("c_custkey", "c_acctbal", "c_mktsegment")
    new = t.customer.select("c_custkey", F.when(F.col("c_custkey") % 3 == 0, F.col("c_acctbal") + 1).alias("c_acctbal"), F.lit(None).cast("string").alias("c_mktsegment"))
    return merge.upsert(old, new, ["c_custkey"])


@query("dedupe_conflicting_rows", "2.1.13, 2.1.35, 2.7.2-3", """
WITH d AS (SELECT DISTINCT l_orderkey, l_linenumber, l_quantity, l_extendedprice FROM lineitem)
SELECT l_orderkey, l_linenumber, l_quantity, l_extendedprice FROM (
  SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_quantity DESC, l_extendedprice DESC) rn FROM d) WHERE rn = 1
""")
def dedupe_conflicting_rows(t: Tables):
    rows = t.lineitem.select("l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice")
    return merge.dedupe_conflicting(rows, ["l_orderkey", "l_linenumber"], ["l_quantity", "l_extendedprice"])[0]


@query("ledger_first_last_seen", "2.1.54, 2.1.56-57, 2.1.63, 2.1.85", """
SELECT user_id, event_type, strftime(min(ts), '%Y-%m-%d') AS first_seen, strftime(max(ts), '%Y-%m-%d') AS last_seen, count(*) AS n_seen, arg_max(value, ts) AS value
FROM events GROUP BY user_id, event_type
""")
def ledger_first_last_seen(t: Tables):
    out = merge.first_last_seen(t.events, ["user_id", "event_type"], "ts", ["value"])
    return out.withColumn("first_seen", text_day("first_seen")).withColumn("last_seen", text_day("last_seen"))


@query("latest_per_key", "2.1.44, 2.1.49, 2.1.57, 2.10.7", """
SELECT user_id, event_id, event_type, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) rn FROM events) WHERE rn = 1
""")
def latest_per_key(t: Tables):
    return merge.latest_per_key(t.events.select("user_id", "event_id", "event_type", "value", "ts"), ["user_id"], "ts").drop("ts")


@query("newest_snapshot", "2.1.44, 2.1.49, 2.3.26", """
SELECT event_id, user_id, value FROM events WHERE CAST(ts AS DATE) = (SELECT max(CAST(ts AS DATE)) FROM events WHERE CAST(ts AS DATE) < DATE '2024-01-20')
""")
def newest_snapshot(t: Tables):
    return merge.latest_snapshot(t.events.withColumn("d", F.to_date("ts")), day="d", before="2024-01-20").select("event_id", "user_id", "value")


@query("snapshot_diff", "2.1.45, 2.3.79, 2.3.81, 2.3.85", """
WITH s AS (SELECT user_id, CAST(ts AS DATE) d, arg_max(event_type, (ts, event_id)) g FROM events GROUP BY 1, 2),
b AS (SELECT min(d) lo, max(d) hi FROM s),
j AS (SELECT coalesce(c.d, p.d + 1) AS d, p.g AS a, c.g AS b FROM s p FULL JOIN s c ON c.user_id = p.user_id AND c.d = p.d + 1)
SELECT strftime(j.d, '%Y-%m-%d') AS day, CASE WHEN a IS NULL THEN 'arrived' WHEN j.b IS NULL THEN 'departed' ELSE 'moved' END AS change, count(*) AS n
FROM j, b WHERE j.d > lo AND j.d <= hi AND (a IS NULL OR j.b IS NULL OR a <> j.b) GROUP BY 1, 2
""")
def snapshot_diff(t: Tables):
    state = t.events.groupBy("user_id", F.to_date("ts").alias("d")).agg(F.max_by("event_type", F.struct("ts", "event_id")).alias("g"))
    prev = state.withColumn("d", F.date_add("d", 1))
    j = compare(prev, state, ["user_id", "d"], ["g"])
    span = state.agg(F.struct(F.min("d").alias("lo"), F.max("d").alias("hi"))).scalar()
    change = F.when(~F.col("in_prev"), "arrived").when(~F.col("in_cur"), "departed").when(F.col("g_prev") != F.col("g_cur"), "moved")
    j = j.where((F.col("d") > span["lo"]) & (F.col("d") <= span["hi"])).withColumn("change", change).where(F.col("change").isNotNull())
    return j.groupBy(text_day("d").alias("day"), "change").agg(F.count(F.lit(1)).alias("n"))


@query("dedupe_within_7_days", "2.1.69", """
WITH RECURSIVE days AS (SELECT user_id, event_type, CAST(ts AS DATE) d, min(event_id) id FROM events GROUP BY 1, 2, 3),
kept AS (
  SELECT user_id, event_type, min(d) AS d FROM days GROUP BY 1, 2
  UNION ALL
  SELECT k.user_id, k.event_type, min(x.d) FROM kept k JOIN days x ON x.user_id = k.user_id AND x.event_type = k.event_type AND x.d > k.d + 7 GROUP BY k.user_id, k.event_type, k.d)
SELECT days.id AS event_id, kept.user_id, kept.event_type FROM kept JOIN days ON days.user_id = kept.user_id AND days.event_type = kept.event_type AND days.d = kept.d
""")
def dedupe_within_7_days(t: Tables):
    rows = t.events.select("event_id", "user_id", "event_type", F.to_date("ts").alias("d"), F.lit(0).alias("prefer"))
    return anchored_dedupe(rows, ["user_id", "event_type"], "d", "prefer", "event_id").select("event_id", "user_id", "event_type")


@query("orphans_both_ways", "2.3.16-17, 2.3.19, 2.7.4", """
SELECT 'orders without lines' AS problem, count(*) AS n FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)
UNION ALL SELECT 'lines without order', count(*) FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders)
UNION ALL SELECT 'lines before order', count(*) FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_shipdate < o_orderdate
""")
def orphans_both_ways(t: Tables):
    return quality.orphan_report(t.orders.select(F.col("o_orderkey").alias("k"), "o_orderdate"), t.lineitem.select(F.col("l_orderkey").alias("k"), "l_shipdate"), ["k"],
                                 left_name="orders without lines", right_name="lines without order",
                                 mismatches={"lines before order": F.col("l_shipdate") < F.col("o_orderdate")})


@query("crosscheck_sources", "2.3.16", """
WITH a AS (SELECT o_orderkey k, o_totalprice v FROM orders), b AS (SELECT l_orderkey k, sum(l_extendedprice) v FROM lineitem GROUP BY 1)
SELECT count(*) FILTER (WHERE b.k IS NULL) AS only_left, count(*) FILTER (WHERE a.k IS NULL) AS only_right,
       count(*) FILTER (WHERE a.k IS NOT NULL AND b.k IS NOT NULL AND abs(a.v - b.v) > 1000) AS v_mismatch
FROM a FULL JOIN b ON a.k = b.k
""")
def crosscheck_sources(t: Tables):
    a = t.orders.select(F.col("o_orderkey").alias("k"), F.col("o_totalprice").alias("v"))
    b = t.lineitem.groupBy(F.col("l_orderkey").alias("k")).agg(F.sum("l_extendedprice").alias("v"))
    return quality.crosscheck(a, b, ["k"], {"v": 1000.0})


@query("completeness_by_period", "2.4.66, 2.3.18", """
WITH n AS (SELECT year(o_orderdate) y, count(*) n, count(DISTINCT o_custkey) c, count(DISTINCT o_orderdate) d FROM orders GROUP BY 1)
SELECT y, n AS n_rows, c AS n_entities, d AS n_days, round(d / CASE WHEN y % 4 = 0 THEN 366 ELSE 365 END, 6) AS day_share FROM n
""")
def completeness_by_period(t: Tables):
    out = t.order_events.groupBy("y").agg(F.count(F.lit(1)).alias("n_rows"), F.countDistinct("cust").alias("n_entities"), F.countDistinct("d").alias("n_days"))
    return out.withColumn("day_share", r(F.col("n_days") / F.when(F.col("y") % 4 == 0, 366).otherwise(365)))


@query("null_share", "2.4.71", """
SELECT 'l_shipdate' AS column_name, round(avg(CASE WHEN l_shipdate >= DATE '2001-01-01' THEN 1.0 ELSE 0 END), 6) AS null_share,
       round(sum(CASE WHEN l_shipdate >= DATE '2001-01-01' THEN l_quantity ELSE 0 END) / sum(l_quantity), 6) AS weighted_null_share FROM lineitem
UNION ALL SELECT 'l_discount', round(avg(CASE WHEN l_discount = 0 THEN 1.0 ELSE 0 END), 6), round(sum(CASE WHEN l_discount = 0 THEN l_quantity ELSE 0 END) / sum(l_quantity), 6) FROM lineitem
""")
def null_share(t: Tables):
    rows = t.lineitem.select("l_quantity", F.when(F.col("l_shipdate") < F.lit("2001-01-01").cast("timestamp_ntz"), F.col("l_shipdate")).alias("l_shipdate"),
                             F.when(F.col("l_discount") != 0, F.col("l_discount")).alias("l_discount"))
    out = quality.null_shares(rows, ["l_shipdate", "l_discount"], weight="l_quantity")
    return out.select("column_name", r("null_share").alias("null_share"), r("weighted_null_share").alias("weighted_null_share"))


@query("plausibility_outliers", "2.4.69-70", """
SELECT 'quantity at least 49' AS rule, count(*) FILTER (WHERE l_quantity >= 49) AS n_hits, max(l_quantity) AS highest FROM lineitem
UNION ALL SELECT 'price at least 90000', count(*) FILTER (WHERE l_extendedprice >= 90000), max(l_extendedprice) FROM lineitem
""")
def plausibility_outliers(t: Tables):
    return quality.threshold_hits(t.lineitem, {"quantity at least 49": ("l_quantity", 49.0), "price at least 90000": ("l_extendedprice", 90000.0)})


@query("value_histogram", "2.4.69", """
SELECT CAST(floor(l_quantity / 10) AS BIGINT) AS bin, count(*) AS n FROM lineitem GROUP BY 1
""")
def value_histogram(t: Tables):
    return quality.histogram(t.lineitem, "l_quantity", 10.0)


@query("table_inventory", "2.4.65, 2.1.104", """
SELECT 'orders' AS table_name, count(*) AS n_rows, count(DISTINCT year(o_orderdate)) AS n_periods, min(year(o_orderdate)) AS first_period, max(year(o_orderdate)) AS last_period FROM orders
UNION ALL SELECT 'lineitem', count(*), count(DISTINCT year(l_shipdate)), min(year(l_shipdate)), max(year(l_shipdate)) FROM lineitem
UNION ALL SELECT 'events', count(*), count(DISTINCT year(ts)), min(year(ts)), max(year(ts)) FROM events
""")
def table_inventory(t: Tables):
    return quality.inventory({"orders": (t.orders, F.year("o_orderdate")), "lineitem": (t.lineitem, F.year("l_shipdate")), "events": (t.events, F.year("ts"))}).select(
        "table_name", "n_rows", "n_periods", F.col("first_period").cast("long").alias("first_period"), F.col("last_period").cast("long").alias("last_period"))


@query("split_counts", "2.4.67", """
SELECT year(o_orderdate) AS y, count(*) FILTER (WHERE o_orderdate < make_date(year(o_orderdate), 7, 1)) AS n_before, count(*) FILTER (WHERE o_orderdate >= make_date(year(o_orderdate), 7, 1)) AS n_after
FROM orders GROUP BY 1
""")
def split_counts(t: Tables):
    cut = F.make_date(F.col("y"), F.lit(7), F.lit(1))
    return t.order_events.groupBy("y").agg(F.count_if(F.col("d") < cut).alias("n_before"), F.count_if(F.col("d") >= cut).alias("n_after"))


@query("season_leaders", "2.4.72, 2.4.34", """
WITH p AS (SELECT year(o_orderdate) y, o_custkey c, count(*) n, avg(o_totalprice) m FROM orders GROUP BY 1, 2 HAVING count(*) >= 3)
SELECT y, c AS leader, n, round(m, 4) AS mean_price FROM (SELECT *, row_number() OVER (PARTITION BY y ORDER BY m DESC, c) rn FROM p) WHERE rn = 1
""")
def season_leaders(t: Tables):
    return quality.leaders(t.order_events, period="y", entity="cust", value="price", min_events=3).select("y", "leader", "n", r("mean_value", 4).alias("mean_price"))


@query("expected_facts", "2.4.73", """
SELECT 'orders in 1996' AS fact, CAST(2300.0 AS DOUBLE) AS expected, CAST(count(*) FILTER (WHERE year(o_orderdate) = 1996) AS DOUBLE) AS found, abs(count(*) FILTER (WHERE year(o_orderdate) = 1996) - 2300) <= 100 AS ok FROM orders
UNION ALL SELECT 'statuses', CAST(3.0 AS DOUBLE), CAST(count(DISTINCT o_orderstatus) AS DOUBLE), count(DISTINCT o_orderstatus) = 3 FROM orders
""")
def expected_facts(t: Tables):
    found = t.orders.agg(F.count_if(F.year("o_orderdate") == 1996).cast("double").alias("orders in 1996"), F.countDistinct("o_orderstatus").cast("double").alias("statuses"))
    return quality.check_facts(found, {"orders in 1996": (2300.0, 100.0), "statuses": (3.0, 0.0)})


@query("freshness", "2.1.112-113", """
SELECT 'orders' AS table_name, date_diff('day', max(CAST(o_orderdate AS DATE)), DATE '2001-08-15') AS age_days, date_diff('day', max(CAST(o_orderdate AS DATE)), DATE '2001-08-15') > 20 AS stale FROM orders
UNION ALL SELECT 'lineitem', date_diff('day', max(CAST(l_shipdate AS DATE)), DATE '2001-08-15'), date_diff('day', max(CAST(l_shipdate AS DATE)), DATE '2001-08-15') > 20 FROM lineitem
""")
def freshness(t: Tables):
    return quality.freshness({"orders": (t.orders, F.to_date("o_orderdate"), 20), "lineitem": (t.lineitem, F.to_date("l_shipdate"), 20)}, F.lit("2001-08-15").cast("date"))


@query("wiped_partition_audit", "2.1.61-62", """
SELECT event_type, count(*) AS n_rows, count(*) FILTER (WHERE value > 0.5 AND value < 300) AS n_real, min(value) AS lowest, count(*) FILTER (WHERE value > 0.5 AND value < 300) < 1950 AS wiped
FROM events GROUP BY event_type
""")
def wiped_partition_audit(t: Tables):
    return quality.wiped_partitions(t.events, "event_type", "value", real=(F.col("value") > 0.5) & (F.col("value") < 300), min_real=1950)


@query("consecutive_failures", "2.1.114-115", """
WITH d AS (SELECT user_id, CAST(ts AS DATE) d, max(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) bad FROM events GROUP BY 1, 2),
l AS (SELECT user_id, max(CASE WHEN bad = 0 THEN d END) lastok FROM d GROUP BY 1)
SELECT d.user_id, count(*) AS trailing FROM d JOIN l USING (user_id) WHERE bad = 1 AND (lastok IS NULL OR d.d > lastok) GROUP BY 1
""")
def consecutive_failures(t: Tables):
    from tallyline.operators.sequences import trailing_run
    return trailing_run(t.user_days.withColumn("bad", F.col("n_error") > 0), ["user_id"], "d", "bad")

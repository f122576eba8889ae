"""Text rules, names, parsing, resolution, streams and the projection pipeline on the driver's tables."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import functions as F

from tallyline.catalog import box
from tallyline.catalog.base import Tables, query, r, text_day
from tallyline.functions import flags, names, parsing, periods, rules
from tallyline.operators import overlays, resolve, sequences, studies, value
from tallyline.operators.folds import entry_clock
from tallyline.operators.ranking import asc, desc, with_row_number
from tallyline.operators.views import History
from tallyline.plans.adjusted import NaiveLastSeason, event_table
from tallyline.plans.projector import BaselineProjector
from tallyline.plans.rates import BaselineConfig
from tallyline.plans.walk_forward import cutoff_grid, walk_forward
from tallyline.session import cut_lineage, ensure_checkpoint_dir
from tallyline.sources import feeds
from tallyline.streaming import ledger, pending, windows


def _sql_rule(text: str, pattern: str) -> str:
    """The predicate in SQL; word edges are spelled out, because the other engine's edges know plain letters only."""
    edge = r"[^\p{L}\p{N}_]"
    pattern = re.sub(r"(?<=[a-z)])\\b", lambda m: f"(?:$|{edge})", pattern)
    pattern = re.sub(r"\\b(?=[a-z(])", lambda m: f"(?:^|{edge})", pattern)
    quoted = pattern.replace("'", "''")
    return f"regexp_matches({text}, '{quoted}')"


PART_SQL = "CASE " + " ".join(f"WHEN {_sql_rule('text', p)} THEN '{n}'" for n, p in rules.BODY_PARTS) + " ELSE '' END"


@query("reason_class", "2.2.28, 2.2.31, 2.11.6", f"""
WITH d AS (SELECT lang, text, lower('Injury/Illness ' || text) AS low, {PART_SQL} AS part FROM documents),
k AS (SELECT lang, part, CASE WHEN regexp_matches(low, 'two-way|on assignment') THEN 'g_league' WHEN contains(low, 'suspen') THEN 'suspension' WHEN regexp_matches(low, 'health and safety|covid-19') THEN 'covid'
  WHEN regexp_matches(low, 'personal|bereavement|family|paternity|birth') THEN 'personal' WHEN contains(low, 'not with team') THEN 'not_with_team'
  WHEN {_sql_rule('text', rules.REST)} AND NOT {_sql_rule('text', rules.RECOVERY)} THEN 'rest'
  WHEN {_sql_rule('text', rules.ILLNESS)} AND part = '' THEN 'illness' WHEN {_sql_rule('text', rules.RECOVERY)} THEN 'recovery' ELSE 'injury' END AS kind FROM d)
SELECT lang, kind, CASE WHEN kind IN ('injury', 'recovery') THEN CASE WHEN part = '' THEN 'other' ELSE part END ELSE '' END AS body_part, count(*) AS n FROM k GROUP BY 1, 2, 3
""")
def reason_class(t: Tables):
    d = t.documents.select("lang", rules.classify_reason(F.lit("Injury/Illness"), F.col("text")).alias("x"))
    return d.groupBy("lang", F.col("x.kind").alias("kind"), F.col("x.body_part").alias("body_part")).agg(F.count(F.lit(1)).alias("n"))


@query("text_labels", "2.2.29-30, 2.11.7", f"""
WITH d AS (SELECT lang, unnest([{', '.join(f"CASE WHEN {_sql_rule('text', p)} THEN '{n}' END" for n, p in rules.BODY_PARTS)}]) AS label FROM documents)
SELECT lang, label, count(*) AS n FROM d WHERE label IS NOT NULL GROUP BY 1, 2
""")
def text_labels(t: Tables):
    d = t.documents.select("lang", F.explode(rules.matching_rules(F.col("text"), rules.BODY_PARTS)).alias("label"))
    return d.groupBy("lang", "label").agg(F.count(F.lit(1)).alias("n"))


@query("normalised_name", "2.2.24, 2.2.71, 2.11.6", r"""
WITH c AS (SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(strip_accents(lower(text)), '[.''\-]', ' ', 'g'), '[^\x00-\x7F]', '', 'g'), '[^a-z0-9 ]', ' ', 'g') AS s FROM documents),
k AS (SELECT doc_id, list_filter(string_split(s, ' '), lambda x: x <> '') AS w FROM c)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_tokens, md5(array_to_string(CASE WHEN len(w) > 1 AND w[-1] IN ('jr', 'sr', 'ii', 'iii', 'iv', 'v') THEN w[:-2] ELSE w END, ' ')) AS key_hash FROM k
""")
def normalised_name(t: Tables):
    return t.documents.select("doc_id", F.size(names.name_tokens(F.col("text"))).cast("long").alias("n_tokens"), F.md5(names.normalize_name(F.col("text"))).alias("key_hash"))


@query("alias_keys", "2.2.25, 2.2.32, 2.2.69", """
SELECT 'customer ' || substr(c_name, 10) AS key, concat(substr(c_name, 10), ' Customer') AS shown, count(*) AS n FROM customer GROUP BY 1, 2
""")
def alias_keys(t: Tables):
    c = t.customer.select(names.alias_key(F.col("c_name")).alias("key"), names.display_name(F.concat(F.lit("Customer, "), F.substring("c_name", 10, 9))).alias("shown"))
    return c.groupBy("key", "shown").agg(F.count(F.lit(1)).alias("n"))


@query("parsed_scalars", "2.2.9-11, 2.2.13, 2.2.26-27, 2.2.39-43, 2.2.75", """
WITH o AS (SELECT o_orderkey k, CAST(o_orderdate AS DATE) d, CAST(floor(o_totalprice) AS BIGINT) p, o_custkey c FROM orders)
SELECT k, round((p % 48) + (p % 60) / 60.0, 6) AS minutes, strftime(d, '%Y-%m-%d') AS day, CAST(60 + p % 12 AS DOUBLE) AS height, (CASE WHEN p % 9 BETWEEN 1 AND 6 THEN p % 9 END)::INTEGER AS years,
       CASE WHEN p % 900 >= 1 THEN CAST((p % 900) * 1000000 AS DOUBLE) END AS amount, (year(d) - CASE WHEN month(d) < 10 THEN 1 ELSE 0 END)::INTEGER AS follows, (year(d) - CASE WHEN month(d) < 7 THEN 1 ELSE 0 END)::INTEGER AS covers,
       CAST(CASE WHEN c % 60 >= 1 THEN c % 60 ELSE 15.5 END AS DOUBLE) AS slot
FROM o
""")
def parsed_scalars(t: Tables):
    o = t.orders.select(F.col("o_orderkey").alias("k"), F.to_date("o_orderdate").alias("d"), F.floor("o_totalprice").cast("long").alias("p"), F.col("o_custkey").alias("c"))
    clock = F.format_string("%d:%02d", F.col("p") % 48, F.col("p") % 60)
    return o.select("k", r(parsing.parse_minutes(clock)).alias("minutes"), text_day(parsing.parse_day(F.upper(F.date_format("d", "MMM d, yyyy")))).alias("day"),
                    parsing.parse_height_inches(F.concat(F.lit("5-"), (F.col("p") % 12).cast("string"))).alias("height"), parsing.parse_years(F.format_string("signed a %d-year deal", F.col("p") % 9)).alias("years"),
                    parsing.parse_amount(F.format_string("worth $%d million", F.col("p") % 900)).alias("amount"), periods.follows_season(F.col("d")).alias("follows"), periods.covers_from_season(F.col("d")).alias("covers"),
                    parsing.pick_slot(F.col("c") % 60, F.lit(1)).alias("slot"))


@query("advisory_rules", "2.2.47-51, 2.2.81-82", """
SELECT c_custkey, CASE WHEN c_nationkey >= 6 THEN -least(2.0, greatest(c_acctbal / 1000, 0)) ELSE 0.0 END AS risk, CASE WHEN c_nationkey / 25.0 >= 0.6 THEN least(5.0, greatest(82.0 - c_acctbal / 100, 0)) ELSE 0.0 END AS upside,
       CASE WHEN abs(c_acctbal - 4500) <= 1000 THEN 'roughly_even' WHEN abs(c_acctbal - 4500) <= 3000 THEN CASE WHEN c_acctbal > 4500 THEN 'lean_your_way' ELSE 'lean_other_way' END WHEN c_acctbal > 4500 THEN 'clear_win' ELSE 'clear_loss' END AS bucket
FROM customer
""")
def advisory_rules(t: Tables):
    c = F.col
    return t.customer.select("c_custkey", flags.advisory_games_risk(c("c_nationkey"), c("c_acctbal") / 1000).alias("risk"), flags.advisory_games_upside(c("c_nationkey") / 25.0, c("c_acctbal") / 100).alias("upside"),
                             flags.confidence_bucket(c("c_acctbal") - 4500, F.lit(1000.0)).alias("bucket"))


@query("entry_clock", "2.3.38-39, 2.2.26", """
WITH f AS (SELECT o_custkey c, min(year(o_orderdate)) y FROM orders GROUP BY 1), p AS (SELECT c, y, CAST(floor(c_acctbal / 200) AS BIGINT) + 6 AS n FROM f JOIN customer ON c_custkey = c)
SELECT c AS player_id, CAST(CASE WHEN y <= 1998 THEN 1998 - y + 1 END AS BIGINT) AS years, y <= 1998 AND 1998 - y + 1 = 4 AND n BETWEEN 1 AND 30 AS final_year, y <= 1998 AND 1998 - y + 1 = 4 AND n BETWEEN 20 AND 30 AS late_final FROM p
""")
def entry_clock_query(t: Tables):
    first = t.orders.groupBy(F.col("o_custkey").alias("player_id")).agg(F.min(F.year("o_orderdate")).cast("long").alias("draft_year"))
    p = first.join(t.customer, F.col("c_custkey") == F.col("player_id")).select("player_id", "draft_year", F.lit(None).cast("long").alias("draft_round"), (F.floor(F.col("c_acctbal") / 200) + 6).cast("long").alias("draft_number"))
    out = entry_clock(p, season=1998)
    return out.select("player_id", F.col("years").cast("long").alias("years"), (F.col("final_year") == 1).alias("final_year"), (F.col("late_final") == 1).alias("late_final"))


@query("fuzzy_match", "2.3.15, 2.1.75", """
WITH s AS (SELECT replace(s_name, 'Supplier#', 'custmer ') n FROM supplier), c AS (SELECT 'customer ' || substr(c_name, 10) n FROM customer)
SELECT s.n AS name, c.n AS candidate, round(1 - levenshtein(s.n, c.n) / greatest(length(s.n), length(c.n)), 6) AS similarity FROM s, c WHERE 1 - levenshtein(s.n, c.n) / greatest(length(s.n), length(c.n)) >= 0.9
""")
def fuzzy_match(t: Tables):
    s = t.supplier.select(F.replace(F.col("s_name"), F.lit("Supplier#"), F.lit("custmer ")).alias("name"))
    c = t.customer.select(names.normalize_name(F.col("c_name")).alias("name"))
    return resolve.close_pairs(s, c, "name").select("name", "candidate", r("similarity").alias("similarity"))


@query("entity_resolution", "2.3.15, 2.1.52, 2.1.76, 2.1.102", """
WITH s AS (SELECT s_suppkey k, CASE s_suppkey % 3 WHEN 0 THEN 'customer ' || substr(s_name, 10) WHEN 1 THEN 'custmer ' || substr(s_name, 10) ELSE 'nobody ' || substr(s_name, 10) END n FROM supplier),
c AS (SELECT c_custkey i, 'customer ' || substr(c_name, 10) n FROM customer),
f AS (SELECT k, count(*) m, any_value(i) i, max(round(1 - levenshtein(s.n, c.n) / greatest(length(s.n), length(c.n)), 3)) sim FROM s, c WHERE s.k % 3 <> 0 AND 1 - levenshtein(s.n, c.n) / greatest(length(s.n), length(c.n)) >= 0.9 GROUP BY 1)
SELECT CAST(s.k AS VARCHAR) AS source_id, coalesce(c.i, CASE WHEN f.m = 1 THEN f.i END) AS player_id, CASE WHEN c.i IS NOT NULL THEN 'exact' WHEN f.m = 1 THEN 'fuzzy' WHEN f.m > 1 THEN 'ambiguous' ELSE 'unmatched' END AS match_method,
       CASE WHEN c.i IS NOT NULL THEN 1.0 WHEN f.m = 1 THEN f.sim END::DOUBLE AS confidence FROM s LEFT JOIN c ON c.n = s.n LEFT JOIN f ON f.k = s.k
""")
def entity_resolution(t: Tables):
    number = F.substring("s_name", 10, 9)
    which = F.when(F.col("s_suppkey") % 3 == 0, "Customer#").when(F.col("s_suppkey") % 3 == 1, "Custmer#").otherwise("Nobody#")
    source = t.supplier.select(F.col("s_suppkey").alias("source_id"), F.concat(which, number).alias("name"))
    known = t.customer.select(F.col("c_custkey").alias("player_id"), F.col("c_name").alias("player_name"), F.lit(None).cast("int").alias("from_year"), F.lit(None).cast("int").alias("to_year"))
    return resolve.match_entities(source, known, source_name="supplier", year_col=None, measure="levenshtein").select("source_id", "player_id", "match_method", "confidence")


@query("unique_substring", "2.3.96, 2.3.49", """
SELECT p.q AS query, CASE WHEN count(DISTINCT c_custkey) = 1 THEN min(c_custkey) END AS player_id FROM (SELECT substr(s_name, 10) q FROM supplier) p LEFT JOIN customer ON contains(c_name, p.q) GROUP BY 1
""")
def unique_substring(t: Tables):
    q = t.supplier.select(F.substring("s_name", 10, 9).alias("query"))
    return resolve.unique_substring_match(q, t.customer.select(F.col("c_custkey").alias("player_id"), F.col("c_name").alias("player_name")))


@query("feed_sentences", "2.2.34-38, 2.2.67-70, 2.1.50-51, 2.3.50", """
WITH o AS (SELECT CAST(o_orderdate AS DATE) d, upper(substr(c_mktsegment, 1, 1)) || lower(substr(c_mktsegment, 2)) AS a, upper(substr(o_orderpriority, 3, 1)) || lower(split_part(substr(o_orderpriority, 4), ' ', 1)) AS b, o_orderstatus s FROM orders JOIN customer ON c_custkey = o_custkey),
k AS (SELECT DISTINCT d, a || ' ' || b AS person, CASE s WHEN 'F' THEN 'signed' WHEN 'O' THEN 'waived' ELSE 'trade_in' END AS kind, CASE s WHEN 'F' THEN 'two_way' ELSE '' END AS detail, CASE s WHEN 'P' THEN 'BOS' END AS other_abbr FROM o)
SELECT kind, person, detail, other_abbr, count(*) AS n FROM k GROUP BY 1, 2, 3, 4
""")
def feed_sentences(t: Tables):
    who = F.concat_ws(" ", F.initcap(F.lower("c_mktsegment")), F.initcap(F.lower(F.split(F.substring("o_orderpriority", 3, 40), " ")[0])))
    said = (F.when(F.col("o_orderstatus") == "F", F.concat(F.lit("Signed G "), who, F.lit(" to a two-way contract.")))
            .when(F.col("o_orderstatus") == "O", F.concat(F.lit("Waived F "), who, F.lit("."))).otherwise(F.concat(F.lit("Acquired C "), who, F.lit(" from Boston for cash considerations."))))
    feed = t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey")).select(F.to_date("o_orderdate").alias("txn_date"), F.lit("NY").alias("team_code"), said.alias("description")).distinct()
    records, _ = feeds.feed_records(feed)
    return records.groupBy("kind", "person", "detail", "other_abbr").agg(F.count(F.lit(1)).alias("n"))


@query("status_overlay", "2.3.40, 2.3.45, 2.3.57-61", """
WITH s AS (SELECT user_id u, arg_max(event_type, (CAST(ts AS DATE), event_type)) st FROM (SELECT user_id, ts, event_type FROM events) GROUP BY 1)
SELECT c_custkey AS player_id, CASE WHEN st = 'error' THEN 'high' WHEN st = 'click' THEN 'watch' ELSE '' END AS risk_level, CASE WHEN st = 'error' THEN 0.2 WHEN st = 'click' THEN 0.03 ELSE 0.0 END::DOUBLE AS haircut
FROM customer LEFT JOIN (SELECT u, st FROM s) x ON x.u = c_custkey
""".replace("arg_max(event_type, (CAST(ts AS DATE), event_type)) st FROM (SELECT user_id, ts, event_type FROM events)", "arg_max(event_type, ts) st FROM events"))
def status_overlay(t: Tables):
    codes = F.when(F.col("event_type") == "error", "OUT").when(F.col("event_type") == "click", "DAY_TO_DAY").otherwise("ACTIVE")
    status = t.events.select(F.col("user_id").alias("player_id"), F.col("ts").alias("snapshot_date"), codes.alias("injury_status"), F.lit(None).cast("timestamp").alias("last_news_date"))
    board = t.customer.select(F.col("c_custkey").alias("player_id"), F.lit(70.0).alias("proj_gp"))
    out = overlays.build_overlay(board, {"status": overlays.status_flags(status, F.lit("2024-02-01").cast("date"))})
    return out.select("player_id", "risk_level", F.col("risk_gp_haircut").alias("haircut"))


@query("cutoff_grid", "2.8.153", """
WITH e AS (SELECT user_id u, CAST(ts AS DATE) d, sum(value) v FROM events GROUP BY 1, 2), k AS (SELECT *, row_number() OVER (PARTITION BY u ORDER BY d) i FROM e), c AS (SELECT unnest([5, 10, 20]) AS cutoff)
SELECT u, CAST(cutoff AS INTEGER) AS cutoff, count(*) FILTER (WHERE i <= cutoff) AS n_seen, round(coalesce(sum(v) FILTER (WHERE i <= cutoff), 0), 2) AS seen, count(*) FILTER (WHERE i > cutoff) AS n_rest, round(coalesce(sum(v) FILTER (WHERE i > cutoff), 0), 2) AS rest FROM k, c GROUP BY 1, 2
""")
def cutoff_grid_query(t: Tables):
    days = t.user_days.select(F.col("user_id").alias("u"), F.lit(1).alias("p"), "d", "v")
    out = cutoff_grid(days, [5, 10, 20], entity="u", period="p", order=["d"], value="v")
    return out.select("u", "cutoff", "n_seen", r("seen", 2).alias("seen"), "n_rest", r("rest", 2).alias("rest"))


@query("shrink_weight_grid", "2.8.107-108, 2.5.17-19", """
WITH a AS (SELECT c_custkey c, c_mktsegment g, row_number() OVER (ORDER BY c_acctbal DESC, c_custkey) ra FROM customer), b AS (SELECT o_custkey c, row_number() OVER (ORDER BY sum(round(o_totalprice, 2)) DESC, o_custkey) rb, count(*) n FROM orders GROUP BY 1),
w AS (SELECT unnest([0.0, 0.25, 0.5, 0.75, 1.0])::DOUBLE w), e AS (SELECT g, w, avg(abs(w * ra + (1 - w) * rb - n * 100)) err FROM a JOIN b USING (c), w GROUP BY 1, 2)
SELECT g AS cell, arg_min(w, (err, w)) AS weight, round(min(err), 4) AS error FROM e GROUP BY 1
""")
def shrink_weight_grid(t: Tables):
    a = with_row_number(t.customer.select(F.col("c_custkey").alias("cust"), F.col("c_mktsegment").alias("cell"), "c_acctbal"), [], [desc("c_acctbal"), asc("cust")], "ra")
    b = with_row_number(t.order_events.groupBy("cust").agg(F.sum(F.round("price", 2)).alias("v"), F.count(F.lit(1)).alias("n")), [], [desc("v"), asc("cust")], "rb")
    rows = a.join(b, "cust").withColumn("actual", F.col("n") * 100)
    out = studies.shrink_weights(rows, "cell", ours="ra", theirs="rb", actual="actual", grid=[0.0, 0.25, 0.5, 0.75, 1.0])
    return out.select("cell", "weight", r("error", 4).alias("error"))


@query("stream_ledger", "2.10.1-4, 2.10.6-7, 2.1.54", """
SELECT user_id, event_type, strftime(min(ts), '%Y-%m-%d') AS first_seen, strftime(max(ts), '%Y-%m-%d') AS last_seen, count(*) AS n_seen FROM events GROUP BY 1, 2
""")
def stream_ledger(t: Tables):
    base = ensure_checkpoint_dir(t.spark) + f"/stream_ledger_{uuid.uuid4().hex}"
    stream = t.spark.readStream.schema(t.events.schema).option("pathGlobFilter", "events.parquet").parquet(t.folder)
    key = ["user_id", "event_type"]
    ledger.start_ledger(stream.select(*key, "ts"), base + "/rows", base + "/position", key, ledger.sightings(key, "ts", []), buckets=8).awaitTermination()
    out = ledger.read_ledger(t.spark, base + "/rows")
    return out.select(*key, text_day("first_seen").alias("first_seen"), text_day("last_seen").alias("last_seen"), "n_seen")


@query("stream_windows", "2.10.8-9", """
SELECT strftime(CAST(ts AS DATE), '%Y-%m-%d') AS day, event_type, count(*) AS n, round(sum(value), 2) AS v FROM events GROUP BY 1, 2
""")
def stream_windows(t: Tables):
    base = ensure_checkpoint_dir(t.spark) + f"/stream_windows_{uuid.uuid4().hex}"
    stream = t.spark.readStream.schema(t.events.schema).option("pathGlobFilter", "events.parquet").parquet(t.folder)
    counts = windows.tumbling_counts(stream, "ts", ["event_type"], "1 day", value="value")

    def keep(batch, batch_id):
        batch.write.mode("overwrite").parquet(f"{base}/rows/batch={batch_id}")

    counts.writeStream.outputMode("complete").foreachBatch(keep).option("checkpointLocation", base + "/position").trigger(availableNow=True).start().awaitTermination()
    rows = t.spark.read.parquet(base + "/rows")
    newest = rows.where(F.col("batch") == rows.agg(F.max("batch")).scalar())
    return newest.select(text_day("start").alias("day"), "event_type", "n", r("v", 2).alias("v"))


@query("pending_games", "2.1.82, 2.10.5", """
WITH m AS (SELECT l_orderkey o, sum(l_quantity) q FROM lineitem GROUP BY 1)
SELECT CAST(o AS VARCHAR) AS game_id, CASE WHEN CAST(q AS BIGINT) % 2 = 0 THEN 'final' ELSE 'pending' END AS status FROM m
""")
def pending_games(t: Tables):
    members = t.lineitem.select(F.col("l_orderkey").cast("string").alias("game_id"), F.lit(1).alias("team_id"), F.lit("member").alias("kind"), F.concat_ws("|", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_shipdate").alias("row_id"), F.col("l_quantity").alias("value"))
    total = members.groupBy("game_id").agg(F.sum("value").alias("q"))
    side = total.select("game_id", F.lit(1).alias("team_id"), F.lit("side").alias("kind"), F.lit("s").alias("row_id"), F.when(F.col("q").cast("long") % 2 == 0, F.col("q")).otherwise(F.col("q") + 1).alias("value"))
    return pending.pending_batch(members.unionByName(side), groups=1).select("game_id", "status")


@query("absence_profile_box", "2.4.23-26, 2.4.37", """
WITH g AS (SELECT DISTINCT o_custkey p, c_nationkey t, year(o_orderdate) y, CAST(o_orderdate AS DATE) d FROM orders JOIN customer ON c_custkey = o_custkey),
s AS (SELECT t, y, d, row_number() OVER (PARTITION BY t, y ORDER BY d) - 1 AS idx, count(*) OVER (PARTITION BY t, y) AS len FROM (SELECT DISTINCT t, y, d FROM g)),
x AS (SELECT g.p, g.y, idx, len, idx - lag(idx) OVER (PARTITION BY g.p, g.y ORDER BY idx) - 1 AS gap FROM g JOIN s USING (t, y, d))
SELECT p AS player_id, y AS s, any_value(len) AS n_events, count(*) AS gp, min(idx) AS first_idx, greatest(coalesce(max(gap), 0), min(idx), any_value(len) - 1 - max(idx)) AS longest_run FROM x GROUP BY 1, 2
""")
def absence_profile_box(t: Tables):
    rows = t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey")).select(F.col("o_custkey").alias("player_id"), F.col("c_nationkey").alias("team_id"), F.year("o_orderdate").alias("s"), F.to_date("o_orderdate").alias("game_date"))
    rows = rows.withColumn("game_id", F.col("game_date").cast("string"))
    out = sequences.absence_profile(rows, rows.select("team_id", "s", "game_id", "game_date").distinct())
    return out.select("player_id", "s", "n_events", "gp", "first_idx", "longest_run")


@query("event_context_table", "2.4.28-31, 2.4.33")
def event_context_table(t: Tables):
    logs = box.game_logs(t).withColumn("event_season", F.col("season")).withColumn("context", F.when(F.month("game_date") < 9, "summer_league").otherwise("preseason"))
    games = box.team_games(t).withColumn("event_season", F.col("season")).withColumn("context", F.when(F.month("game_date") < 9, "summer_league").otherwise("preseason"))
    out = event_table(logs, games, box.SCORING, min_minutes=12.0)
    return out.select("player_id", "event_season", "sl_gp", "pre_gp", r("sl_fp36", 4).alias("sl_fp36"), r("pre_fp36", 4).alias("pre_fp36"), r("sl_z", 4).alias("sl_z"), r("pre_z", 4).alias("pre_z"))


@query("walk_forward_naive", "2.8.94-95, 2.4.17, 2.1.92")
def walk_forward_naive(t: Tables):
    result = walk_forward(box.history_tables(t), NaiveLastSeason(box.SCORING, min_games=2), [1998, 1999], box.SCORING, min_gp=1)
    return result.seasons.select("season", *[r(c, 4).alias(c) for c in ("mae_total_fp", "spearman_total_fp", "top50_hit", "ndcg_50", "share_in_p10_p90")])


@query("baseline_projection", "2.8.1-26, 2.8.40-41, 2.8.165-170, 2.11.1-3")
def baseline_projection(t: Tables):
    projector = BaselineProjector(box.SCORING, BaselineConfig(vol_min_games=2, vol_quantile_min_games=2))
    out = cut_lineage(projector.project(History.until(box.history_tables(t), 2000)))      # the board reads it several times
    ranked = value.build_board(out, None, value.LeagueShape(10, (("UTIL", 10),), 3), season_games=80.0, positional="off")
    return ranked.select("rank", "player_id", "tier", *[r(c, 4).alias(c) for c in ("proj_gp", "proj_mpg", "proj_fppg", "proj_total_fp", "vorp")])

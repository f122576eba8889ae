import json
import tempfile
import time
from datetime import date

import pytest
from pyspark.sql import functions as F

from tallyline.sources import contracts, feeds, pages, payloads, rankings, store
from tallyline.streaming import ledger, pending, windows


def folder():
    return tempfile.mkdtemp(prefix="run-", dir="/tmp")


GOOD = {"season": "2020-21", "game_id": "0022000001", "game_date": date(2021, 1, 1), "player_id": 1, "player_name": "A", "team_id": 5, "team_abbr": "BOS", "matchup": "x", "min": 30.0, "fgm": 5, "fga": 10, "fg3m": 1,
        "fg3a": 2, "ftm": 2, "fta": 2, "oreb": 1, "dreb": 3, "reb": 4, "ast": 1, "stl": 1, "blk": 0, "tov": 2, "pf": 1, "pts": 13, "plus_minus": 1.0}


@pytest.mark.parametrize("change,problem", [({}, None), ({"fgm": 11, "pts": 25}, "fgm > fga"), ({"reb": 9}, "reb != oreb + dreb"), ({"pts": 1}, "pts != 2*fgm + fg3m + ftm"), ({"min": 0.0}, "min <= 0"), ({"player_id": None}, "player_id is null")])
def test_contract_mutations(spark, change, problem):
    df = spark.createDataFrame([GOOD | change], contracts.GAME_LOGS.schema if change.get("player_id", 1) else contracts.T.StructType([contracts.T.StructField(f.name, f.dataType, True) for f in contracts.GAME_LOGS.schema]))
    if problem is None:
        contracts.validate(df, "game_logs")
        with pytest.raises(contracts.ContractError, match="duplicate key"):
            contracts.validate(df.union(df), "game_logs")
    else:
        with pytest.raises(contracts.ContractError) as e:
            contracts.validate(df, "game_logs")
        assert problem in str(e.value)


def test_store_round_trip_replaces_partitions(spark):
    base = folder()
    df = spark.createDataFrame([GOOD, GOOD | {"season": "2021-22", "game_id": "0022100001"}], contracts.GAME_LOGS.schema)
    store.write_table(df, base, "game_logs")
    store.write_table(df.where("season = '2021-22'").withColumn("player_name", F.lit("B")), base, "game_logs")
    got = {r["season"]: r["player_name"] for r in store.read_table(spark, base, "game_logs", check=True).collect()}
    assert got == {"2020-21": "A", "2021-22": "B"}
    assert store.connect(spark, base) == ["game_logs"] and "game_logs" in store.available_tables(spark)
    assert store.query(spark, "SELECT count(*) n FROM game_logs WHERE season = :s", {"s": "2020-21"}).first()["n"] == 1


def test_payload_rows_drop_with_reasons(spark):
    base = folder()
    head = ["PLAYER_ID", "PLAYER_NAME", "TEAM_ID", "TEAM_ABBREVIATION", "GAME_ID", "GAME_DATE", "MATCHUP", "MIN", *[c.upper() for c in contracts.COUNTS]]
    row = lambda pid, gid, m: [str(x) for x in (pid, "A", 5, "BOS", gid, "2021-01-01T00:00:00", "BOS vs. NYK", m, 5, 10, 1, 2, 2, 2, 1, 3, 4, 1, 1, 0, 2, 1, 13)]       # noqa: E731
    data = [row(1, "0022000001", "30:30"), row(1, "0022000001", "30:30"), row(1, "0022000001", "20"), row(2, "0012000001", "30"), row(3, "0022000001", "0")]
    with open(base + "/a.json", "w") as f:
        json.dump({"resultSets": [{"name": "PlayerGameLogs", "headers": head, "rowSet": data}]}, f)
    kept, counts = payloads.game_logs(payloads.read_json_files(spark, base, payloads.RESULT_SCHEMA).drop("source_file"), "2020-21")
    assert [(r["player_id"], r["min"], r["pts"]) for r in kept.collect()] == [(1, 30.5, 13)]
    assert {r["reason"]: r["n_rows"] for r in counts.collect()} == {"not a regular-season game": 1, "did not play": 1, "identical duplicate": 1, "conflicting duplicate": 1}


def test_feed_sentences(spark):
    said = [("GS", "Signed G Buddy Hield to a two-way contract. Waived F P.J. Tucker."), ("BOS", "Acquired F Luka Doncic from Dallas in exchange for G Payton Pritchard and cash considerations."),
            ("DAL", "Fired head coach Ann Bell."), ("MIA", "Traded G Tyler Herro to the L.A. Clippers for F Norman Powell."), ("MIA", "Nobody understands this.")]
    df = spark.createDataFrame(said, "team_code string, description string").withColumn("txn_date", F.lit("2026-07-01").cast("date"))
    records, counts = feeds.feed_records(df)
    got = {(r["team_abbr"], r["kind"], r["person"], r["other_abbr"], r["detail"]) for r in records.collect()}
    assert got == {("GSW", "signed", "Buddy Hield", None, "two_way"), ("GSW", "waived", "P.J. Tucker", None, ""), ("BOS", "trade_in", "Luka Doncic", "DAL", ""), ("BOS", "trade_out", "Payton Pritchard", "DAL", ""),
                   ("DAL", "fired", "Ann Bell", None, "head_coach"), ("MIA", "trade_out", "Tyler Herro", "LAC", ""), ("MIA", "trade_in", "Norman Powell", "LAC", ""), ("MIA", "other", "", None, "")}
    assert counts.first()["unparsed_sentences"] == 1
    assert spark.range(1).select(feeds.team_from_text(F.lit("Los Angeles"))).first()[0] is None
    moves = feeds.move_events(records.withColumn("subject_type", F.col("subject_type")))
    assert {(r["person"], r["from_abbr"], r["to_abbr"]) for r in moves.where("kind = 'trade'").collect()} == {("Luka Doncic", "DAL", "BOS"), ("Payton Pritchard", "BOS", "DAL"), ("Tyler Herro", "MIA", "LAC"), ("Norman Powell", "LAC", "MIA")}


PAGE = """==Transactions==
===Additions===
{| class="wikitable"
|-
| [[Ann Bell]] || July 9 || Signed two-year contract worth $5 million || [[Boston Celtics]]
|-
| [[Cole Day]] || March 1, 2024 || 10-day contract
|}
===Subtractions===
{|
|-
| [[Eve Fox]] || July 1, 2023 || Waived
|}
==Other==
"""


def test_page_tables(spark):
    df = spark.createDataFrame([("2023-24", 1, "Miami Heat", PAGE)], "season string, team_id long, team_name string, text string")
    moves, counts = pages.move_rows(df, ["Boston Celtics", "Miami Heat"])
    assert {(r["direction"], r["wiki_name"], str(r["txn_date"])) for r in moves.collect()} == {("in", "Ann Bell", "2023-07-09"), ("in", "Cole Day", "2024-03-01"), ("out", "Eve Fox", "2023-07-01")}
    got = {r["wiki_name"]: (r["event"], r["contract_type"], r["years"], r["amount_usd"], r["days"], r["season"], r["start_year"]) for r in pages.contract_rows(df, ["Boston Celtics", "Miami Heat"]).collect()}
    assert got == {"Ann Bell": ("sign", "standard", 2, 5e6, None, "2022-23", 2023), "Cole Day": ("sign", "ten_day", None, None, 10, "2023-24", 2023), "Eve Fox": ("waived", "", None, None, None, "2022-23", 2023)}
    coach = spark.createDataFrame([("2023-24", 1, "| coach = [[Pat Rye]] (fired)<br>[[Wes Lee Jr.]] (interim)")], "season string, team_id long, text string")
    assert [(r["seq"], r["coach_key"], r["status"], r["n_coaches"]) for r in pages.coach_rows(coach).orderBy("seq").collect()] == [(0, "pat rye", "fired", 2), (1, "wes lee", "interim", 2)]


REPORT = """Injury Report: 01/15/24 05:30 PM
Game Date  Game Time  Matchup  Team  Player Name  Current Status  Reason
01/15/2024  07:00 (ET)  BOS@TOR  Boston Celtics  Bell, Ann  Out  Injury/Illness - Left Knee;
Sprain
Day Jr., Cole  Questionable  Rest
Toronto Raptors  NOT YET SUBMITTED
"""


def test_report_text(spark):
    got = pages.report_rows(spark.createDataFrame([("f", REPORT)], "source_file string, text string")).collect()
    assert {(r["player_name"], r["team"], r["status"], r["category"], r["detail"], str(r["game_date"]), r["matchup"]) for r in got} == {
        ("Ann Bell", "Boston Celtics", "Out", "Injury/Illness", "Left Knee; Sprain", "2024-01-15", "BOS@TOR"), ("Cole Day Jr.", "Boston Celtics", "Questionable", "Rest", "", "2024-01-15", "BOS@TOR")}


def test_expert_csv(spark):
    path = folder() + "/r.csv"
    with open(path, "w") as f:
        f.write('RK,PLAYER NAME,ECR VS. ADP\n1,"Nikola Jokic (DEN - C) ",0\n2,"Ann Bell (BOS - PG,SG) IR",+3\n')
    got = rankings.expert_ranking(rankings.read_ranking_csv(spark, path, ["RK", "PLAYER NAME", "ECR VS. ADP"])).orderBy("ext_rank").collect()
    assert [(r["name"], r["team"], r["positions"], r["status_tag"], r["ecr_vs_adp"]) for r in got] == [("Nikola Jokic", "DEN", "C", None, 0), ("Ann Bell", "BOS", "PG,SG", "IR", 3)]
    with pytest.raises(ValueError):
        rankings.read_ranking_csv(spark, path, ["NOPE"])


def test_stream_ledger_survives_replay(spark):
    src, out, pos = folder(), folder() + "/rows", folder()
    mk = lambda rows: spark.createDataFrame(rows, "k string, ts timestamp_ntz")         # noqa: E731
    rule = ledger.sightings(["k"], "ts", [])
    read = lambda: spark.readStream.schema("k string, ts timestamp_ntz").parquet(src)
    from datetime import datetime
    mk([("a", datetime(2024, 1, 2)), ("b", datetime(2024, 1, 3))]).write.mode("append").parquet(src)
    ledger.start_ledger(read(), out, pos, ["k"], rule, buckets=4).awaitTermination()
    mk([("a", datetime(2024, 1, 1)), ("c", datetime(2024, 1, 5))]).write.mode("append").parquet(src)
    ledger.start_ledger(read(), out, pos, ["k"], rule, buckets=4).awaitTermination()
    want = {"a": (datetime(2024, 1, 1), datetime(2024, 1, 2), 2), "b": (datetime(2024, 1, 3), datetime(2024, 1, 3), 1), "c": (datetime(2024, 1, 5), datetime(2024, 1, 5), 1)}
    get = lambda: {r["k"]: (r["first_seen"], r["last_seen"], r["n_seen"]) for r in ledger.read_ledger(spark, out).collect()}      # noqa: E731
    assert get() == want
    # the last micro-batch is delivered once more under its own id
    ledger.ledger_batch(out, ["k"], rule, buckets=4)(mk([("a", datetime(2024, 1, 1)), ("c", datetime(2024, 1, 5))]), 1)
    assert get() == want


def test_stream_ledger_goes_on_after_a_reset(spark):
    from datetime import datetime
    src, out = folder(), folder() + "/rows"
    rule, schema = ledger.sightings(["k"], "ts", []), "k string, ts timestamp_ntz"
    for turn, k in enumerate(["a", "b", "a"]):
        spark.createDataFrame([(k, datetime(2024, 1, 1 + turn))], schema).write.mode("append").parquet(f"{src}/old")
        ledger.start_ledger(spark.readStream.schema(schema).parquet(f"{src}/old"), out, f"{src}/position", ["k"], rule, buckets=1).awaitTermination()
    spark.createDataFrame([("z", datetime(2024, 2, 1))], schema).write.parquet(f"{src}/new")
    for _ in range(2):                                       # a new position; then nothing new under it
        ledger.start_ledger(spark.readStream.schema(schema).parquet(f"{src}/new"), out, f"{src}/reset", ["k"], rule, buckets=1).awaitTermination()
    assert {r["k"]: r["n_seen"] for r in ledger.read_ledger(spark, out).collect()} == {"a": 2, "b": 1, "z": 1}


def test_unreadable_ledger_is_an_error(spark):
    out = folder()
    assert ledger.read_ledger(spark, out + "/none") is None
    spark.range(1).write.parquet(out + "/mixed/a=1")
    spark.range(1).write.parquet(out + "/mixed/b=1/c=2")
    with pytest.raises(Exception):
        ledger.read_ledger(spark, out + "/mixed")


def test_window_batch_counts_from_the_newest_day_of_the_ledger(spark):
    from datetime import date
    out = folder() + "/rows"
    mk = lambda rows: spark.createDataFrame(rows, "k int, day date, v int")             # noqa: E731
    put = ledger.window_batch(out, ["k"], "day", overlap_days=3, buckets=8)
    put(mk([(1, date(2024, 1, 1), 10), (2, date(2024, 1, 9), 20), (3, date(2024, 1, 10), 30)]), 0)
    get = lambda: {r["k"]: r["v"] for r in ledger.read_ledger(spark, out).collect()}     # noqa: E731
    assert get() == {2: 20, 3: 30}
    for _ in range(2):                                       # a late batch, delivered twice
        put(mk([(4, date(2024, 1, 2), 40), (2, date(2024, 1, 9), 21)]), 1)
        assert get() == {2: 21, 3: 30}


def test_pending_games_stream_equals_batch(spark):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", pending.ROCKSDB)
    src = folder()
    schema = "game_id string, team_id int, kind string, row_id string, value double"
    first = [("g1", 1, "side", "s", 10.0), ("g1", 1, "member", "a", 6.0), ("g2", 1, "side", "s", 5.0)]
    second = [("g1", 2, "side", "s", 7.0), ("g1", 2, "member", "b", 7.0), ("g1", 1, "member", "c", 4.0)]
    name = "pending_rows"
    spark.createDataFrame(first, schema).coalesce(1).write.mode("append").parquet(src)
    spark.createDataFrame(second, schema).coalesce(1).write.mode("append").parquet(src)
    q = pending.pending_games(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(src)).writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", folder()).start()
    try:
        for _ in range(60):
            if spark.table(name).count():
                break
            time.sleep(1)
    finally:
        q.stop()
    assert [tuple(r) for r in spark.table(name).collect()] == [("g1", "final", 2)]
    batch = {r["game_id"]: r["status"] for r in pending.pending_batch(spark.createDataFrame(first + second, schema)).collect()}
    assert batch == {"g1": "final", "g2": "pending"}


def test_batch_sessions_equal_the_native_window(spark):
    from datetime import datetime, timedelta
    t0 = datetime(2024, 1, 1)
    df = spark.createDataFrame([("u", t0 + timedelta(hours=h)) for h in (0, 3, 7.5, 15.5, 15.6, 40)], "u string, ts timestamp_ntz")
    got = [(r["n"]) for r in windows.sessions(df, "ts", ["u"], "8 hours").orderBy("start").collect()]
    native = [r["n"] for r in df.groupBy("u", F.session_window(F.col("ts").cast("timestamp"), "8 hours")).agg(F.count(F.lit(1)).alias("n")).orderBy("session_window").collect()]
    assert got == native == [5, 1]

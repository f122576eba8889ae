import random
from datetime import date, timedelta

import pytest
from pyspark.sql import functions as F

from tallyline.operators import sequences as S
from tallyline.operators.folds import deal_state
from tallyline.operators.matching import nearest_controls


def test_absence_profile_by_hand(spark):
    start = date(2024, 1, 1)
    days = [start + timedelta(days=d) for d in (0, 1, 3, 4, 6, 8, 9, 11)]        # back to backs at positions 1, 3 and 6
    sched = spark.createDataFrame([(1, 2023, f"g{i}", d) for i, d in enumerate(days)], "team_id long, s int, game_id string, game_date date")
    seen = spark.createDataFrame([(7, 1, 2023, f"g{i}") for i in (2, 4, 7)] + [(7, 9, 2023, "x")], "player_id long, team_id long, s int, game_id string")
    r = S.absence_profile(seen, sched).first()
    # misses: 0,1 | 3 | 5,6; plays 2,4,7
    assert (r.n_events, r.gp, r.missed, r.first_idx, r.tail_len) == (8, 3, 5, 2, 6)
    assert (r.n_runs, r.longest_run, r.block_start, r.block_len, r.block_tail) == (3, 2, 5, 2, 1)
    assert (r.iso_n, r.iso_runs, r.rest_n, r.n_groups) == (3, 2, 1, 2)


def test_runs_at_both_edges(spark):
    rows = spark.createDataFrame([("a", i, f) for i, f in enumerate([True, True, False, True])] + [("b", 0, False)], "k string, i int, f boolean")
    got = {r["k"]: (r["longest"], r["n_runs"], r["n_true"]) for r in S.run_stats(rows, ["k"], "i", "f").collect()}
    assert got == {"a": (2, 2, 3), "b": (0, 0, 0)}
    assert [tuple(r) for r in S.trailing_run(rows, ["k"], "i", "f").collect()] == [("a", 1)]


def test_anchored_dedupe_matches_a_plain_walk(spark):
    rng = random.Random(3)
    base = date(2024, 1, 1)
    rows = [(i, rng.choice("ab"), base + timedelta(days=rng.randrange(60)), rng.randrange(2)) for i in range(120)] + [(999, "a", None, 0)]
    got = {r["id"] for r in S.anchored_dedupe(spark.createDataFrame(rows, "id long, k string, d date, p int"), ["k"], "d", "p", "id").collect()}
    kept = {999}
    for key in "ab":
        last = None
        for row in sorted((r for r in rows if r[1] == key and r[2]), key=lambda r: (r[2], r[3], r[0])):
            if last is None or (row[2] - last[2]).days > 7:
                last = row
                kept.add(row[0])
            elif last[3] > row[3]:
                kept.discard(last[0])
                last = row
                kept.add(row[0])
    assert got == kept


def test_yearless_days_roll_forward(spark):
    rows = [(1, 1, "2023-07-01", "cell", None), (1, 2, "2024-03-01", "cell", None), (1, 3, "2023-07-05", "cell_no_year", None), (1, 4, "2023-08-01", "cell_no_year", "2023-08-02"), (2, 1, "2023-07-05", "cell_no_year", None)]
    df = spark.createDataFrame(rows, "page int, n int, d string, src string, cite string").select("page", "n", F.col("d").cast("date").alias("d"), "src", F.col("cite").cast("date").alias("cite"), F.lit("2025-01-01").cast("date").alias("cap"))
    got = {(r["page"], r["n"]): str(r["d"]) for r in S.roll_yearless_days(df, ["page"], "n", "d", "src", "cite", "cap").collect()}
    assert got == {(1, 1): "2023-07-01", (1, 2): "2024-03-01", (1, 3): "2024-07-05", (1, 4): "2023-08-01", (2, 1): "2023-07-05"}


def walk(events, at):
    fin, have, active, ext, cov = None, False, False, False, None
    for kind, start, length in events:
        if kind in ("deal", "extension"):
            if kind == "extension":
                base = max(fin, start) if active and fin is not None else start
                fin = base + length if length else None
            else:
                fin = start + length - 1 if length else None
            have, active, ext, cov = True, True, kind == "extension", start
        elif kind == "end" and have:
            active = False
        elif kind == "resume" and have:
            active = True
    if not have:
        return ("unknown", None, False)
    if not active or (fin is not None and fin < at):
        return ("lapsed", None, False)
    return ("no_length", None, ext) if fin is None else ("known", fin - at + 1, ext)


def test_deal_state_equals_the_walk_even_when_split(spark):
    rng = random.Random(5)
    rows, want = [], {}
    for e in range(60):
        events = [(rng.choice(["deal", "extension", "extension", "end", "resume"]), rng.randrange(20), rng.choice([None, 1, 2, 3, 4])) for _ in range(rng.randrange(1, 40 if e else 400))]
        want[e] = walk(events, 12)
        rows += [(e, i, *ev) for i, ev in enumerate(events)]
    df = spark.createDataFrame(rows, "e int, i int, kind string, start int, length int")
    for kw in ({}, {"rows_per_task": 50}):
        got = {r["e"]: (r["status"], r["remaining"], r["extension"]) for r in deal_state(df, "e", order=["i"], kind="kind", start="start", length="length", at=12, **kw).collect()}
        assert got == want


def test_nearest_controls_equal_brute_force(spark):
    rng = random.Random(1)
    cases = [(i, rng.choice("ab"), rng.randrange(50) / 2) for i in range(30)]
    pool = [(100 + i, rng.choice("ab"), rng.randrange(50) / 2) for i in range(80)]
    mk = lambda rows: spark.createDataFrame(rows, "id long, g string, v double")       # noqa: E731
    got = {(r["case_id"], r["control_id"]) for r in nearest_controls(mk(cases), mk(pool), group=["g"], value="v", entity="id", k=3, caliper=2.0).collect()}
    want = set()
    for i, g, v in cases:
        near = sorted((abs(v - w), j) for j, h, w in pool if h == g and abs(v - w) <= 2.0)[:3]
        want |= {(i, j) for _, j in near}
    assert got == want


def test_with_without_in_cells(spark, capsys, monkeypatch):
    """Rows of pairs and events are never shuffled; cells of two entities give the rows of a plain sum, repeated and unknown values included."""
    import re

    from tallyline.operators import trends

    monkeypatch.setattr(trends, "PAIR_BLOCK", 2)
    nan, inf = float("nan"), float("inf")
    rows = [(e, e % 2, 1, f"{e % 2}|{d}", f"2024-01-{d:02d}", {(3, 4): None, (4, 5): nan, (2, 6): inf}.get((e, d), float(e * d))) for e in range(8) for d in range(1, 13) if (e * 5 + d) % 3 or d == 1]
    rows += [rows[4], (None, 0, 1, "0|2", "2024-01-02", 5.0)]
    logs = spark.createDataFrame(rows, "u long, g long, p int, e string, s string, v double").withColumn("d", F.to_date("s"))
    roles = S.Roles("u", "g", "p", "e", "d")
    df = trends.with_without(logs, logs.select("g", "p", "e", "d").distinct(), logs.select("u", "g").distinct(), roles, minutes="v")
    got = {(r["out_id"], r["mate_id"]): (r["n_out"], r["observed_gain"]) for r in df.collect()}
    df.explain()
    assert not re.search(r"hashpartitioning\(out_id#\d+L?, mate_id", capsys.readouterr().out)
    want = {}
    for o in range(8):
        mine, days = {r[4] for r in rows if r[0] == o}, {r[4] for r in rows if r[1] == o % 2}
        for m in range(o % 2, 8, 2):
            side = lambda there: [r[5] for r in rows if r[0] == m and (r[4] in mine) == there and r[4] >= min(mine)]     # noqa: B023, E731
            out, inn = side(False), side(True)
            n_out = len({x for x in days if x >= min(mine)} - mine)
            if m != o and n_out >= 3 and len(mine) >= 3 and len(out) >= 2 and len(inn) >= 3:
                mean = lambda v: sum(x for x in v if x is not None) / sum(x is not None for x in v)      # noqa: E731
                want[o, m] = (n_out, mean(out) - mean(inn))
    assert got.keys() == want.keys() and want
    assert all(got[k][0] == n and got[k][1] == pytest.approx(x, nan_ok=True) for k, (n, x) in want.items())


def test_with_without_deals_a_mate_once_for_a_block_of_absent_entities(spark, monkeypatch):
    """However many entities a step takes, a mate's row goes to one cell for ``HELD_EVENTS`` events of the absent entities; any sizes give the same rows."""
    import pyarrow as pa

    from tallyline.operators import trends

    rows = [(f"u{e}", 0, 1, f"0|{d}", f"2024-01-{d:02d}", float(e * d % 7)) for e in range(30) for d in range(1, 13) if (e * 5 + d) % 3 or d == 1]
    rows += [(f"u{e}", 1, 1, f"1|{d}", f"2024-01-{d:02d}", float(e + d)) for e in range(20, 34) for d in range(1, 13) if (e + d) % 2]
    logs = spark.createDataFrame(rows, "u string, g long, p int, e string, s string, v double").withColumn("d", F.to_date("s"))
    pairs = lambda: trends.with_without(logs, logs.select("g", "p", "e", "d").distinct(), logs.select("u", "g").distinct(), S.Roles("u", "g", "p", "e", "d"), minutes="v")
    want = {(r["out_id"], r["mate_id"]): (r["n_out"], r["observed_gain"]) for r in pairs().collect()}
    assert len(want) > 300 and any(v[1] is not None for v in want.values())
    for sizes in ({"PAIR_BLOCK": 2}, {"PAIR_BLOCK": 3, "HELD_EVENTS": 40, "CELL_PAIRS": 9}, {"PAIR_BLOCK": 2, "CALENDAR_ROWS": 0}):
        with monkeypatch.context() as m:
            for name, value in sizes.items():
                m.setattr(trends, name, value)
            out = pairs().collect()
            got = {(r["out_id"], r["mate_id"]): (r["n_out"], r["observed_gain"]) for r in out}
            assert len(out) == len(got) and got.keys() == want.keys()
            assert all(got[k][0] == want[k][0] and got[k][1] == pytest.approx(want[k][1], abs=1e-9) for k in want)

    def dealt(*_):
        """A row for each mate's row that comes to a task."""
        def of(batches):
            for batch in batches:
                ids = batch.column("_id").filter(pa.compute.equal(batch.column("_side"), 1))
                yield pa.record_batch({"out_id": ids, "mate_id": ids, "n_out": pa.array([0] * len(ids), pa.int64()), "observed_gain": pa.array([0.0] * len(ids))})
        return of

    monkeypatch.setattr(trends, "_gains", dealt)
    monkeypatch.setattr(trends, "PAIR_BLOCK", 2)
    # lists of groups: 0 alone, 1 alone, both; a mate meets each list that has an event of its own
    met = sum(1 for e in range(34) for groups in ({0}, {1}, {0, 1}) if (e < 30 and 0 in groups) or (20 <= e and 1 in groups))
    assert pairs().count() == met

import difflib
import random
from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from tallyline.operators import diffs, merge, resolve, views


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_upsert_never_erases(spark):
    old = spark.createDataFrame([(1, "a", 5), (2, "b", None)], "id int, n string, x int")
    new = spark.createDataFrame([(1, None, 6), (3, "c", 1)], "id int, n string, x int")
    assert {r["id"]: (r["n"], r["x"]) for r in merge.upsert(old, new, ["id"]).collect()} == {1: ("a", 6), 2: ("b", None), 3: ("c", 1)}


def test_window_merge_keeps_held_games_and_refuses_to_shrink(spark):
    old = spark.createDataFrame([("g1", date(2024, 1, 1), 1), ("g2", date(2024, 1, 2), 1), ("g3", date(2024, 1, 3), 1)], "game_id string, d date, v int")
    new = spark.createDataFrame([("g2", date(2024, 1, 2), 9), ("g3", date(2024, 1, 3), 9)], "game_id string, d date, v int")
    held = spark.createDataFrame([("g3",)], "game_id string")
    out = merge.replace_window_keep(old, new, in_window=F.col("d") >= F.lit("2024-01-02").cast("date"), key=["game_id"], keep=held)
    assert [(r[0], r[2]) for r in rows(out)] == [("g1", 1), ("g2", 9), ("g3", 1)]
    with pytest.raises(merge.ShrinkRefused):
        merge.guarded(old, new)


def ledger_rows(spark, items, seen):
    rows_ = [(k, date(2024, 1, 1), 1, d, p, seen, seen) for k, d, p in items]
    return spark.createDataFrame(rows_, "txn_key string, txn_date date, team_id int, description string, player_id int, first_seen timestamp, last_seen timestamp")


def test_ledger_is_idempotent_and_supersedes(spark):
    sig = ["txn_date", "team_id", "description"]
    t1, t2 = datetime(2024, 1, 2), datetime(2024, 1, 3)
    first = merge.merge_ledger(None, ledger_rows(spark, [("a", "Signed A.", None), ("b", "Waived B.", 2)], t1), signature=sig)
    pull = ledger_rows(spark, [("a", "Signed A.", 7), ("c", "Waived B.", 2)], t2)          # the second text is read differently now
    again = merge.merge_ledger(first, pull, signature=sig)
    got = {r["txn_key"]: (r["player_id"], r["first_seen"], r["last_seen"]) for r in again.collect()}
    assert got == {"a": (7, t1, t2), "c": (2, t1, t2)}
    assert rows(merge.merge_ledger(again, pull, signature=sig)) == rows(again)


def test_layers_and_snapshots(spark):
    a = spark.createDataFrame([(1, None), (2, "x")], "id int, n string")
    b = spark.createDataFrame([(1, "y"), (2, "z"), (3, "w")], "id int, n string")
    assert rows(merge.layered([a, b], ["id"], ["n"])) == [(1, "y"), (2, "x"), (3, "w")]
    p = spark.createDataFrame([(1, "A"), (2, "A"), (3, "B")], "player_id int, team_id string")
    c = spark.createDataFrame([(1, "A"), (2, "B"), (4, "C")], "player_id int, team_id string")
    assert [(r[0], r[1]) for r in rows(diffs.membership_moves(p, c))] == [(2, "moved"), (3, "departed"), (4, "arrived")]


def test_point_in_time_view_and_leak_checks(spark):
    logs = spark.createDataFrame([("2020-21", 1, 5.0), ("2021-22", 1, 6.0), ("2021-22", 2, 7.0)], "season string, player_id int, v double")
    players = spark.createDataFrame([(1, 2019, 2020, 2021), (2, 2021, 2021, 2021), (3, 2030, None, None)], "player_id int, draft_year int, from_year int, to_year int")
    h = views.History.until({"game_logs": logs, "player_season_bio": logs, "team_games": logs, "players": players}, 2021)
    h.assert_no_future()
    assert h.last_period() == 2020 and rows(h["players"].select("player_id", "from_year", "to_year")) == [(1, 2020, 2020), (2, None, 2020)]
    with pytest.raises(views.LeakageError):
        views.assert_no_future(logs, 2021)
    honest = lambda t: views.before_period(t["game_logs"], 2021).groupBy("player_id").agg(F.sum("v").alias("v"))      # noqa: E731
    cheat = lambda t: t["game_logs"].groupBy("player_id").agg(F.sum("v").alias("v"))                                  # noqa: E731
    views.assert_ignores_future(honest, {"game_logs": logs}, 2021, {"game_logs": ["v"]}, ["player_id"])
    with pytest.raises(views.LeakageError):
        views.assert_ignores_future(cheat, {"game_logs": logs}, 2021, {"game_logs": ["v"]}, ["player_id"])


def lev(a, b):
    prev = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        cur = [i]
        for j, y in enumerate(b, 1):
            cur.append(min(prev[j] + 1, cur[-1] + 1, prev[j - 1] + (x != y)))
        prev = cur
    return prev[-1]


@pytest.mark.parametrize("measure", ["levenshtein", "blocks"])
def test_close_pairs_equal_brute_force(spark, measure):
    rng = random.Random(11)

    def word(n):
        return "".join(rng.choice("abcde ") for _ in range(n)).strip() or "a"

    def typo(w):
        w = list(w)
        for _ in range(rng.randrange(4)):
            i = rng.randrange(len(w))
            if rng.random() < 0.5 and len(w) > 1:
                del w[i]
            else:
                w[i] = rng.choice("abcde")
        return "".join(w)

    base = [word(rng.randrange(4, 48)) for _ in range(60)]
    left = sorted({typo(w) for w in base})
    mk = lambda ws: spark.createDataFrame([(w,) for w in ws], "n string")       # noqa: E731
    got = {(r["n"], r["candidate"]) for r in resolve.close_pairs(mk(left), mk(base), "n", measure=measure).collect()}
    sim = (lambda a, b: 1 - lev(a, b) / max(len(a), len(b))) if measure == "levenshtein" else (lambda a, b: difflib.SequenceMatcher(None, b, a).ratio())
    want = {(a, b) for a in left for b in set(base) if sim(a, b) >= 0.9 - 1e-12}
    assert got == want


def test_match_methods(spark):
    known = spark.createDataFrame([(1, "Gary Trent Jr.", 2018, 2024), (2, "Cam Johnson", 2019, 2024), (3, "John Smith", 1990, 1995), (4, "John Smith", 2015, 2024), (5, "Nikola Jokic", 2015, 2024)],
                                  "player_id int, player_name string, from_year int, to_year int")
    src = spark.createDataFrame([("a", "Gary Trent", 2020), ("b", "Cameron Johnson", 2020), ("c", "John Smith", 2020), ("d", "John Smith", None), ("e", "Nikola Jokicc", 2020), ("f", "Nobody Here", 2020)],
                                "source_id string, name string, season_start int")
    got = {r["source_id"]: (r["match_method"], r["player_id"]) for r in resolve.match_entities(src, known, source_name="x").collect()}
    assert got == {"a": ("exact", 1), "b": ("normalized", 2), "c": ("exact", 4), "d": ("ambiguous", None), "e": ("fuzzy", 5), "f": ("unmatched", None)}


def test_short_queries_match_as_substrings(spark):
    from tallyline.operators.resolve import unique_substring_match

    known = spark.createDataFrame([("1", "Ann Lindy"), ("2", "Bo Ray"), ("3", "Abe Quill"), ("4", "li")], "player_id string, player_name string")
    asked = spark.createDataFrame([("li",), ("q",), ("a",), ("nd",), ("lind",), ("zz",), ("",), (None,)], "query string")
    got = {r["query"]: r["player_id"] for r in unique_substring_match(asked, known).collect()}
    assert got == {"li": "4", "q": "3", "a": None, "nd": "1", "lind": "1", "zz": None, "": None, None: None}


def test_grams_of_names_are_not_broadcast(spark, capsys):
    from tallyline.operators.resolve import unique_substring_match

    known = spark.createDataFrame([(i, f"Person {i:09d}") for i in range(40)] + [(None, "Person 000000099"), (7, "000000007")], "player_id int, player_name string")
    asked = spark.createDataFrame([(f"{i:09d}",) for i in range(10)] + [("son 0000",), ("son 00003",), ("000000099",), ("0000000399",)], "query string")
    df = unique_substring_match(asked, known)
    got = {r["query"]: r["player_id"] for r in df.collect()}
    assert got == {**{f"{i:09d}": i for i in range(10)}, "son 0000": None, "son 00003": None, "000000099": None, "0000000399": None}
    df.explain()
    plan = capsys.readouterr().out
    assert "SortMergeJoin [_g" in plan and "BroadcastHashJoin [_g" not in plan


def test_cohort_scores_of_large_values(spark):
    from tallyline.operators.matching import cohort_z

    rows = spark.createDataFrame([("g", float(add + i), 1.0, add) for add in (0, 10**9) for i in range(6)], "k string, x double, w double, base long")
    got = cohort_z(rows, ["k", "base"], {"z": "x"}, "w").collect()
    plain = {r["x"]: r["z"] for r in got if r["base"] == 0}
    assert len(got) == 12 and all(abs(r["z"] - plain[r["x"] - r["base"]]) < 1e-6 for r in got)

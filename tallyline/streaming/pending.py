"""Stateful streams: hold an event until both sides agree, and keep first and last sightings per key."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class PendingGames(StatefulProcessor):
    """State of one game: the two sides' totals and the sum of their member rows. Emits once both agree, or when time is up.

    Input rows: (game_id, team_id, kind 'side' or 'member', row_id, value). A game has a few dozen rows, so its state is small;
    a row seen again (a replayed or re-pulled file) replaces its earlier value.
    """

    def __init__(self, groups: int = 2, timeout_ms: int = 48 * 3600 * 1000):
        self.groups, self.timeout_ms = groups, timeout_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.rows = handle.getMapState("rows", "kind string, team_id bigint, row_id string", "value double")
        self.done = handle.getValueState("done", "done boolean")

    def _verdict(self) -> tuple[bool, int]:
        sides, sums = {}, {}
        for (kind, team, _), (value,) in self.rows.iterator():
            if kind == "side":
                sides[team] = value
            else:
                sums[team] = sums.get(team, 0.0) + value
        return len(sides) == self.groups and all(abs(sums.get(t, float("nan")) - v) < 1e-9 for t, v in sides.items()), len(sides)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        for pdf in rows:
            for r in pdf.itertuples(index=False):
                self.rows.updateValue((r.kind, int(r.team_id), str(r.row_id)), (float(r.value),))
        if self.done.exists():
            return
        final, n = self._verdict()
        if final:
            self.done.update((True,))
            for t in list(self.handle.listTimers()):
                self.handle.deleteTimer(t)
            yield pd.DataFrame({"game_id": [key[0]], "status": ["final"], "n_sides": [n]})
        else:
            now = timerValues.getCurrentProcessingTimeInMs()
            if not list(self.handle.listTimers()):
                self.handle.registerTimer(now + self.timeout_ms)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if not self.done.exists():
            yield pd.DataFrame({"game_id": [key[0]], "status": ["timed out"], "n_sides": [self._verdict()[1]]})

    def close(self) -> None:
        pass


def pending_games(stream: DataFrame, *, groups: int = 2) -> DataFrame:
    """(game_id, status, n_sides): one row when a game becomes final. Needs the RocksDB state store."""
    return stream.groupBy("game_id").transformWithStateInPandas(PendingGames(groups), "game_id string, status string, n_sides int", "Append", "ProcessingTime")


class Sightings(StatefulProcessor):
    """First and last sighting of a key, from the data's own times, so replays change nothing."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.span = handle.getValueState("span", "first_us bigint, last_us bigint")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        old = self.span.get() if self.span.exists() else None
        first, last = old if old else (None, None)
        for pdf in rows:
            lo, hi = int(pdf["seen_us"].min()), int(pdf["seen_us"].max())
            first, last = lo if first is None else min(first, lo), hi if last is None else max(last, hi)
        self.span.update((first, last))
        yield pd.DataFrame({"key": [key[0]], "first_us": [first], "last_us": [last]})

    def close(self) -> None:
        pass


def sightings(stream: DataFrame, key: str, seen: str) -> DataFrame:
    """(key, first_us, last_us) in update mode."""
    rows = stream.select(F.col(key).cast("string").alias("key"), F.unix_micros(F.col(seen).cast("timestamp")).alias("seen_us"))
    return rows.groupBy("key").transformWithStateInPandas(Sightings(), "key string, first_us bigint, last_us bigint", "Update", "None")


def pending_batch(rows: DataFrame, *, groups: int = 2, tolerance: float = 1e-9) -> DataFrame:
    """The same verdicts over a batch, by two aggregates."""
    one = rows.groupBy("game_id", "team_id", "kind", "row_id").agg(F.max("value").alias("value"))
    per = one.groupBy("game_id", "team_id").agg(F.max(F.when(F.col("kind") == "side", F.col("value"))).alias("side"), F.sum(F.when(F.col("kind") == "member", F.col("value"))).alias("parts"))
    ok = F.coalesce(F.abs(F.col("side") - F.col("parts")) < tolerance, F.lit(False))
    g = per.where(F.col("side").isNotNull()).groupBy("game_id").agg(F.count(F.lit(1)).alias("n_sides"), F.bool_and(ok).alias("ok"))
    return g.select("game_id", F.when(F.col("ok") & (F.col("n_sides") == groups), "final").otherwise("pending").alias("status"), "n_sides")

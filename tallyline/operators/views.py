"""Point-in-time views: what was knowable before a target period, and checks that nothing later leaks in."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from tallyline.functions.periods import season_year_fast

HISTORY_TABLES = ("game_logs", "team_games", "players", "player_season_bio")


class LeakageError(AssertionError):
    """A table reveals the target period or later."""


def before_period(df: DataFrame, cutoff: int, *, period: Column | None = None, inclusive: bool = False) -> DataFrame:
    """Rows of earlier periods; ``inclusive`` keeps the target period too (for rankings published before it)."""
    p = season_year_fast(F.col("season")) if period is None else period
    return df.where(p <= cutoff if inclusive else p < cutoff)


def known_entities(entity: str, *frames: DataFrame) -> DataFrame:
    """Distinct ids that appear in any of the frames."""
    return reduce(DataFrame.unionByName, [f.select(entity) for f in frames]).distinct()


def sanitize_entities(players: DataFrame, cutoff: int, known: DataFrame, *, entity: str = "player_id") -> DataFrame:
    """Entities knowable before ``cutoff``: drafted in time, or seen; summary columns lose their future part."""
    seen = known.select(F.col(entity).alias("_seen")).distinct()
    joined = players.join(seen, players[entity] == seen["_seen"], "left")
    kept = joined.where((F.coalesce(F.col("draft_year") <= cutoff, F.lit(False))) | F.col("_seen").isNotNull())
    return (kept.drop("_seen")
            .withColumn("from_year", F.when(F.col("from_year") < cutoff, F.col("from_year")))
            .withColumn("to_year", F.when(F.col("to_year").isNotNull(), F.least(F.col("to_year"), F.lit(cutoff - 1)))))


def sanitize_entities_by_first_year(players: DataFrame, cutoff: int) -> DataFrame:
    """Earlier rule: drop later draftees, and undrafted rows whose first period is not before the cutoff."""
    late_draft = F.coalesce(F.col("draft_year") > cutoff, F.lit(False))
    late_first = F.col("draft_year").isNull() & ~F.coalesce(F.col("from_year") < cutoff, F.lit(False))
    return (players.where(~late_draft & ~late_first)
            .withColumn("from_year", F.when(F.col("from_year") < cutoff, F.col("from_year")))
            .withColumn("to_year", F.when(F.col("to_year").isNotNull(), F.least(F.col("to_year"), F.lit(cutoff - 1)))))


@dataclass(frozen=True)
class History:
    """Every table cut strictly before ``target``; all of them stay lazy."""

    target: int
    tables: Mapping[str, DataFrame]

    @classmethod
    def until(cls, tables: Mapping[str, DataFrame], target: int, *, sanitize: bool = True) -> "History":
        cut = {n: before_period(t, target) if "season" in t.columns else t for n, t in tables.items()}
        if sanitize and "players" in cut:
            known = known_entities("player_id", cut["game_logs"], cut["player_season_bio"])
            cut["players"] = sanitize_entities(cut["players"], target, known)
        return cls(target, cut)

    def __getitem__(self, name: str) -> DataFrame:
        return self.tables[name]

    def assert_no_future(self) -> None:
        assert_history_clean(self.tables, self.target)

    def last_period(self) -> int | None:
        return self.tables["game_logs"].agg(F.max(season_year_fast(F.col("season")))).first()[0]


def future_rows(df: DataFrame, cutoff: int, *, period: Column | None = None, inclusive: bool = False) -> DataFrame:
    p = season_year_fast(F.col("season")) if period is None else period
    return df.where(p > cutoff if inclusive else p >= cutoff)


def assert_no_future(df: DataFrame, cutoff: int, name: str = "table", *, period: Column | None = None, inclusive: bool = False) -> None:
    if future_rows(df, cutoff, period=period, inclusive=inclusive).limit(1).count():
        raise LeakageError(f"{name} holds rows at or after {cutoff}")


def assert_history_clean(tables: Mapping[str, DataFrame], cutoff: int) -> None:
    for name, table in tables.items():
        if "season" in table.columns:
            assert_no_future(table, cutoff, name)
    players = tables.get("players")
    if players is not None:
        bad = (F.col("from_year") >= cutoff) | (F.col("to_year") >= cutoff) | (F.col("draft_year") > cutoff)
        if players.where(bad).limit(1).count():
            raise LeakageError(f"players reveals seasons at or after {cutoff}")


def scramble_future(df: DataFrame, cutoff: int, columns: list[str], *, seed: int = 0, period: Column | None = None,
                    key: list[str] | None = None) -> DataFrame:
    """Perturb the given numbers, and only in rows at or after the cutoff, by a factor that depends on seed and row."""
    p = season_year_fast(F.col("season")) if period is None else period
    noise = F.pmod(F.xxhash64(F.lit(seed), *[F.col(k) for k in (key or df.columns)]), F.lit(1000)) / 100.0 + 1.5
    return df.select(*[(F.when(p >= cutoff, (F.col(c) * noise).cast(df.schema[c].dataType)).otherwise(F.col(c)).alias(c)
                        if c in columns else F.col(c)) for c in df.columns])


def frames_differ(a: DataFrame, b: DataFrame, key: list[str], *, tolerance: float = 1e-9) -> DataFrame:
    """Keys whose rows differ: present on one side only, or a number apart by more than the tolerance."""
    right = b.select(*[F.col(c).alias("_r_" + c) for c in b.columns])
    cond = reduce(lambda x, y: x & y, [a[k].eqNullSafe(right["_r_" + k]) for k in key])
    joined = a.withColumn("_in_a", F.lit(True)).join(right.withColumn("_in_b", F.lit(True)), cond, "full")
    tests = [F.col("_in_a").isNull() | F.col("_in_b").isNull()]
    for c in a.columns:
        if c in key:
            continue
        left, other = F.col(c), F.col("_r_" + c)
        same = left.eqNullSafe(other)
        if a.schema[c].dataType.typeName() in ("double", "float"):
            same = same | F.coalesce(F.abs(left - other) <= tolerance, F.lit(False))
        tests.append(~same)
    return joined.where(reduce(lambda x, y: x | y, tests)).select(*[F.coalesce(F.col(k), F.col("_r_" + k)).alias(k) for k in key])


def frames_equal(a: DataFrame, b: DataFrame) -> bool:
    """Same rows the same number of times."""
    if sorted(a.columns) != sorted(b.columns):
        return False
    b = b.select(*a.columns)
    return a.exceptAll(b).limit(1).count() == 0 and b.exceptAll(a).limit(1).count() == 0


def assert_ignores_future(build: Callable[[Mapping[str, DataFrame]], DataFrame], tables: Mapping[str, DataFrame], cutoff: int,
                          columns: Mapping[str, list[str]], key: list[str], *, seed: int = 0, check_determinism: bool = True) -> None:
    """Run ``build`` on the true tables and on tables with a scrambled future; any difference is leakage."""
    first = build(tables)
    if check_determinism and frames_differ(first, build(tables), key).limit(1).count():
        raise LeakageError("two runs on the same tables differ")
    shaken = {n: scramble_future(t, cutoff, columns[n], seed=seed) if n in columns else t for n, t in tables.items()}
    if frames_differ(first, build(shaken), key).limit(1).count():
        raise LeakageError("output changes when only future rows change")


def content_hash(df: DataFrame) -> DataFrame:
    """(n_rows, hash): independent of row and partition order, one partially aggregated pass."""
    cols = [F.coalesce(F.col(c).cast("string"), F.lit("\u0000")) for c in sorted(df.columns)]
    h = F.xxhash64(*cols)
    return df.agg(F.count(F.lit(1)).alias("n_rows"), F.sum(h.cast("decimal(38,0)")).cast("string").alias("content_hash"))

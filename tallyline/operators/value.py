"""Replacement level, value over replacement, capacity-limited fill, tiers and the ranked board."""

from __future__ import annotations

from dataclasses import dataclass
from math import floor

from pyspark.sql import Column, DataFrame, Window, functions as F

from tallyline.functions.positions import ANY, FLEX, SPECIFIC, eligible_positions
from tallyline.operators.ranking import By, asc, desc, top_k, with_row_number

DEFAULT_SCARCITY = 0.10


@dataclass(frozen=True)
class LeagueShape:
    """Capacities: groups, slots per group and reserve places."""

    teams: int
    slots: tuple[tuple[str, int], ...]
    bench: int

    @property
    def starters(self) -> int:
        return sum(n for _, n in self.slots)

    @property
    def roster_size(self) -> int:
        return self.starters + self.bench

    @property
    def rostered(self) -> int:
        return self.teams * self.roster_size


def league_shape(config: dict, *, teams: int | None = None) -> LeagueShape:
    league = config["league"]
    n = int(teams if teams is not None else league["teams"])
    if n < 1:
        raise ValueError("teams must be at least 1")
    roster = league["roster"]
    return LeagueShape(n, tuple((k, int(v)) for k, v in roster["starters"].items()), int(roster.get("bench", 0)))


def is_categories_league(config: dict) -> bool:
    text = str((config or {}).get("league", {}).get("format", "")).lower()
    return "categor" in text or "roto" in text


def bench_weight(shape: LeagueShape, availability: float) -> float:
    """Share of reserve places that work like starting ones: vacated starts over reserve places, within 0..1."""
    if shape.bench <= 0:
        return 0.0
    vacated = shape.starters * (1.0 - min(max(availability, 0.0), 1.0))
    return min(max(vacated / shape.bench, 0.0), 1.0)


def replacement_rank(shape: LeagueShape, weight: float) -> float:
    if not 0.0 <= weight <= 1.0:
        raise ValueError("bench weight must be within 0..1")
    return shape.teams * (shape.starters + weight * shape.bench)


def value_at_rank(df: DataFrame, value: str, rank: float, *, by: str | None = None, tie: str | None = None, group: list[str] | None = None) -> DataFrame:
    """(group..., level): value at 0-based position ``rank`` of the descending order, interpolated between its neighbours.

    Only the first ``rank + 2`` rows of each group are ranked; a group with fewer rows gives its last value, an empty one 0.
    """
    group, by = group or [], by or value
    lo = floor(rank)
    frac = rank - lo
    order = [desc(by)] + ([asc(tie)] if tie else [])
    rows = df.where(F.col(by).isNotNull() & F.col(value).isNotNull())
    head = top_k(rows, group, order, lo + 2, "_rk")
    at = lambda k: F.max(F.when(F.col("_rk") == k, F.col(value)))
    blend = at(lo + 1) * (1 - frac) + at(lo + 2) * frac
    last = F.max_by(value, "_rk")
    return head.groupBy(*group).agg(F.coalesce(blend, last, F.lit(0.0)).cast("double").alias("level"))


def availability_of_top(df: DataFrame, *, total: str, games: str, n: int, season_games: float, tie: str, group: list[str] | None = None) -> DataFrame:
    head = top_k(df, group or [], [desc(total), asc(tie)], max(n, 1), "_rk")
    return head.groupBy(*(group or [])).agg((F.avg(games) / F.lit(season_games)).alias("availability"))


@dataclass(frozen=True)
class ReplacementLevel:
    weight: float
    availability: float | None
    rank: float
    total: float
    per_game: float


def replacement_level(proj: DataFrame, shape: LeagueShape, *, total: str = "proj_total_fp", fppg: str = "proj_fppg", games: str = "proj_gp",
                      tie: str = "player_id", weight: float | None = None, season_games: float = 82.0) -> ReplacementLevel:
    """Level of the best row outside the rostered pool. Three scalars come back to the driver."""
    availability = None
    if weight is None:
        availability = float(availability_of_top(proj, total=total, games=games, n=shape.teams * shape.starters, season_games=season_games, tie=tie).first()[0])
        weight = bench_weight(shape, availability)
    rank = replacement_rank(shape, weight)
    level = value_at_rank(proj, total, rank, tie=tie).first()[0]
    per_game = value_at_rank(proj, fppg, rank, by=total, tie=tie).first()[0]
    return ReplacementLevel(weight, availability, rank, float(level), float(per_game))


def capacity_rounds(df: DataFrame, *, entity: str, value: str, eligible: str, shape: LeagueShape, n_bench: int) -> DataFrame:
    """(entity, slot) of the rows a whole league would hold, filled in rounds: specific slots, flexible ones, the any-slot, reserves.

    Each round takes the best remaining eligible rows up to its capacity with a distributed top-k. The one-by-one greedy order
    is replaced by this fixed order of rounds. At most the league's capacity in rows is listed on the driver.
    """
    spark = df.sparkSession
    rounds: list[tuple[str, Column, int]] = []
    capacity = {s: n * shape.teams for s, n in shape.slots}
    for slot in SPECIFIC:
        rounds.append((slot, F.array_contains(eligible, slot), capacity.get(slot, 0)))
    for slot, members in FLEX.items():
        rounds.append((slot, F.arrays_overlap(F.col(eligible), F.array(*[F.lit(m) for m in members])), capacity.get(slot, 0)))
    rounds += [(ANY, F.lit(True), capacity.get(ANY, 0)), ("BENCH", F.lit(True), n_bench)]
    schema = f"{entity} {df.schema[entity].dataType.simpleString()}, slot string"
    taken: list[tuple] = []
    for slot, fits, cap in rounds:
        if cap <= 0:
            continue
        left = df.where(fits)
        if taken:
            left = left.join(F.broadcast(spark.createDataFrame(taken, schema)), entity, "left_anti")   # at most the league's capacity
        head = left.orderBy(F.col(value).desc(), F.col(entity)).limit(cap).select(entity).collect()
        taken += [(row[0], slot) for row in head]
    return spark.createDataFrame(taken, schema)


def capacity_rounds_by_group(df: DataFrame, group: list[str], *, entity: str, value: str, eligible: str, slots: list[tuple[str, int]], bench: int = 0,
                             name: str = "slot") -> DataFrame:
    """The same fill inside every group at once: one ranked pass per slot over rosters, whose size is a roster's."""
    out = df.withColumn(name, F.lit(None).cast("string"))
    order = [s for s in SPECIFIC if s in dict(slots)] + [s for s in FLEX if s in dict(slots)] + ([ANY] if ANY in dict(slots) else [])
    for slot in order + (["BENCH"] if bench else []):
        fits = (F.lit(True) if slot in (ANY, "BENCH") else
                F.arrays_overlap(F.col(eligible), F.array(*[F.lit(m) for m in FLEX[slot]])) if slot in FLEX else F.array_contains(eligible, slot))
        cap = bench if slot == "BENCH" else dict(slots)[slot]
        out = out.withColumn("_fits", F.col(name).isNull() & fits)
        w = Window.partitionBy(*group, "_fits").orderBy(F.col(value).desc(), F.col(entity))
        out = out.withColumn("_pos", F.row_number().over(w))
        out = out.withColumn(name, F.when(F.col("_fits") & (F.col("_pos") <= cap), F.lit(slot)).otherwise(F.col(name))).drop("_fits", "_pos")
    return out


def group_value(df: DataFrame, group: list[str], *, entity: str, value: str, eligible: str, slots: list[tuple[str, int]], bench: int,
                weight: float) -> DataFrame:
    """(group, lineup_value): starters count fully, reserves with the bench weight."""
    placed = capacity_rounds_by_group(df, group, entity=entity, value=value, eligible=eligible, slots=slots, bench=bench)
    share = F.when(F.col("slot").isNull(), 0.0).when(F.col("slot") == "BENCH", weight).otherwise(1.0)
    return placed.groupBy(*group).agg(F.sum(share * F.col(value)).alias("lineup_value"))


@dataclass(frozen=True)
class PositionalReport:
    levels: dict[str, float]
    spread: float
    scarcity_index: float
    material: bool


def positional_replacement(proj: DataFrame, shape: LeagueShape, *, level: ReplacementLevel, total: str = "proj_total_fp", position: str = "position",
                           entity: str = "player_id", threshold: float = DEFAULT_SCARCITY) -> PositionalReport:
    """Best unrostered value per specific slot after a league-wide fill, and whether the slots differ enough to matter."""
    rows = proj.select(entity, total, eligible_positions(F.col(position)).alias("_elig"))
    taken = capacity_rounds(rows, entity=entity, value=total, eligible="_elig", shape=shape, n_bench=round(shape.teams * shape.bench * level.weight))
    free = rows.join(F.broadcast(taken), entity, "left_anti")            # ``taken`` holds at most the league's capacity
    best = {r[0]: r[1] for r in free.select(F.explode("_elig").alias("p"), total).groupBy("p").agg(F.max(total)).collect()}
    low = float(proj.agg(F.min(total)).first()[0] or 0.0)
    levels = {p: float(best.get(p, low)) for p in SPECIFIC}
    spread = max(levels.values()) - min(levels.values())
    top = proj.orderBy(F.col(total).desc()).limit(shape.teams * shape.starters).agg(F.avg(total)).first()[0]
    typical = float(top) - level.total if top is not None else 0.0
    index = spread / typical if typical > 0 else 0.0
    return PositionalReport(levels, spread, index, index >= threshold)


def own_positional_level(position: Column, levels: dict[str, float], default: float) -> Column:
    table = F.create_map(*[x for k, v in levels.items() for x in (F.lit(k), F.lit(v))])
    return F.coalesce(F.array_min(F.transform(eligible_positions(position), lambda p: F.try_element_at(table, p))), F.lit(default))


def compute_vorp(proj: DataFrame, shape: LeagueShape, *, weight: float | None = None, season_games: float = 82.0, positional: str = "auto",
                 threshold: float = DEFAULT_SCARCITY) -> DataFrame:
    """``vorp``, ``vorp_per_game``, ``repl_total`` on top of ``proj_total_fp``, ``proj_fppg``, ``proj_gp`` (``position`` optional)."""
    if positional not in ("off", "on", "auto"):
        raise ValueError("positional must be 'off', 'on' or 'auto'")
    absent = [c for c in ("proj_total_fp", "proj_fppg", "proj_gp") if c not in proj.columns]
    if absent:
        raise KeyError(f"projections miss {absent}")
    if positional == "on" and "position" not in proj.columns:
        raise ValueError("positional='on' needs a 'position' column")
    level = replacement_level(proj, shape, weight=weight, season_games=season_games)
    repl = F.lit(level.total)
    if positional != "off" and "position" in proj.columns:
        report = positional_replacement(proj, shape, level=level, threshold=threshold)
        if positional == "on" or report.material:
            repl = own_positional_level(F.col("position"), report.levels, level.total)
    return (proj.withColumn("repl_total", repl).withColumn("vorp", F.col("proj_total_fp") - F.col("repl_total"))
            .withColumn("vorp_per_game", F.col("proj_fppg") - F.lit(level.per_game)))


def accepted_cliffs(candidates: list[tuple[int, float]], n_top: int, *, min_size: int, max_tiers: int) -> list[int]:
    """Strongest first, skip any cliff that would leave a tier below ``min_size``. ``candidates``: (rank above the gap, strength)."""
    bounds: list[int] = []
    for rank, _ in sorted(candidates, key=lambda c: (-c[1], c[0])):
        if len(bounds) >= max_tiers - 1:
            break
        edges = [0, *sorted(bounds + [rank]), n_top]
        if all(b - a >= min_size for a, b in zip(edges, edges[1:])):
            bounds.append(rank)
    return sorted(bounds)


def gap_table(ranked: DataFrame, *, rank: str, value: str, window: int = 15, chunk: int = 100_000) -> DataFrame:
    """(rank, gap, scale): drop to the next row and the median drop within ``window`` ranks on either side.

    Ranks are cut into chunks with a margin of ``window + 1`` rows copied from the neighbours, so no task needs them all.
    """
    rk = F.col(rank).cast("long")
    own = F.floor((rk - 1) / chunk)
    near = F.array_distinct(F.array(own, F.floor((rk - 1 - (window + 1)) / chunk), F.floor((rk - 1 + window + 1) / chunk)))
    rows = ranked.select(rk.alias("rank"), F.col(value).alias("_v"), own.alias("_own"), F.explode(near).alias("_chunk"))
    w = Window.partitionBy("_chunk").orderBy("rank")
    rows = rows.withColumn("gap", F.col("_v") - F.lead("_v").over(w))
    rows = rows.where(F.col("gap").isNotNull())
    around = w.rowsBetween(-window, window)
    rows = rows.withColumn("scale", F.when(F.count("gap").over(around) >= 3, F.greatest(F.percentile("gap", F.lit(0.5)).over(around), F.lit(1e-9))))
    return rows.where(F.col("_own") == F.col("_chunk")).select("rank", "gap", "scale")


def assign_tiers(ranked: DataFrame, *, rank: str = "rank", value: str = "vorp", floor_value: float | None = 0.0, gap_factor: float = 2.5, window: int = 15,
                 min_size: int = 3, max_tiers: int = 12, min_gap_frac: float = 0.01, name: str = "tier") -> DataFrame:
    """Tiers cut at cliffs: gaps large against their neighbourhood and against the whole span.

    A cliff is at least ``min_gap_frac`` of the span, so there are at most 1/min_gap_frac candidates; only those reach the driver.
    """
    top = ranked if floor_value is None else ranked.where(F.col(value) > floor_value)
    n_top, high, low = top.agg(F.count(F.lit(1)), F.max(value), F.min(value)).first()
    bounds: list[int] = []
    if n_top >= 2 * min_size and max_tiers > 1:
        gaps = gap_table(top, rank=rank, value=value, window=window)
        big = (F.col("gap") > 0) & (F.col("gap") >= gap_factor * F.col("scale")) & (F.col("gap") >= min_gap_frac * (high - low))
        found = [(int(r[0]), float(r[1])) for r in gaps.where(big).select("rank", F.col("gap") / F.col("scale")).collect()]
        bounds = accepted_cliffs(found, n_top, min_size=min_size, max_tiers=max_tiers)
    tier = F.lit(1)
    for b in bounds:
        tier = tier + (F.col(rank) > b).cast("int")
    if floor_value is not None:
        last = len(bounds) + 2 if n_top else 1
        tier = F.when(F.col(value) > floor_value, tier).otherwise(F.lit(last))
    return ranked.withColumn(name, tier.cast("int"))


def build_board(projections: DataFrame, players: DataFrame | None, shape: LeagueShape, *, adp: DataFrame | None = None, weight: float | None = None,
                season_games: float = 82.0, positional: str = "auto", tiers: dict | None = None) -> DataFrame:
    """Projections ranked by value over replacement, with tiers and the gap to a market ranking."""
    proj = projections
    if players is not None:
        listed = players.select("player_id", F.col("position").alias("_pos")).dropDuplicates(["player_id"])
        own = F.col("position") if "position" in proj.columns else F.lit(None).cast("string")
        proj = proj.join(listed, "player_id", "left").withColumn("position", F.coalesce("_pos", own)).drop("_pos")
    board = compute_vorp(proj, shape, weight=weight, season_games=season_games, positional=positional if "position" in proj.columns else "off")
    board = with_row_number(board, [], [desc("vorp"), desc("proj_total_fp"), asc("player_id")], "rank")
    board = assign_tiers(board, **(tiers or {}))
    if adp is not None:
        market = adp.groupBy("player_id").agg(F.min(F.col("adp").cast("double")).alias("adp"))
        board = board.join(market, "player_id", "left").withColumn("adp_gap", F.col("adp") - F.col("rank"))
    return board


def best_by_category(board: DataFrame, taken: DataFrame | None, *, entity: str, categories: str, order: list[By], n: int) -> DataFrame:
    """First ``n`` rows of each category (a row may be in several) that are not taken."""
    rows = board if taken is None else board.join(taken.select(entity).distinct(), entity, "left_anti")
    return top_k(rows.withColumn("category", F.explode(categories)), ["category"], order, n, "category_rank")


def position_capacity(config: dict) -> dict[str, float]:
    """Places per specific slot: its own, an even share of the flexible and any-slots, and of the reserves."""
    roster = config["league"]["roster"]
    slots = roster.get("starters", {})
    out = {p: float(slots.get(p, 0) or 0) for p in SPECIFIC}
    for flex, members in FLEX.items():
        for m in members:
            out[m] += float(slots.get(flex, 0) or 0) / len(members)
    shared = float(slots.get(ANY, 0) or 0) + float(roster.get("bench", 0) or 0)
    return {p: v + shared / len(SPECIFIC) for p, v in out.items()}


def position_need(board: DataFrame, mine: DataFrame, capacity: dict[str, float], *, entity: str = "player_id", position: str = "position") -> DataFrame:
    """(need_position, need_capacity, need_filled, need_score): shortfall share, within 0..1. One row per slot."""
    spark = board.sparkSession
    have = board.join(mine.select(entity).distinct(), entity, "left_semi").select(F.explode(eligible_positions(F.col(position))).alias("need_position"))
    filled = have.groupBy("need_position").agg(F.count(F.lit(1)).alias("need_filled"))
    caps = spark.createDataFrame(sorted(capacity.items()), "need_position string, need_capacity double")
    out = caps.join(filled, "need_position", "left").na.fill({"need_filled": 0})
    score = F.when(F.col("need_capacity") > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), (F.col("need_capacity") - F.col("need_filled")) / F.col("need_capacity")))).otherwise(0.0)
    return out.withColumn("need_score", score)


def need_board(board: DataFrame, mine: DataFrame, config: dict, *, bonus: float = 40.0, entity: str = "player_id") -> DataFrame:
    """Remaining rows ranked by value plus a bonus for the most needed slot each can fill."""
    needs = position_need(board, mine, position_capacity(config), entity=entity)
    table = {r["need_position"]: float(r["need_score"]) for r in needs.collect()}          # one row per slot
    lookup = F.create_map(*[x for k, v in table.items() for x in (F.lit(k), F.lit(v))])
    score = F.coalesce(F.array_max(F.transform(eligible_positions(F.col("position")), lambda p: F.try_element_at(lookup, p))), F.lit(0.0))
    left = board.join(mine.select(entity).distinct(), entity, "left_anti").withColumn("need_score", score)
    left = left.withColumn("need_adj_vorp", F.col("vorp") + F.lit(bonus) * F.col("need_score"))
    return with_row_number(left, [], [desc("need_adj_vorp"), desc("vorp"), asc(entity)], "need_rank")

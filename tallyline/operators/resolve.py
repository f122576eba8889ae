"""Entity resolution by name: exact, alias, then fuzzy; nothing ambiguous is guessed, everything is reported.

Fuzzy candidates come from deletion variants: two names within ``d`` edits share a string left after at most ``d`` deletions
from each. Joining on those strings is an equi-join whose matches are near-true pairs, so no block of names is ever paired
with itself. Names are reduced to distinct keys first.
"""

from __future__ import annotations

import difflib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from tallyline.functions.names import alias_key, deletion_variants, normalize_name
from tallyline.operators.ranking import desc, top_k

CUTOFF = 0.90


def max_edits(a_len: Column, cutoff: float) -> Column:
    """Most edits that still keep similarity 1 - d / max(len) at the cutoff when the longer name has ``a_len`` characters."""
    return F.floor(a_len * F.lit(1.0 - cutoff) + F.lit(1e-9)).cast("int")


def variant_rows(names: DataFrame, column: str, edits: Column, most: int) -> DataFrame:
    """(column, _variant): the deletion variants of each distinct name, as deep as its own length allows."""
    depth = F.array(F.col(column))
    for k in range(1, most + 1):
        depth = F.when(edits >= k, deletion_variants(F.col(column), k)).otherwise(depth)
    return names.select(column).distinct().select(column, F.explode(depth).alias("_variant"))


def close_pairs(left: DataFrame, right: DataFrame, name: str, *, cutoff: float = CUTOFF, measure: str = "levenshtein", most_edits: int = 3) -> DataFrame:
    """(name, candidate, similarity) for all pairs of distinct names at or above the cutoff.

    ``measure`` 'levenshtein' is 1 - edits / longer length. 'blocks' is the matching-blocks ratio 2M / (len + len) of the standard
    library, verified per candidate in Arrow batches. Names so long that the cutoff allows more than ``most_edits`` edits are
    matched through fixed-length pieces instead, so no pair is lost.
    """
    if measure not in ("levenshtein", "blocks"):
        raise ValueError(f"unknown measure {measure!r}")
    a = left.select(F.col(name).alias("a")).where(F.length(name) > 0).distinct()
    b = right.select(F.col(name).alias("b")).where(F.length(name) > 0).distinct()
    # longest partner a name can have at the cutoff is len / cutoff; a ratio over both lengths allows twice the one-sided edits
    def allowed(n: Column) -> Column:
        longer = F.floor(n / F.lit(cutoff) + F.lit(1e-9))
        if measure == "levenshtein":
            return max_edits(longer, cutoff)
        return F.floor((n + F.floor(n * F.lit((2 - cutoff) / cutoff) + 1e-9)) * F.lit(1 - cutoff) + 1e-9).cast("int")

    ea, eb = allowed(F.length("a")), allowed(F.length("b"))
    short = variant_rows(a.where(ea <= most_edits), "a", ea, most_edits).join(variant_rows(b.where(eb <= most_edits), "b", eb, most_edits), "_variant").select("a", "b").distinct()
    long_pairs = _pairs_by_pieces(a, b, ea, eb, most_edits)
    pairs = short.unionByName(long_pairs).distinct()
    if measure == "levenshtein":
        sim = 1 - F.levenshtein("a", "b") / F.greatest(F.length("a"), F.length("b"))
        scored = pairs.withColumn("similarity", sim)
    else:
        scored = pairs.mapInPandas(_block_ratio, "a string, b string, similarity double")
    return scored.where(F.col("similarity") >= cutoff - 1e-12).select(F.col("a").alias(name), F.col("b").alias("candidate"), "similarity")


def _pairs_by_pieces(a: DataFrame, b: DataFrame, ea: Column, eb: Column, most: int) -> DataFrame:
    """Pairs in which either name is too long for variants. Cutting one name into edits + 1 pieces leaves one piece intact in its
    partner, at a position shifted by at most the edits: an equi-join on (piece, position)."""
    la, lb = a.withColumn("_e", ea).where(F.col("_e") > most), b.withColumn("_e", eb).where(F.col("_e") > most)

    def pieces(df: DataFrame, col: str) -> DataFrame:
        n = F.col("_e") + 1
        size = F.floor(F.length(col) / n).cast("int")
        return df.select(col, "_e", F.explode(F.transform(F.sequence(F.lit(0), F.col("_e")), lambda i: F.struct(
            (i * size + 1).cast("int").alias("at"), F.substring(F.col(col), (i * size + 1).cast("int"), size).alias("piece"), size.alias("size")))).alias("p"))

    def probes(pieces_df: DataFrame, long_col: str) -> DataFrame:
        near = F.explode(F.sequence(F.greatest(F.col("p.at") - F.col("_e"), F.lit(1)), F.col("p.at") + F.col("_e")))
        return pieces_df.select(long_col, near.alias("at"), F.col("p.piece").alias("piece"), F.col("p.size").alias("size"))

    def windows(df: DataFrame, col: str, sizes: DataFrame) -> DataFrame:
        sized = df.select(col).join(F.broadcast(sizes), F.col("size") <= F.length(col))          # piece sizes: at most a few small integers
        return sized.select(col, "size", F.explode(F.sequence(F.lit(1), F.length(col) - F.col("size") + 1)).alias("at")).withColumn(
            "piece", F.substring(F.col(col), F.col("at"), F.col("size")))

    pa, pb = probes(pieces(la, "a"), "a"), probes(pieces(lb, "b"), "b")
    sa, sb = pa.select("size").distinct(), pb.select("size").distinct()
    one = pa.join(windows(b, "b", sa), ["size", "at", "piece"]).select("a", "b")
    two = pb.join(windows(a, "a", sb), ["size", "at", "piece"]).select("a", "b")
    return one.unionByName(two).distinct()


def _block_ratio(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        pdf["similarity"] = [difflib.SequenceMatcher(None, b, a).ratio() for a, b in zip(pdf["a"], pdf["b"])]
        yield pdf


def covers_year(first: Column, last: Column, year: Column) -> Column:
    """Does a career from ``first`` to ``last`` (open ends allowed) cover the year, give or take one?"""
    return (first.isNull() | (first <= year + 1)) & (last.isNull() | (last >= year - 1))


def _decide(pairs: DataFrame, key: list[str], year: bool) -> DataFrame:
    """(key, player_id, n_all): the only candidate, or the only one whose years fit; null id when it stays ambiguous."""
    fits = F.col("_fits") if year else F.lit(False)
    per = pairs.groupBy(*key).agg(F.countDistinct("player_id").alias("n_all"), F.min("player_id").alias("_only"),
                                  F.count_if(fits).alias("_n_fit"), F.min(F.when(fits, F.col("player_id"))).alias("_fit"))
    return per.withColumn("player_id", F.when(F.col("n_all") == 1, F.col("_only")).when(F.col("_n_fit") == 1, F.col("_fit"))).select(*key, "player_id", "n_all")


def match_entities(source: DataFrame, known: DataFrame, *, source_name: str, id_col: str = "source_id", name_col: str = "name",
                   year_col: str | None = "season_start", cutoff: float = CUTOFF, measure: str = "blocks", best: int = 3) -> DataFrame:
    """One row per source row: ``player_id`` or null, ``match_method`` (exact, normalized, fuzzy, ambiguous, unmatched), ``confidence``.

    ``known``: player_id, player_name, from_year, to_year. Each tier only sees the names the tiers before left without candidates.
    """
    year = year_col is not None and year_col in source.columns
    src = source.select(F.col(id_col).cast("string").alias("source_id"), F.col(name_col).alias("source_name"),
                        *([F.col(year_col).cast("int").alias("_year")] if year else []))
    src = src.withColumn("norm", normalize_name(F.col("source_name"))).withColumn("alias", alias_key(F.col("source_name")))
    who = known.select("player_id", "from_year", "to_year", normalize_name(F.col("player_name")).alias("norm"), alias_key(F.col("player_name")).alias("alias")).distinct()
    fits = covers_year(F.col("from_year"), F.col("to_year"), F.col("_year")) if year else F.lit(False)
    need = ["source_id", "norm", *(["_year"] if year else [])]

    def tier(rows: DataFrame, on: str) -> DataFrame:
        cand = who.select("player_id", "from_year", "to_year", F.col(on).alias("_k"))
        pairs = rows.join(cand, rows[on] == cand["_k"]).withColumn("_fits", F.coalesce(fits, F.lit(False)))
        return _decide(pairs, ["source_id"], year)

    exact = tier(src, "norm").withColumn("match_method", F.lit("exact")).withColumn("confidence", F.lit(1.0))
    rest = src.join(exact, "source_id", "left_anti")
    aliased = tier(rest, "alias").withColumn("match_method", F.lit("normalized")).withColumn("confidence", F.lit(0.9))
    rest = rest.join(aliased, "source_id", "left_anti")
    close = close_pairs(rest, who, "norm", cutoff=cutoff, measure=measure)
    close = top_k(close, ["norm"], [desc("similarity"), desc("candidate")], best, "_place")
    cand = who.select("player_id", "from_year", "to_year", F.col("norm").alias("candidate"))
    pairs = rest.select(*need).join(close, "norm").join(cand, "candidate").withColumn("_fits", F.coalesce(fits, F.lit(False)))
    top = pairs.groupBy("source_id").agg(F.round(F.max("similarity"), 3).alias("confidence"))
    fuzzy = _decide(pairs, ["source_id"], year).join(top, "source_id").withColumn("match_method", F.lit("fuzzy"))
    found = exact.unionByName(aliased).unionByName(fuzzy.select(exact.columns))
    out = src.select("source_id", "source_name").join(found, "source_id", "left")
    method = F.when(F.col("n_all").isNull(), "unmatched").when(F.col("player_id").isNull(), "ambiguous").otherwise(F.col("match_method"))
    return out.select(F.lit(source_name).alias("source"), "source_id", "source_name", "player_id", method.alias("match_method"),
                      F.when(F.col("player_id").isNotNull(), F.col("confidence")).alias("confidence"), F.coalesce("n_all", F.lit(0)).alias("n_candidates"))


def match_report(matched: DataFrame) -> DataFrame:
    """(match_method, n_rows, share)."""
    n = matched.agg(F.count(F.lit(1))).scalar()
    return matched.groupBy("match_method").agg(F.count(F.lit(1)).alias("n_rows")).withColumn("share", F.col("n_rows") / n)


def unresolved(matched: DataFrame) -> DataFrame:
    return matched.where(F.col("player_id").isNull())


def resolve_two_tier(names: DataFrame, active: DataFrame, everyone: DataFrame, *, key: str = "person", entity: str = "player_id", known_name: str = "player_name") -> DataFrame:
    """(key, entity): the only active entity with the name, else the only one in the wider universe; otherwise null."""
    wanted = names.select(key, normalize_name(F.col(key)).alias("_n")).distinct()

    def only(universe: DataFrame, name: str) -> DataFrame:
        per = universe.select(entity, normalize_name(F.col(known_name)).alias("_n")).distinct().groupBy("_n").agg(F.count(F.lit(1)).alias("_c"), F.min(entity).alias(name))
        return per.where(F.col("_c") == 1).select("_n", name)

    out = wanted.join(only(active, "_first"), "_n", "left").join(only(everyone, "_second"), "_n", "left")
    return out.select(key, F.coalesce("_first", "_second").alias(entity))


def resolve_in_context(rows: DataFrame, known: DataFrame, memberships: DataFrame, *, name: str = "player_name", group: str = "team_abbr", period: str = "s",
                       entity: str = "player_id", row_id: str = "row_id") -> DataFrame:
    """Resolve names, a shared name by who belonged to the row's group that period or the one before."""
    people = known.select(F.col(entity).alias("player_id"), normalize_name(F.col(name)).alias("_n")).distinct()
    cand = rows.select(row_id, group, period, normalize_name(F.col(name)).alias("_n")).join(people, "_n")
    near = memberships.select(F.col(entity).alias("player_id"), group, F.explode(F.array(F.col(period), F.col(period) + 1)).alias(period)).distinct()
    pairs = cand.join(near.withColumn("_fits", F.lit(True)), ["player_id", group, period], "left").na.fill({"_fits": False})
    found = _decide(pairs, [row_id], True)
    return rows.join(found.select(row_id, F.col("player_id").alias(entity)), row_id, "left")


def unique_substring_match(queries: DataFrame, known: DataFrame, *, query: str = "query", entity: str = "player_id", name: str = "player_name") -> DataFrame:
    """(query, entity): exact normalised name, else the only name that contains the query.

    Grams have as many characters as the largest power of two that the query has room for, and are counted in the names. A query that is one gram takes what the
    count says; others join on the rarest of theirs. An empty query matches nothing. Joins are sorted ones: the optimizer's sizes don't tell of unfolded grams.
    """
    q = queries.select(query, normalize_name(F.col(query)).alias("_q")).distinct()
    ids = [F.min(entity).alias("_lo"), F.max(entity).alias("_hi")]                       # equal where there is only one
    k = known.select(entity, normalize_name(F.col(name)).alias("_n")).groupBy("_n").agg(*ids)
    only = lambda df: df.where(F.col("_lo") == F.col("_hi")).select(query, F.col("_lo").alias("_id"))
    exact = only(q.join(k.hint("merge"), F.col("_q") == F.col("_n")).groupBy(query).agg(F.min("_lo").alias("_lo"), F.max("_hi").alias("_hi")))
    room = F.pow(F.lit(2), F.length(F.bin(F.length("_q"))) - 1).cast("int")
    q = q.where(F.length("_q") > 0).withColumn("_size", room)
    rest = q.join(exact, query, "left_anti")
    grams = lambda c: F.explode(F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(c) - F.col("_size") + 1), lambda i: F.substring(c, i, F.col("_size")))))
    sizes = q.select("_size").distinct()                                                # powers of two
    pieces = k.join(F.broadcast(sizes), F.col("_size") <= F.length("_n")).select("_n", "_lo", "_hi", grams(F.col("_n")).alias("_g"))
    counted = pieces.groupBy("_g").agg(F.count(F.lit(1)).alias("_names"), F.min("_lo").alias("_lo"), F.max("_hi").alias("_hi"))
    asked = rest.select(query, "_q", grams(F.col("_q")).alias("_g")).join(counted.hint("merge"), "_g", "left")
    best = asked.groupBy(query, "_q").agg(F.min_by(F.struct("_g", "_lo", "_hi"), F.struct(F.coalesce("_names", F.lit(0)), F.col("_g"))).alias("_b")).select(query, "_q", "_b.*")
    whole = best.where(F.col("_g") == F.col("_q"))
    part = best.where(F.col("_g") != F.col("_q")).select(query, "_q", "_g").join(pieces.hint("merge"), "_g").where(F.contains("_n", "_q")).groupBy(query).agg(F.min("_lo").alias("_lo"), F.max("_hi").alias("_hi"))
    found = exact.unionByName(only(whole)).unionByName(only(part))
    return queries.select(query).distinct().join(found, query, "left").withColumnRenamed("_id", entity)

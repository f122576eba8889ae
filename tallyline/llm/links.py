"""Connected components of verified links, without listing all pairs of a group.

Members of an inverted list (nodes that have its key) are candidates for each other. Each list is judged by its own size: the members of a short one
are tested pair by pair, those of different components only. Of a longer one, a round picks a few members as pivots, tests every other member against them,
and joins what is linked; lists whose members are all of one component are done. Members that the rounds leave in different components are tested pair by
pair in the end, with the members of a list's largest component on one side only. No link between different components is lost, and a list of g copies
costs about g tests, not g * g.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from tallyline.llm.common import discard, materialise

PIVOTS = 6
ROUNDS = 8
#: Members of a list that is tested pair by pair before any component is known; later, members of such a list, and pairs for each row of all lists
#: together at which the rest is tested pair by pair.
EASY_FIRST, EASY = 24, 1000
#: Lists of a node before the one that a pair meets in, by which a pair that met in one of them already is left out.
PAST = 8


def components(links: DataFrame) -> DataFrame:
    """node, component (the least node it is connected with) of every node of ``links`` (a, b), a written table.

    Large-star and small-star steps by turns: each hangs a node's neighbours on the least of them, until every component is a star.
    """
    edges = materialise(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct(), "links")
    state = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        lowest = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(lowest, "u")
        old, edges = edges, materialise(small.select("u", F.col("m").alias("v")).unionByName(small.select(F.col("v").alias("u"), F.col("m").alias("v"))).filter("u <> v").distinct(), "links")
        new = tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        discard(old)
        if new == state:
            break
        state = new
    roots = edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)


MARKS = ["m0", "m1", "m2", "m3"]


def by_node(entries: DataFrame) -> DataFrame:
    """node, n, marks and the node's keys in order of place, of list entries (key, at, node, n, marks): as many rows as nodes, each as long as its
    text's head."""
    return entries.groupBy("node").agg(*[F.first(c).alias(c) for c in ("n", *MARKS)], F.sort_array(F.collect_list(F.struct("at", "key"))).alias("keys"))


def _cross(lists: DataFrame, labels: DataFrame | None, past: int) -> DataFrame:
    """The lists' entries with their component, without lists of one component; ``giant`` is a large component of the list, ``past`` the
    keys of the node's ``past`` lists before. Components are joined to nodes, before their keys are unfolded."""
    if labels is None:
        placed = lists.withColumn("component", F.col("node"))
    else:
        placed = lists.join(labels, "node", "left").withColumn("component", F.coalesce("component", "node"))
    keys = F.transform("keys", lambda k, i: F.struct(k["key"].alias("key"), k["at"].alias("at"), F.slice("keys", F.greatest(i - past + 1, F.lit(1)), F.least(i, F.lit(past)))["key"].alias("past")))
    placed = placed.select(F.explode(keys).alias("k"), "node", "n", *MARKS, "component").select("k.*", "node", "n", *MARKS, "component")
    sizes = placed.groupBy("key", "component").agg(F.count(F.lit(1)).alias("c"))
    several = sizes.groupBy("key").agg(F.max(F.struct("c", "component")).alias("top"), F.count(F.lit(1)).alias("k"), F.sum("c").alias("size")).filter("k > 1")
    return placed.join(several.select("key", F.col("top.component").alias("giant"), F.col("top.c").alias("of_giant"), "size"), "key")


def near(a: str, b: str) -> Column:
    """Sizes that a likeness of 0.8 allows, and parity marks that do: sets differ in one element at least for every bit in which their
    marks differ, and linked sets of n and m differ in n + m - 2 * needed elements at most."""
    n, m = F.col(f"n_{a}"), F.col(f"n_{b}")
    bits = sum((F.bit_count(F.col(f"{x}_{a}").bitwiseXOR(F.col(f"{x}_{b}"))) for x in MARKS), F.lit(0))
    return (5 * F.least(n, m) >= 4 * F.greatest(n, m)) & (bits <= n + m - 2 * F.floor((4 * (n + m) + 8) / 9))


def first_shared(a: str, b: str) -> Column:
    """Whether sets of n and m may link if the list they meet in is the first that they share: heads are the first elements in one order, so
    neither has an element of the other before its place in the list. A linked pair passes in its first list, and need not in others."""
    n, m = F.col(f"n_{a}"), F.col(f"n_{b}")
    return F.least(n - F.col(f"at_{a}"), m - F.col(f"at_{b}")) >= F.floor((4 * (n + m) + 8) / 9)


def pair_by_pair(entries: DataFrame) -> DataFrame:
    """a, b of different components that share a list and may be linked. Pairs that share one of the lists that both have just before are
    left out: they meet there, or in a list before it. So a pair that shares many lists makes few rows."""
    side = lambda x: [F.col("node").alias(x), *[F.col(c).alias(f"{c}_{x}") for c in ("at", "past")], *_side(x), F.col("component").alias(f"of_{x}")]
    a = entries.filter("component <> giant").select("key", *side("a"))
    b = entries.select("key", *side("b"), F.col("giant").alias("g"))
    once = (F.col("of_b") == F.col("g")) | (F.col("a") < F.col("b"))
    return a.join(b, (a.key == b.key) & (F.col("of_a") != F.col("of_b")) & near("a", "b") & first_shared("a", "b") & once & ~F.arrays_overlap("past_a", "past_b")).select("a", "b")


def _side(name: str, of: str = "") -> list[Column]:
    return [F.col(of + x).alias(f"{x}_{name}") for x in ("n", *MARKS)]


def linked(lists: DataFrame, verified: Callable[[DataFrame], DataFrame]) -> DataFrame | None:
    """node, component over ``lists`` (node, n, marks, keys: place and key), a written table; ``verified`` gives the links (a, b) among candidates (a, b).
    None if there is no list."""
    found, labels, source, before = None, None, lists, None
    for turn in range(ROUNDS + 1):
        rest = materialise(_cross(lists, labels, PAST if turn else 0), "lists-left")    # a first round tests short lists only
        discard(before, source)
        before, source = rest, None
        rows, left = rest.agg(F.count(F.lit(1)), F.sum(F.when(F.col("component") != F.col("giant"), F.col("size")).otherwise(F.lit(0)))).first()
        if not rows:
            break
        # groups of linked members are one component after a round; what pivots leave apart is tested, unless it is still too much
        limit = EASY_FIRST if turn == 0 else (1 << 62) if left <= EASY * rows or turn == ROUNDS else EASY
        harder = limit < (1 << 62) and bool(rest.filter(F.col("size") > limit).limit(1).count())
        wide = rest.select("key", "at", "node", "n", *MARKS, "component", "giant", "past", (F.col("size") <= limit).alias("short"))
        member, easy = wide.filter("NOT short"), wide.filter("short")
        met = pair_by_pair(easy)
        if harder:
            free = member if turn == 0 else member.filter("component <> giant")
            picks = free.groupBy("key").agg(*[F.min_by(F.struct("node", "n", *MARKS, "component"), F.xxhash64("node", F.lit(PIVOTS * turn + i))).alias(f"p{i}") for i in range(PIVOTS)])
            pivot = picks.select("key", F.explode(F.array_distinct(F.array(*[f"p{i}" for i in range(PIVOTS)]))).alias("p")).select(
                "key", F.col("p.node").alias("a"), *_side("a", "p."), F.col("p.component").alias("of_a"))
            c = member.select("key", F.col("node").alias("b"), *_side("b"), F.col("component").alias("of_b"))
            met = met.unionByName(c.join(pivot, (c.key == pivot.key) & (F.col("of_a") != F.col("of_b")) & near("a", "b")).select("a", "b"))
        pairs = materialise(met.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "candidates")
        links = verified(pairs)
        discard(pairs)
        found = links if found is None else found.unionByName(links)
        labels = components(found)
        if not harder:
            break
        lists = by_node(member.select("key", "at", "node", "n", *MARKS))
    discard(before)
    return labels

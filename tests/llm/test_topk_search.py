"""Top-k search against brute force, with nulls, ties, repeated rows and odd vectors."""

import math
import random

import pytest
from pyspark.sql import functions as F

from tallyline.llm import topk_search

SCHEMA = "vec_id bigint, embedding array<double>, score int, block string"


def brute(rows, k, every):
    """(query_id, rank, vec_id, score) by plain integers."""
    kept = [(i, [math.floor(64.0 * x) for x in v]) for i, v in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for a, (q, u) in enumerate(kept):
        if q is None or q % every:
            continue
        scored = [(-max(-2**63 + 1, min(2**63 - 1, sum(x * y for x, y in zip(u, v)))), c is None, c or 0) for b, (c, v) in enumerate(kept) if a != b]
        out += [(q, i + 1, None if null else c, -s) for i, (s, null, c) in enumerate(sorted(scored)[:k])]
    return sorted(out, key=repr)


def result(spark, rows, k, every, **sizes):
    df = spark.createDataFrame([(i, v, 1, "b") for i, v in rows], SCHEMA)
    got = topk_search.top_k(df, F.col("id") % every == 0, k, **sizes)
    return sorted((tuple(r) for r in got.select("query_id", "rank", "vec_id", "score").collect()), key=repr)


@pytest.mark.parametrize("sizes", [{}, {"block_rows": 7, "group_rows": 5}])
def test_like_brute_force(spark, sizes):
    draw = random.Random(5)
    rows = [(i, [draw.gauss(0, 1) * (1 + 3 * (j < 9)) for j in range(37)]) for i in range(300)]
    rows += [(i, [draw.choice([0.0, 0.5]) for _ in range(37)]) for i in range(300, 400)]     # many ties
    rows += [(400 + i, [1.0] * 37) for i in range(120)]                                        # a third of all are copies
    assert result(spark, rows, 20, 10, **sizes) == brute(rows, 20, 10)


@pytest.mark.parametrize("sizes", [{}, {"block_rows": 2, "group_rows": 1}])
def test_cases(spark, sizes):
    rows = [(0, [1.0, 2.0]), (0, [1.0, 2.0]), (1, None), (2, [None, 1.0]), (4, [float("nan"), 1.0]), (6, [float("inf"), 1.0]), (8, []), (10, [0.0, -0.01, 3.0]),
            (None, [1.0, 2.0]), (12, [1.0]), (14, [-5.0, 1.0, 1.0]), (16, [1e9, 1e9]), (18, [1e9, -1e9]), (20, [1e9, 1e9]), (22, [1e300, 1.0]), (24, [-1e300, 1.0]), (3, [0.25, 0.25])]
    assert result(spark, rows, 4, 2, **sizes) == brute(rows, 4, 2)
    assert result(spark, rows[:1], 4, 2, **sizes) == result(spark, [], 4, 2, **sizes) == []
    assert result(spark, [(1, [1.0]), (None, [2.0])], 4, 2, **sizes) == []

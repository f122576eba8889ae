"""Moves between all consecutive years of the data: the single-pair queries are one slice of them."""

import pytest

from tallyline.catalog import CATALOG

FOLDER = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["group_moves", "rank_movers"])
def test_by_year(spark, name):
    every = CATALOG[f"{name}_by_year"].run(spark, FOLDER).collect()
    years = {x[0] for x in spark.read.parquet(f"{FOLDER}/orders.parquet").selectExpr("year(o_orderdate)").distinct().collect()}
    assert {x["y"] for x in every} == {y for y in years if y - 1 in years}
    assert sorted(tuple(x)[1:] for x in every if x["y"] == 1998) == sorted(tuple(x) for x in CATALOG[name].run(spark, FOLDER).collect())

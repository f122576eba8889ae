"""Every registered query with SQL gives DuckDB's rows on the smallest tables; the others run and give rows."""

import os
import sys
from pathlib import Path

import duckdb
import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1] / "tools"))

from check_queries import TABLES, rows  # noqa: E402

from tallyline.catalog import CATALOG  # noqa: E402

FOLDER = "/root/testdata/sf0.001"
SLOW = {"baseline_projection", "walk_forward_naive"}


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(CATALOG))
def test_query(spark, con, name):
    if name in SLOW and not os.environ.get("RUN_SLOW"):
        pytest.skip("set RUN_SLOW=1")
    q = CATALOG[name]
    df = q.run(spark, FOLDER)
    got = [tuple(x) for x in df.collect()]
    if q.sql is None:
        assert df.columns
        return
    res = con.execute(q.sql)
    names = [d[0] for d in res.description]
    want = res.fetchall()
    assert sorted(df.columns) == sorted(names)
    assert rows(df.columns, got, 3) == rows(names, want, 3)

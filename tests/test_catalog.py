"""Every query with an oracle gives its rows; sampled plans keep their filters and avoid Python."""

import math
import os
from pathlib import Path

import duckdb
import pandas as pd
import pytest

from gridlode.plans import catalog
from gridlode.plans.views import Views

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in os.listdir(DATA):
        con.execute(f"create view {Path(f).stem} as select * from read_parquet('{DATA}/{f}')")
    return con


def plain(v):
    if isinstance(v, (list, tuple)) or hasattr(v, "tolist") and not isinstance(v, (str, float, int)):
        return tuple(map(plain, list(v)))
    if v is None or v is pd.NaT or isinstance(v, float) and math.isnan(v):
        return None
    return float(f"{v:.9g}") if isinstance(v, (int, float)) and not isinstance(v, bool) else v


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(str(plain(r[i])) for i in order) for r in rows), key=str)


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_oracle(spark, duck, name):
    got = catalog.QUERIES[name](spark, DATA)
    want = duck.execute(catalog.ORACLES[name])
    cols = [d[0] for d in want.description]
    assert sorted(cols) == sorted(got.columns)
    assert rows_of(got.columns, got.collect()) == rows_of(cols, want.fetchall())


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_plans(spark):
    v = Views(spark, DATA)
    text = plan(catalog.QUERIES["active_parcels_semi"](spark, DATA))
    assert "LeftSemi" in text and "Python" not in text
    assert "PushedFilters: [IsNotNull(o_orderstatus)" in plan(v.table("orders").where("o_orderstatus = 'O'"))
    assert "Cartesian" not in plan(catalog.QUERIES["geology_nearest_basement"](spark, DATA))
    assert "ReadSchema: struct<l_orderkey:bigint,l_partkey:bigint,l_suppkey:bigint,l_linenumber:int,l_quantity:double>" in plan(catalog.QUERIES["layer_stats"](spark, DATA))

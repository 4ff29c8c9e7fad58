"""Every query with SQL against DuckDB over the smallest tables."""

from __future__ import annotations

import os

import pandas as pd
import pytest

from panelforge.plans import queries as Q

SF = "/root/testdata/sf0.001"
#: Without SQL; tests/test_model_queries.py runs them.
MODELS = {"m13_walk_forward_forest", "m14_walk_forward_boosting", "m18_walk_forward", "m21_m22_permutation_importance", "m21_m22_permutation_importance_boosting"}


@pytest.fixture(scope="module")
def duck():
    import duckdb

    con = duckdb.connect()
    for t in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem"):
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


def rows(df: pd.DataFrame) -> list[tuple]:
    df = df[sorted(df.columns)].astype(object)
    return sorted(tuple("null" if pd.isna(x) else f"{x:.6f}" if isinstance(x, float) else str(x) for x in r) for r in df.itertuples(index=False))


@pytest.mark.skipif(not os.path.isdir(SF), reason="the supplied tables are not there")
@pytest.mark.parametrize("name", sorted(Q.SQL))
def test_query_equals_sql(spark, duck, name):
    got, want = Q.QUERIES[name](spark, SF).toPandas(), duck.execute(Q.SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


def test_all_other_queries_are_run_elsewhere():
    assert set(Q.QUERIES) - set(Q.SQL) == MODELS

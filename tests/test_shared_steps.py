"""Steps that many queries share: no branch of a plan is computed twice, rolling features cross batches, months are scaled as by windows."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelforge.operators import asof, features


def plan_of(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_an_as_of_join_reads_its_left_side_once(spark):
    left = spark.range(100).selectExpr("id", "if(id % 3 = 0, null, id % 7) as k", "date_add(date'2000-01-01', cast(id as int) * 20) as t")
    right = spark.createDataFrame([(1, "2000-03-01", 5)], "rk long, since string, v long").withColumn("since", F.to_date("since"))
    once = asof.latest_before(left, right, "k", "t", "rk", "since", [F.col("v")], {"v": "v"})
    twice = asof.latest_before(once.withColumnRenamed("v", "w"), right, "w", "t", "rk", "since", [F.col("v")], {"v": "v"})
    assert plan_of(twice).count("Range (0, 100") == 1 and "Union" not in plan_of(twice)


def test_rows_that_meet_nothing_spread(spark):
    df = spark.range(2000).selectExpr("id", "cast(null as long) as k")
    keys = df.select(asof.unmatched(df).alias("b"))
    assert keys.distinct().count() > 1000 and keys.where("b >= 0").count() == 0


def wanted(r, market, at):
    """The rolling features of one security's row by their definition."""
    some = lambda n, skip=0: [x for x in r[max(0, at + 1 - n - skip) : at + 1 - skip] if x is not None]
    out = {}
    for name, n, skip in (("mom_3m", 3, 0), ("mom_12m", 12, 0), ("mom_12_1", 12, 1)):
        x = some(n, skip)
        out[name] = np.prod([1 + v for v in x]) - 1 if len(x) == n and min(x) > -1 else None
    x, bad, long = some(12), [v for v in some(12) if v < 0], some(36)
    out["vol_12m"], out["max_ret_12m"] = (np.std(x, ddof=1), max(x)) if len(x) >= 6 else (None, None)
    out["downside_vol_12m"] = np.std(bad, ddof=1) if len(bad) >= 6 else None
    n, d = len(long), np.array(long) - np.mean(long) if long else None
    out["skew_36m"] = None if n < 24 else 0.0 if min(long) == max(long) else (d**3).mean() / (d**2).mean() ** 1.5 * np.sqrt(n * (n - 1)) / (n - 2)
    pairs = [(m, v) for m, v in zip(market[max(0, at - 23) : at + 1], r[max(0, at - 23) : at + 1], strict=True) if v is not None]
    m, y = np.array(market[max(0, at - 23) : at + 1]), np.array([v for _, v in pairs])
    if len(y) >= 12:
        mxy = np.mean([a * b for a, b in pairs])
        out["beta_24m"] = (mxy - m.mean() * y.mean()) / ((m * m).mean() - m.mean() ** 2)
    else:
        out["beta_24m"] = None
    return out


@pytest.mark.parametrize("batch", ["7", "10000"])
def test_rolling_features_are_those_of_brute_force(spark, batch):
    rng = np.random.default_rng(3)
    market = rng.normal(0, 0.05, 60).round(4).tolist()
    returns = {p: [None if rng.random() < 0.1 else float(x) for x in rng.normal(0, 0.1, 60 if p else 3).round(3)] for p in range(5)}
    returns[4] = [0.0] * 30 + [-1.0] + [0.1] * 29
    rows = [(p, f"{2000 + i // 12}-{i % 12 + 1:02d}-28", x, market[i], 0.0) for p, r in returns.items() for i, x in enumerate(r)]
    df = spark.createDataFrame(rows, "PERMNO long, d string, ret_adj double, ff_mktrf double, ff_rf double").withColumn("MthCalDt", F.to_date("d")).drop("d")
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    try:
        got = features.with_rolling(df.repartition(3), ("momentum", "volatility")).orderBy("PERMNO", "MthCalDt").collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    at = [(p, i) for p, r in returns.items() for i in range(len(r))]
    assert len(got) == len(at)
    for (p, i), row in zip(at, got, strict=True):
        for name, x in wanted(returns[p], market, i).items():
            assert (row[name] is None) == (x is None) and (x is None or abs(row[name] - x) < 1e-9), (p, i, name, row[name], x)
    assert sum(r.skew_36m is not None for r in got) > 100 and sum(r.downside_vol_12m is not None for r in got) > 5


@pytest.fixture(scope="module")
def panel_rows(spark):
    rng = np.random.default_rng(9)
    cell = lambda: None if rng.random() < 0.15 else float(np.round(rng.normal(), 1))
    rows = [(p, f"2001-{m:02d}-28", bool(rng.random() < 0.8), cell(), cell(), 0.1, None) for m in range(1, 5) for p in range(60 if m < 4 else 6)]
    df = spark.createDataFrame(rows, "PERMNO long, d string, is_investable boolean, a double, b double, c double, e double")
    return df.withColumn("MthCalDt", F.to_date("d")).drop("d").repartition(3).cache()


@pytest.mark.parametrize("name", ["winsorized", "ranked", "standardized"])
def test_months_are_scaled_as_by_windows(panel_rows, name):
    from panelforge.operators import crosssection as X

    names, keys = ["a", "b", "c", "e"], ["PERMNO", "MthCalDt", "is_investable"]
    want = panel_rows.select(*keys, *(getattr(X, name)(F.col(c), ["MthCalDt"], F.col("is_investable")).alias(c) for c in names)).orderBy(*keys).collect()
    done = X.scaled(panel_rows, keys, names, (getattr(X, f"{name}_values"),))
    got = done.orderBy(*keys).collect()
    for x, y in zip(want, got, strict=True):
        for c in names:
            assert (x[c] is None) == (y[c] is None) and (x[c] is None or abs(x[c] - y[c]) < 1e-9), (c, x, y)
    assert "unpivot" not in plan_of(done).lower() and "Expand" not in plan_of(done) and plan_of(done).count("FlatMapGroups") == 1


def test_tables_of_columns(panel_rows, monkeypatch):
    from panelforge.operators import diagnostics as D

    names = ["a", "b", "c", "e"]
    values = {c: np.array([r[c] for r in panel_rows.collect() if r[c] is not None], float) for c in names}
    for cuts in (2, 5, 512):
        monkeypatch.setattr(D, "CUTS", cuts)
        got = {r["column"]: r for r in D.distributions(panel_rows, names).collect()}
        assert set(got) == {"a", "b", "c"}
        for c, r in got.items():
            assert r["n"] == len(values[c]) and np.allclose([r[f"p{int(p * 100):02d}"] for p in D.QUANTILES], np.quantile(values[c], D.QUANTILES), atol=1e-12)
    far = {r["column"]: r for r in D.outliers(panel_rows, names).collect()}
    assert set(far) == {"a", "b", "c"}
    assert far["a"].n == len(values["a"]) and np.isclose(far["a"].pct_outlier, 100 * (abs(values["a"] - values["a"].mean()) > 3 * values["a"].std(ddof=1)).mean())
    shown = {r["column"]: r for r in D.coverage(panel_rows, names).collect()}
    assert shown["e"].non_null == 0 and shown["c"].pct_non_null == 100
    medians = {(str(r.MthCalDt), r["column"]): r["median"] for r in D.stability(panel_rows, names).collect()}
    first = [r.a for r in panel_rows.where("month(MthCalDt) = 1").collect() if r.a is not None]
    assert len(medians) == 16 and np.isclose(medians["2001-01-28", "a"], np.median(first)) and medians["2001-01-28", "e"] is None

"""Boundaries of the panel operators on tiny tables."""

from __future__ import annotations

import math
from dataclasses import replace

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelforge.functions.columns import divide
from panelforge.operators import asof, checks, cleaning, crosssection, features, ic, models, panel, performance, portfolio, profiling, targets
from panelforge.sources import io
from panelforge.sources.schema import DATASETS, dataset


def values(df, *cols):
    return [tuple(r) for r in df.select(*cols).orderBy(*cols).collect()]


def test_specs():
    assert len(DATASETS) == 6 and dataset("crsp_delisting").key == ("PERMNO",)
    with pytest.raises(KeyError):
        dataset("none")


def test_csv_and_dates(spark, tmp_path):
    (tmp_path / "ccm_link_table.csv").write_text("gvkey,tic,LINKPRIM,LIID,LINKTYPE,LPERMNO,LPERMCO,LINKDT,LINKENDDT\n1,A,P,01,LC,10,5,2000-01-31,E\n1,A,P,01,LC,10,5,20010131,bad\n2,B,C,01,LC,11,6,,2003-01-31\n")
    spec = dataset("ccm_link_table")
    raw = io.load_raw(spark, spec, str(tmp_path))
    found = io.date_counts(raw, "LINKENDDT", spec.sentinels["LINKENDDT"]).first()
    assert (found.n_valid, found.n_sentinel, found.n_invalid, found.invalid_samples) == (1, 1, 1, ["bad"])
    assert io.date_counts(raw, "LINKDT").first().n_invalid == 0  # a blank is not invalid
    assert io.parse_dates(raw, spec).where("LINKDT = date '2001-01-31'").count() == 1
    with pytest.raises(FileNotFoundError):
        io.load_raw(spark, dataset("crsp_names"), str(tmp_path))
    io.write_table(raw, str(tmp_path), "t")
    assert io.read_table(spark, str(tmp_path), "t").count() == 3


def test_duplicates(spark):
    df = spark.createDataFrame([(1, 2.0, None), (1, 2.0, 3.0), (1, 2.0, 3.0), (2, None, None)], "k int, a double, b double")
    assert values(cleaning.resolve_duplicate_keys(df, ["k"]), "k", "b") == [(1, 3.0), (2, None)]
    assert tuple(cleaning.duplicate_summary(df, ["k"]).first()) == (4, 2, 1, 2)
    p = profiling.profile_duplicates(df, ("k",)).first()
    assert (p.duplicate_key_rows, p.excess_rows, p.exact_rows, p.conflicting_rows) == (3, 2, 2, 1)
    assert profiling.suggest_key(df) is None and profiling.suggest_key(df.limit(0)) == ()
    assert profiling.suggest_key(spark.createDataFrame([(1, 1), (1, 2), (2, 1)], "a int, b int")) == ("a", "b")


@pytest.fixture
def months(spark, day):
    rows = [(p, day(f"{y}-{m:02d}-28")) for p in (1, 2) for y in (2000, 2001, 2002) for m in range(1, 13)]
    return spark.createDataFrame(rows, "PERMNO long, MthCalDt date")


def test_newest_link_wins_even_when_it_has_ended(spark, months, day):
    links = spark.createDataFrame(
        [(1, day("2000-03-28"), None, "P", 7), (1, day("2001-01-28"), day("2001-06-28"), "C", 8), (1, day("2001-01-28"), day("2001-06-28"), "J", 9)], "LPERMNO long, LINKDT date, LINKENDDT date, LINKPRIM string, gvkey long"
    )
    got = {r.MthCalDt.isoformat(): r.gvkey for r in asof.link_entities(months, links).where("PERMNO = 1").collect()}
    assert got["2000-02-28"] is None and got["2000-03-28"] == 7  # inclusive start
    assert got["2001-01-28"] == 8  # P before C before J
    assert got["2001-06-28"] == 8 and got["2001-07-28"] is None  # inclusive end; the older open link stays hidden
    assert asof.link_entities(months, links).where("PERMNO = 2 and link_matched").count() == 0


def test_annual_facts_lag_and_shelf_life(spark, months, day):
    panel_ = months.withColumn("gvkey", F.when(F.col("PERMNO") == 1, F.lit(5).cast("long")))
    annual = spark.createDataFrame([(5, day("1999-12-31"), 1.0), (5, day("2001-12-31"), 2.0)], "GVKEY long, datadate date, revt double")
    got = {r.MthCalDt.isoformat(): (r.cst_revt, r.cst_expired) for r in asof.attach_annual(panel_, annual, ["revt"]).where("PERMNO = 1").collect()}
    assert got["2000-06-28"] == (None, False) and got["2000-07-28"] == (1.0, False)  # available on 30 June
    assert got["2001-06-28"] == (1.0, False) and got["2001-07-28"] == (None, True)  # 12 months live, 13 expired
    assert got["2002-07-28"] == (2.0, False)
    assert asof.attach_annual(panel_, annual, ["revt"]).count() == 72  # rows without gvkey stay


def test_delisting_returns(spark, day):
    p = spark.createDataFrame([(1, day("2000-01-31"), 0.1), (1, day("2000-02-29"), None), (2, day("2000-02-29"), 0.2), (3, day("2000-02-29"), 0.3)], "PERMNO long, MthCalDt date, MthRet double")
    d = spark.createDataFrame([(1, -0.5), (2, None)], "PERMNO long, DelRet double")
    got = {(r.PERMNO, r.MthCalDt.month): (r.ret_adj, r.is_last_obs, r.is_delisted, r.delisting_return_missing) for r in panel.delisting_returns(p, d).collect()}
    assert got[1, 1] == (0.1, False, False, False) and got[1, 2] == (-0.5, True, True, False)
    assert got[2, 2] == (0.2, True, True, True) and got[3, 2] == (0.3, True, False, False)
    with pytest.raises(Exception, match="unique"):
        panel.delisting_returns(p, d.union(d)).collect()


def test_divide(spark):
    df = spark.createDataFrame([(1.0, 2.0), (1.0, 0.0), (1.0, -1.0), (1.0, None)], "a double, b double")
    assert [r[0] for r in df.select(divide("a", "b")).collect()] == [0.5, None, None, None]
    assert [r[0] for r in df.select(divide("a", "b", positive=False)).collect()] == [0.5, None, -1.0, None]


def test_rolling_needs_all_months_and_handles_total_loss(spark, day):
    rets = [0.1, -1.0, 0.2, 0.3, None, 0.1]
    df = spark.createDataFrame([(1, day(f"2000-{i + 1:02d}-28"), r) for i, r in enumerate(rets)], "PERMNO long, MthCalDt date, ret_adj double")
    got = [r[0] for r in df.select("MthCalDt", features.compounded(F.col("ret_adj"), 2).alias("m")).orderBy("MthCalDt").select("m").collect()]
    assert got[:3] == [None, None, None] and math.isclose(got[3], 0.56) and got[4:] == [None, None]
    forward = [r[0] for r in df.select("MthCalDt", targets.forward_return(F.col("ret_adj")).alias("t")).orderBy("MthCalDt").select("t").collect()]
    assert forward[0] == -1.0 and forward[3] is None and forward[5] is None


def test_registry():
    assert len(features.NAMES) == 51 and len(features.MODEL_NAMES) == 50 and "reversal_1m" not in features.MODEL_NAMES


def test_cross_sections(spark, day):
    rows = [(i, day("2000-01-31"), float(v), i != 4) for i, v in enumerate([1, 2, 2, 3, 100])]
    df = spark.createDataFrame(rows, "PERMNO long, MthCalDt date, x double, inside boolean")
    ranks = [r[0] for r in df.select("PERMNO", crosssection.ranked(F.col("x"), ["MthCalDt"], F.col("inside")).alias("r")).orderBy("PERMNO").select("r").collect()]
    assert ranks == [-0.5, 0.25, 0.25, 1.0, None]
    same = [r[0] for r in df.select("PERMNO", crosssection.winsorized(F.col("x"), ["MthCalDt"], F.col("inside")).alias("r")).orderBy("PERMNO").select("r").collect()]
    assert same == [1.0, 2.0, 2.0, 3.0, 100.0]  # below ten values nothing is clipped
    clipped = [r[0] for r in df.select("PERMNO", crosssection.winsorized(F.col("x"), ["MthCalDt"], F.col("inside"), 0.0, 1.0, 2).alias("r")).orderBy("PERMNO").select("r").collect()]
    assert clipped[4] == 3.0  # rows outside the universe are clipped too


def test_folds(day):
    grid = [day(f"{1999 + i // 12}-{i % 12 + 1:02d}-28") for i in range(324)]
    folds = targets.walk_forward_folds(grid)
    assert len(folds) == 21 and sum((grid.index(f.test_end) - grid.index(f.test_start) + 1) for f in folds) == 231
    f = folds[0]
    at = [grid.index(x) for x in (f.train_end, f.inner_train_end, f.inner_val_start, f.test_start, f.test_end)]
    assert at == [70, 55, 58, 73, 83]
    with pytest.raises(ValueError):
        targets.walk_forward_folds(grid[:50])
    assert targets.walk_forward_folds([]) == []


def test_weights_buckets(spark, day):
    df = spark.createDataFrame([(i, day("2000-01-31"), "m", float(i)) for i in range(23)] + [(1, day("2000-02-28"), "m", 1.0)], "PERMNO long, MthCalDt date, model string, y_pred double")
    got = portfolio.weights(df).collect()
    assert sorted(r.PERMNO for r in got if r.weight < 0) == [0, 1] and sorted(r.PERMNO for r in got if r.weight > 0) == [20, 21, 22]
    assert math.isclose(sum(r.weight for r in got), 0, abs_tol=1e-12) and {r.MthCalDt.month for r in got} == {1}
    with pytest.raises(ValueError):
        portfolio.weights(df, 1)


def test_turnover_counts_entries_exits_and_the_start(spark, day):
    held = spark.createDataFrame([(1, day("2000-01-31"), "m", 1.0), (2, day("2000-01-31"), "m", -1.0), (1, day("2000-03-31"), "m", 1.0), (3, day("2000-03-31"), "m", -1.0)], "PERMNO long, MthCalDt date, model string, weight double")
    assert values(portfolio.turnover(held), "turnover") == [(1.0,), (1.0,)]


def test_performance_starts_drawdown_at_first_value(spark, day):
    r = spark.createDataFrame([(day(f"2000-{i + 1:02d}-28"), "m", x, 0.0, 0.0, x) for i, x in enumerate([-0.5, 0.1, -0.2, 0.3])], "MthCalDt date, model string, gross_return double, turnover double, cost double, net_return double")
    got = performance.performance(r).where("kind = 'net'").first()
    assert math.isclose(got.max_drawdown, -0.2) and got.n_periods == 4 and math.isclose(got.hit_rate, 0.5)
    assert math.isclose(got.sortino, np.mean([-0.5, 0.1, -0.2, 0.3]) / np.std([-0.5, -0.2], ddof=1) * 12**0.5)


def test_newey_west_without_lags_matters():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(200, 2))
    y = 0.5 + x @ [1.0, -2.0] + 0.1 * rng.normal(size=200)
    b, t, r2 = performance.newey_west(y, x)
    assert np.allclose(b, [0.5, 1.0, -2.0], atol=0.05) and (abs(t) > 20).all() and r2 > 0.99


def test_newey_west_against_sums_written_out():
    """Lag weights, both directions of a lag and the sandwich, each as a plain double sum."""
    rng = np.random.default_rng(7)
    n = 60
    x = rng.normal(size=(n, 2))
    e = np.convolve(rng.normal(size=n + 3), [1.0, 0.6, 0.3, 0.1], "valid")
    y = 0.2 + x @ [0.5, -0.4] + e
    b, t, _ = performance.newey_west(y, x)
    z = np.column_stack([np.ones(n), x])
    u = y - z @ b
    lags = max(1, round(4 * (n / 100) ** (2 / 9)))
    s = np.zeros((3, 3))
    for i in range(n):
        for j in range(n):
            if abs(i - j) <= lags:
                s += (1 - abs(i - j) / (lags + 1)) * u[i] * u[j] * np.outer(z[i], z[j])
    bread = np.linalg.inv(sum(np.outer(r, r) for r in z))
    assert lags == 4 and np.allclose(b, np.linalg.solve(z.T @ z, z.T @ y)) and np.allclose(t, b / np.sqrt(np.diag(bread @ s @ bread)))


def test_ic(spark):
    df = spark.createDataFrame([("a", 1.0, 1.0), ("a", 2.0, 2.0), ("a", 3.0, 2.0), ("a", None, 9.0), ("b", 1.0, 1.0), ("c", 1.0, 5.0), ("c", 2.0, 5.0)], "g string, y_true double, y_pred double")
    got = {r.g: (r.ic, r.n) for r in ic.ic_by(df, ["g"]).collect()}
    assert math.isclose(got["a"][0], 0.8660254037844387) and got["a"][1] == 4 and got["b"][0] is None and got["c"][0] is None
    assert math.isclose(ic.pooled_ic(df.where("g = 'a'"), "y_true", "y_pred"), 0.8660254037844387)


def test_estimators_match_closed_forms(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(120, 2))
    y = x @ [1.0, -0.5] + 0.3 * rng.normal(size=120)
    df = spark.createDataFrame([(float(a), float(b), float(c)) for (a, b), c in zip(x, y, strict=True)], "f double, g double, t double")
    ridge = models.fit(models.RIDGE, {"alpha": 10.0}, df, ["f", "g"], "t")
    xc, yc = x - x.mean(0), y - y.mean()
    assert np.allclose(ridge.coefficients, np.linalg.solve(xc.T @ xc + 10 * np.eye(2), xc.T @ yc), atol=1e-8)
    lasso = models.fit(models.LASSO, {"alpha": 10.0}, df, ["f", "g"], "t")
    assert np.allclose(lasso.coefficients, 0)
    for params in ({"alpha": 0.1, "l1_ratio": 0.5}, {"alpha": 0.01, "l1_ratio": 0.9}):  # no step improves the objective
        net = models.fit(models.ELASTIC_NET, params, df, ["f", "g"], "t")
        loss = lambda b, p=params: ((yc - xc @ b) ** 2).mean() / 2 + p["alpha"] * (p["l1_ratio"] * abs(b).sum() + (1 - p["l1_ratio"]) / 2 * (b**2).sum())
        assert all(loss(net.coefficients + step * e) > loss(net.coefficients) for e in np.eye(2) for step in (-1e-4, 1e-4))
        assert math.isclose(net.intercept, y.mean() - net.coefficients @ x.mean(0), abs_tol=1e-9)
    scored = models.score(ridge, df, ["f", "g"]).toPandas()
    assert np.allclose(scored.y_pred, ridge.intercept + scored[["f", "g"]].to_numpy() @ ridge.coefficients)
    assert models.fit(models.RIDGE, {"alpha": 1.0}, df.where("f is null"), ["f", "g"], "t") is None
    small = models.Estimator("forest", {}, lambda p, seed: models._forest({"max_depth": 3, "min_samples_leaf": 5, "max_features": "sqrt", "trees": 5}, seed))
    assert models.score(models.fit(small, {}, df, ["f", "g"], "t"), df, ["f", "g"]).count() == 120
    best, value, trials = models.tune(models.RIDGE, df, df, ["f", "g"], "t")
    assert len(trials) == 4 and value is not None and best in [p for p, _ in trials]


def test_default_runners_are_all_estimators_and_trees_score(spark, day):
    assert set(models.runners()) == {"equal_weight", "momentum_sort", "fama_macbeth", "ridge", "lasso", "elastic_net", "random_forest", "hist_gradient_boosting"}
    rng = np.random.default_rng(3)
    x = rng.normal(size=200)
    df = spark.createDataFrame([(i, day("2000-01-31"), float(v), float(v**2)) for i, v in enumerate(x)] + [(200, day("2000-01-31"), None, 1.0)], "PERMNO long, MthCalDt date, f double, t double")
    few = {"random_forest": {"trees": (20,), "max_depth": (3,), "min_samples_leaf": (5, 1000), "max_features": ("sqrt", 0.5)}, "hist_gradient_boosting": {"rounds": (5,), "max_depth": (3, None), "learning_rate": (0.1,)}}
    small = tuple(replace(e, grid=few[e.name]) for e in models.ESTIMATORS if e.name in few)
    for name in few:
        fold = targets.Fold(0, *[day("2000-01-31")] * 7)
        got = models.runners(small)[name](models.Training(df, ["f"], "t", [fold]))
        assert got.count() == 200 and ic.pooled_ic(got, "t", "y_pred") > 0.8


def test_behaviour_checks_find_what_they_should(spark, months):
    honest = lambda p: p.withColumn("x", F.month("MthCalDt").cast("double"))
    peeking = lambda p: p.crossJoin(p.agg(F.count(F.lit(1)).cast("double").alias("x")))
    dates = checks.sampled_dates(months)
    assert len(dates) == 3
    assert checks.no_leakage(honest, months, dates[:1], ["x"]).first().passed
    assert not checks.no_leakage(peeking, months, dates[:1], ["x"]).first().passed
    assert checks.no_calendar_gaps(months).first().passed and not checks.no_calendar_gaps(months.where("month(MthCalDt) <> 5")).first().passed

"""Steps whose tasks must not grow with the tables."""

from __future__ import annotations

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelforge.functions.counts import column_moments, non_null_by_month
from panelforge.operators import asof, checks, crosssection, diagnostics, features, panel, targets
from panelforge.operators.crosssection import ranked_values, rounded_values
from panelforge.plans import pipelines
from panelforge.plans import queries as Q
from panelforge.plans.relations import RELATIONS, by_raw_name, relations


def monthly(spark, securities: int, months: int = 24):
    return spark.range(securities * months).select(
        (F.col("id") / months).cast("long").alias("PERMNO"), F.last_day(F.add_months(F.lit(dt.date(2000, 1, 1)), (F.col("id") % months).cast("int"))).alias("MthCalDt"),
    )


def test_rows_of_a_task_do_not_grow_with_the_panel(spark, monkeypatch):
    monkeypatch.setattr(panel, "TASK_ROWS", 100)
    got = panel.by_security(monthly(spark, 200)).select("PERMNO", F.spark_partition_id().alias("task"))
    assert got.select("task").distinct().count() > 30  # of 48
    assert got.distinct().count() == 200  # no security lies in two tasks


def test_links_by_key_alone_are_the_links_by_buckets(spark):
    links = spark.createDataFrame(
        [(p, dt.date(1999 + (p + k) % 3, 6, 30), dt.date(2001, 3, 31) if (p + k) % 2 else None, "PCJN"[k], 10 * p + k) for p in range(1, 30) for k in range(3)],
        "LPERMNO long, LINKDT date, LINKENDDT date, LINKPRIM string, gvkey long",
    )
    rows = monthly(spark, 40).unionByName(spark.sql("select cast(null as long) as PERMNO, date '2000-01-31' as MthCalDt"))
    alone, by_bucket = (asof.link_entities(rows, links, years) for years in (None, 2))
    assert alone.count() == rows.count() and alone.where("link_matched").count() > 100
    assert alone.exceptAll(by_bucket).count() == 0 and by_bucket.exceptAll(alone).count() == 0


def test_moments_of_equal_and_of_many_values(spark):
    df = spark.range(0, 5000, numPartitions=7).selectExpr("0.1 as a", "cast(id as double) * 1e-3 + 1e6 as b", "case when id = 17 then 3.0 end as c", "cast(null as double) as d")
    (n, mean, m2), b, c, d = column_moments(df, ["a", "b", "c", "d"])
    assert (n, mean, m2) == (5000, 0.1, 0.0)  # a mean beside the value would make every row an outlier
    x = np.arange(5000) * 1e-3 + 1e6
    assert b[0] == 5000 and abs(b[1] - x.mean()) < 1e-9 and abs(b[2] / np.square(x - x.mean()).sum() - 1) < 1e-9
    assert c == (1, 3.0, 0.0) and d[0] == 0
    got = {r.column: (r.n, r.pct_outlier) for r in diagnostics.outliers(df, ["a", "b", "c", "d"]).collect()}
    assert got == {"a": (5000, 0.0), "b": (5000, 0.0), "c": (1, 0.0)}


def test_counts_by_month(spark):
    df = monthly(spark, 30, 5).selectExpr("case when PERMNO % 10 <> 0 then MthCalDt end as MthCalDt", "case when PERMNO % 3 = 0 then 1.0 end as a", "PERMNO as b")
    df = df.unionByName(spark.sql("select date '2000-01-31' as MthCalDt, double('NaN') as a, cast(null as long) as b"))
    got = sorted(map(tuple, non_null_by_month(df, ["a", "b"]).collect()), key=str)
    want = sorted(map(tuple, df.groupBy("MthCalDt").agg(F.count(F.lit(1)), F.count("a"), F.count("b")).collect()), key=str)
    assert got == want and len(got) == 6


@pytest.mark.parametrize("columns", [["a"], ["a", "b", "c"]])
def test_wide_tables_are_not_aggregated_cell_by_cell(spark, columns):
    df = spark.range(100).selectExpr(*(f"cast(id as double) as {c}" for c in columns), "date '2000-01-31' as MthCalDt")
    for made in (diagnostics.coverage(df, columns), diagnostics.coverage_over_time(df, columns)):
        assert "MapInArrow" in made._jdf.queryExecution().executedPlan().toString()
    assert {tuple(r) for r in diagnostics.coverage(df, columns).collect()} == {(c, 100, 100, 100.0, 0.0) for c in columns}


def test_ranks_do_not_depend_on_the_order_of_equal_values():
    x = np.random.default_rng(1).integers(0, 40, 5000).astype(float)
    there, inside = x != 7, x != 9
    order = np.random.default_rng(2).permutation(len(x))
    got, kept = ranked_values(x, there, inside)
    moved, _ = ranked_values(x[order], there[order], inside[order])
    assert (got[order] == moved).all() and (kept == (there & inside)).all()
    own = np.sort(x[kept])
    assert abs((got[kept & (x == 3)][0] + 1) / 2 * len(own) - np.flatnonzero(own == 3).mean() - 1) < 1e-6


def test_columns_are_rounded_as_spark_rounds(spark):
    rng = np.random.default_rng(4)
    ties = (rng.integers(-10**6, 10**6, 400) * 10 + 5) / 1e7  # a 5 in the seventh place
    ranks = np.arange(1, 1281) / 1280 * 2 - 1
    x = np.concatenate([rng.normal(size=2000), rng.normal(size=200) * 1e12, ties, np.nextafter(ties, 9), np.nextafter(ties, -9), ranks, [0.0, -0.0, -1e-9, 1e300, -4e15, 1e-300, np.inf, -np.inf, np.nan, 0.5, 2.0**53]])
    df = spark.createDataFrame([(i, float(v)) for i, v in enumerate(x)], "i int, v double").selectExpr("i", "round(v, 6) + 0D as v")
    want = np.array([r.v for r in df.orderBy("i").collect()])
    got = rounded_values(x, 6)
    assert ((got == want) | (np.isnan(got) & np.isnan(want))).all() and not (np.signbit(got) & (got == 0)).any()


@pytest.mark.parametrize("name", ["x1_x3_winsorized_zscore_all_features", "x2_rank_all_features", "x3_zscore_all_features", "x5_model_ready_features"])
def test_cells_are_not_rounded_one_by_one(spark, name):
    plan = Q.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "FlatMapGroupsInArrow" in plan and "round(value" not in plan


def test_targets_that_travel_with_the_rows(spark):
    rows = monthly(spark, 40, 6).selectExpr("PERMNO", "MthCalDt", "PERMNO % 5 <> 0 as is_investable", "case when PERMNO % 7 <> 3 then (PERMNO * 31 + month(MthCalDt)) % 17 / 100D - 0.05 end as ret_adj")
    with_raw = rows.withColumn("target_raw", targets.forward_return(F.col("ret_adj"), 2))
    columns = ["PERMNO", "MthCalDt", "target_raw", "target_valid"]
    got, want = targets.demeaned(with_raw, with_raw), targets.targets(rows, 2)
    assert got.select(columns).exceptAll(want.select(columns)).count() == 0 and got.count() == want.count() == 240
    both = got.alias("a").join(want.alias("b"), ["PERMNO", "MthCalDt"]).selectExpr("a.target_demeaned as x", "b.target_demeaned as y")
    assert both.where("(x is null) <> (y is null) or abs(x - y) > 1e-12").count() == 0 and both.where("x is not null").count() > 100


def test_the_job_checks_what_it_has_written_and_the_denominators_without_rolling(spark, monkeypatch, tmp_path):
    asked, taken = [], {}
    real = features.raw_features

    def build(master, annual, families=tuple(features.FAMILIES), more=()):
        if more:
            asked.append(families)
        return real(master, annual, families, more)

    monkeypatch.setattr(features, "raw_features", build)
    monkeypatch.setattr(checks, "isolated", lambda transform, df, months, columns, whole=None: taken.update(whole=whole) or checks.no_duplicate_keys(df, ["PERMNO"]))
    t = by_raw_name(relations(spark, "/root/testdata/sf0.001"))
    master, annual = panel.master_panel(t), t["compustat_fundamentals_annual"]
    pipelines.feature_checks(real(master, annual), master, annual, 1, 1, master.limit(0))
    assert len(asked) == 1 and not set(asked[0]) & set(features.ROLLING) and taken["whole"] is not None
    kinds = {f.name for f in features.REGISTRY if f.category in asked[0]}
    assert set(checks.DENOMINATORS) <= kinds


def test_infinite_values_are_counted_in_tasks(spark):
    df = spark.range(0, 90, numPartitions=4).selectExpr("case when id % 9 = 1 then double('inf') when id % 9 = 2 then double('-inf') when id % 9 = 3 then double('NaN') when id % 9 > 3 then 1D end as a", "cast(id as int) as b")
    made = checks.no_infinite_values(df, ["a", "b"])
    assert "MapInArrow" in made._jdf.queryExecution().executedPlan().toString()
    assert [(r.passed, r.affected) for r in made.collect()] == [(False, 20)]
    assert checks.no_infinite_values(df.where("id = 0"), ["a", "b"]).first().affected == 0


def test_medians_shuffle_columns_of_months_instead_of_rows(spark, monkeypatch):
    rng, odd = np.random.default_rng(3), [float("nan"), float("inf"), float("-inf"), -0.0, None]
    cell = lambda: odd[rng.integers(5)] if rng.random() < 0.2 else float(np.round(rng.normal(), 1))
    rows = [(None if m == 5 else dt.date(2001, m, 28), cell(), cell() if m != 2 else None, 7) for m in range(1, 6) for _ in range(int(rng.integers(1, 60)))]
    df = spark.createDataFrame([rows[i] for i in rng.permutation(len(rows))], "MthCalDt date, a double, b double, c long").repartition(3)
    for size in (7, 50_000):
        monkeypatch.setattr(crosssection, "PACKED_ROWS", size)
        made = diagnostics.stability(df, ["a", "b", "c"])
        got = {(r.MthCalDt, r.column): r.median for r in made.collect()}
        assert len(got) == 15
        for (month, c), median in got.items():
            x = np.sort([r["abc".index(c) + 1] for r in rows if r[0] == month and r["abc".index(c) + 1] is not None])
            low, high = (x[(len(x) - 1) // 2], x[len(x) // 2]) if len(x) else (None, None)
            with np.errstate(invalid="ignore"):
                want = low if low == high else (low + high) / 2
            assert median == want or (np.isnan(median) and np.isnan(want)), (month, c, median, want)
    exchanges = [line for line in made._jdf.queryExecution().executedPlan().toString().split("\n") if "Exchange hashpartitioning" in line]
    assert exchanges and all("month" in line and " i#" in line for line in exchanges[:1])  # no task holds all columns of a month


ODD_AMOUNTS = [1.005, 2.675, -2.675, 0.125, 0.005, -0.005, 0.0049999, 1e8, 123456789.125, 99999999.99, -99999999.995, 1e15, 9999999999999998.0, -9e15, 1.1, 0.29, float("nan"), None, 0.0, -0.0, 33.333333]


def test_sums_in_whole_cents_are_the_sums_of_decimals(spark, tmp_path):
    rng = np.random.default_rng(5)
    amount = lambda: ODD_AMOUNTS[rng.integers(len(ODD_AMOUNTS))] if rng.random() < 0.3 else float(np.round(rng.normal() * 10.0 ** rng.integers(0, 7), rng.integers(0, 5)))
    day = lambda i: dt.datetime(1995, 1 + i % 4, 5)
    lines = [(i % 9, day(i // 9), 9e15 if i % 9 == 8 else amount(), float(rng.integers(1, 50)) if i % 5 else 2.675, [0.01, 0.09, None, 0.05][i % 4]) for i in range(2000)]
    orders = [(i % 40, day(i), 9e15 if i % 40 == 7 else amount(), "FOP"[i % 3], f"{1 + i % 5}-X") for i in range(2000)]
    folder = str(tmp_path)
    spark.createDataFrame(lines, "l_suppkey long, l_shipdate timestamp, l_extendedprice double, l_quantity double, l_discount double").write.parquet(f"{folder}/lineitem.parquet")
    spark.createDataFrame(orders, "o_custkey long, o_orderdate timestamp, o_totalprice double, o_orderstatus string, o_orderpriority string").write.parquet(f"{folder}/orders.parquet")
    spark.range(40).selectExpr("id as c_custkey", "cast(id % 8 as int) as c_nationkey").write.parquet(f"{folder}/customer.parquet")
    spark.range(9).selectExpr("id as s_suppkey", "cast(id as int) as s_nationkey").write.parquet(f"{folder}/supplier.parquet")
    tables = {t: spark.read.parquet(f"{folder}/{t}.parquet") for t in ("lineitem", "orders", "customer")}
    got = relations(spark, folder)
    for name in ("crsp", "fund"):
        want = spark.sql(RELATIONS[name], **{k: v for k, v in tables.items() if "{" + k + "}" in RELATIONS[name]})
        plan = got[name]._jdf.queryExecution().optimizedPlan().toString()
        assert "shiftright" in plan and got[name].schema == want.schema
        assert got[name].exceptAll(want).count() == 0 and got[name].count() == want.count() > 7
    assert got["crsp"].where("MthCap > 9.3e16").count()  # more cents than a long holds


@pytest.mark.parametrize("families", [tuple(features.FAMILIES), ("size", "value")])
def test_features_are_packed_in_the_pass_that_makes_them(spark, families):
    t = by_raw_name(relations(spark, "/root/testdata/sf0.001"))
    master, annual = panel.master_panel(t), t["compustat_fundamentals_annual"]
    names = [f.name for f in features.REGISTRY if f.category in families]
    made = crosssection.packed_medians(features.raw_features(master, annual, families, then=crosssection.packing(names)), names)
    assert made._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow") == 1
    want = diagnostics.stability(features.raw_features(master, annual, families), names)
    got = sorted(map(tuple, made.collect()), key=str)
    assert got == sorted(map(tuple, want.collect()), key=str) and len(got) % len(names) == 0 and len(got) > 50

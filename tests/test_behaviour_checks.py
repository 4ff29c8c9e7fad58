"""The behaviour checks of the registered query and of the job cover all features and all sampled months, and see what is planted."""

from __future__ import annotations

import os

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from panelforge.operators import checks, features, panel
from panelforge.plans import queries as Q
from panelforge.plans.pipelines import feature_checks
from panelforge.plans.relations import by_raw_name, relations

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="the supplied tables are not there")


def stack(spark):
    t = by_raw_name(relations(spark, SF))
    dates = checks.sampled_dates(t["crsp_monthly_stock"])
    return checks.stacked(t, dates), dates


def found(spark, names):
    t, dates = stack(spark)
    built = features.raw_features(panel.master_panel(t), t["compustat_fundamentals_annual"], ("growth", "value"))
    return {r.check_name: r for r in checks.variant_checks(built, dates, names).collect()}


def test_all_variants_are_one_plan(spark):
    t, _ = stack(spark)
    built = features.raw_features(panel.master_panel(t), t["compustat_fundamentals_annual"])
    assert built._jdf.queryExecution().executedPlan().toString().count("Exchange") < 100


def test_a_leak_in_an_annual_feature_at_the_last_month_is_found(spark, monkeypatch):
    _, dates = stack(spark)
    honest = found(spark, ["growth_sales", "value_bm"])
    assert honest["no_leakage_via_truncation"].passed and honest["reproducibility"].passed and "3 cutoffs" in honest["no_leakage_via_truncation"].detail
    later = F.count("MthCalDt").over(Window.partitionBy("PERMNO").orderBy("MthCalDt").rowsBetween(1, Window.unboundedFollowing))
    growth = features.FAMILIES["growth"]
    monkeypatch.setitem(features.FAMILIES, "growth", lambda: growth() | {"growth_sales": F.when(F.col("MthCalDt") == F.lit(dates[-1]), later.cast("double"))})
    got = found(spark, ["growth_sales", "value_bm"])
    assert not got["no_leakage_via_truncation"].passed and got["reproducibility"].passed


def test_a_leak_in_the_annual_join_is_found(spark, monkeypatch):
    """Annual facts that are attached a year before their date."""
    honest = panel.attach_annual
    monkeypatch.setattr(panel, "attach_annual", lambda p, annual, columns: honest(p, annual, columns, lag_months=-12, shelf_months=36))
    assert not found(spark, ["value_bm", "value_sales_to_price"])["no_leakage_via_truncation"].passed


def test_a_build_that_is_not_reproducible_is_found(spark, monkeypatch):
    monkeypatch.setitem(features.FAMILIES, "growth", lambda: {f"growth_{x}": F.rand() for x in ("asset", "sales", "capx", "inventory", "receivables", "ppent", "equity")})
    assert not found(spark, ["growth_sales"])["reproducibility"].passed


def test_the_job_checks_isolation_in_all_sampled_months(spark, monkeypatch):
    seen = {}
    monkeypatch.setattr(checks, "isolated", lambda transform, df, months, columns: seen.update(months=months, columns=columns) or checks.sources_exist(df))
    master, t = Q._master(spark, SF)
    feature_checks(Q._raw(spark, SF), master, t["compustat_fundamentals_annual"])
    assert len(seen["months"]) == 3 and seen["columns"] == list(features.NAMES)

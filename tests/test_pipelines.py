"""The five jobs end to end, from CSV files to performance tables."""

from __future__ import annotations

import os

import pytest
from pyspark.sql import functions as F

from panelforge.operators.models import equal_weight, momentum_sort
from panelforge.operators.targets import ModelConfig
from panelforge.plans import pipelines as P
from panelforge.plans.relations import by_raw_name, relations
from panelforge.sources.schema import DATASETS

SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SF), reason="the supplied tables are not there")
def test_jobs(spark, tmp_path):
    raw, interim, processed, reports = (str(tmp_path / d) for d in ("raw", "interim", "processed", "reports"))
    tables = by_raw_name(relations(spark, SF))
    tables["crsp_monthly_stock"] = tables["crsp_monthly_stock"].where("PERMNO < 6")
    os.makedirs(raw)
    for name, spec in DATASETS.items():
        df = tables.get(name)
        rows = df.select(*(F.col(c) if c in df.columns else F.lit(None).alias(c) for c in spec.types)).toPandas() if df else None
        if rows is None:
            text = ",".join(c for c in spec.types) + "\n"
            (tmp_path / "raw" / spec.filename).write_text(text)
        else:
            if name == "ccm_link_table":
                rows["LINKENDDT"] = rows["LINKENDDT"].astype(object).where(rows["LINKENDDT"].notna(), "E")
            if name == "crsp_monthly_stock":
                rows = rows._append(rows.iloc[:3])  # exact duplicates
            for c, kind in spec.types.items():
                if kind == "LONG":
                    rows[c] = rows[c].astype("Int64")
            rows.to_csv(tmp_path / "raw" / spec.filename, index=False)
    found = P.validate(spark, raw, interim, reports)
    assert found["findings"].count() == 10
    assert found["crsp_monthly_stock_cleaning"].first().rows_dropped == 3
    assert found["ccm_link_table_dates"].where("column = 'LINKENDDT'").first().n_sentinel > 0
    made = P.build_panel(spark, interim, processed, reports)
    n = tables["crsp_monthly_stock"].count()
    assert made["merge_diagnostics"].first().rows == n and made["merge_diagnostics"].first().duplicate_keys == 0
    checked = P.build_features(spark, processed, interim, reports, entities=2, months=1)
    failed = [r.check_name for r in checked["checks"].where("not passed").collect()]
    assert failed in ([], ["no_calendar_gaps"])
    assert spark.read.parquet(f"{processed}/features_model_ready.parquet").count() == n
    config = ModelConfig(min_train=36)
    out = P.run_models(spark, processed, reports, ["mom_1m", "mom_12_1"], config, {"equal_weight": equal_weight, "momentum_sort": momentum_sort})
    assert out["folds"].count() == 4 and out["model_checks"].where("not passed").count() == 0
    tested = P.run_backtest(spark, processed, reports, deciles=2)
    assert {r.kind for r in tested["performance"].collect()} == {"gross", "net"}
    assert tested["cost_sensitivity"].count() == 5 * tested["performance"].select("model").distinct().count()

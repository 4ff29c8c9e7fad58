"""The five composed jobs: each reads tables, writes tables and returns the result tables."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelforge.operators import checks, features, ic, integrity, panel, performance, portfolio, profiling, targets
from panelforge.operators.cleaning import clean, cleaning_summary, duplicate_summary
from panelforge.operators.crosssection import model_ready
from panelforge.operators.models import Runner, runners, walk_forward
from panelforge.sources.io import INTERIM, load_all_raw, overwrite_years, parse_dates, read_interim, read_table, write_result, write_table
from panelforge.sources.schema import DATASETS

#: Rows of a security that the longest window reaches back.
WINDOW_ROWS = 36


def validate(spark: SparkSession, raw: str, interim: str, reports: str) -> dict[str, DataFrame]:
    """Raw CSV -> profiles, findings and interim Parquet tables."""
    tables = load_all_raw(spark, raw)
    parsed = {name: parse_dates(df, DATASETS[name]) for name, df in tables.items()}
    out = {"findings": integrity.all_findings(parsed)}
    for name, df in tables.items():
        out |= {f"{name}_{k}": v for k, v in profiling.profile_dataset(df, DATASETS[name]).items()}
        out[f"{name}_cleaning"] = cleaning_summary(df)
        write_table(clean(df, DATASETS[name]), interim, name)
    for name, df in out.items():
        write_result(df, reports, name, "json")
    return out


def build_panel(spark: SparkSession, interim: str, processed: str, reports: str) -> dict[str, DataFrame]:
    """Interim tables -> master panel, merge diagnostics."""
    tables = read_interim(spark, interim)
    write_table(panel.master_panel(tables), processed, "master_panel", "MthCalDt")
    made = read_table(spark, processed, "master_panel").drop("year")
    out = {"merge_diagnostics": panel.merge_diagnostics(made), "firm_coverage": panel.firm_coverage(made), "dedup": duplicate_summary(tables[INTERIM[0]], ["PERMNO", "MthCalDt"])}
    for name, df in out.items():
        write_result(df, reports, name)
    return out


def build_features(spark: SparkSession, processed: str, interim: str, reports: str, entities: int = 40, months: int = 3) -> dict[str, DataFrame]:
    """Master panel -> raw and model-ready features, checks, registry."""
    master, annual = read_table(spark, processed, "master_panel").drop("year"), read_table(spark, interim, "compustat_fundamentals_annual")
    write_table(panel.finite_columns(features.raw_features(master, annual), list(features.NAMES)), processed, "features_raw", "MthCalDt")
    raw = read_table(spark, processed, "features_raw").drop("year")
    write_table(model_ready(raw, list(features.KEYS), list(features.NAMES)), processed, "features_model_ready", "MthCalDt")
    found = feature_checks(raw, master, annual, entities, months, read_table(spark, processed, "features_model_ready").drop("year"))
    write_result(found, reports, "feature_checks")
    write_result(features.registry_table(spark), reports, "registry")
    write_result(features.registry_table(spark), reports, "registry", "json")
    return {"checks": found, "registry": features.registry_table(spark)}


def append_months(spark: SparkSession, interim: str, processed: str, since: dt.date) -> int:
    """Interim tables with new months from `since` on -> the years of master panel and features that they touch; gives the first of these.

    A security's last row before the new months is no longer its last one, so its year is made again too; all earlier years stay as they
    are. Features are built from those years and the rows before them that the windows reach: WINDOW_ROWS rows of a security, from the
    months just before, and from further back only for securities with gaps.
    """
    tables = read_interim(spark, interim)
    monthly = tables["crsp_monthly_stock"]
    renewed = monthly.where(F.col("MthCalDt") >= F.lit(since)).select("PERMNO").distinct()
    last = monthly.where(F.col("MthCalDt") < F.lit(since)).join(renewed, "PERMNO", "left_semi").groupBy("PERMNO").agg(F.max("MthCalDt").alias("last")).agg(F.min("last")).first()[0]
    year = min(since.year, last.year if last else since.year)
    made = panel.master_panel(tables | {"crsp_monthly_stock": monthly.where(F.col("MthCalDt") >= F.lit(dt.date(year, 1, 1)))})
    overwrite_years(made, processed, "master_panel", "MthCalDt")

    master, start = read_table(spark, processed, "master_panel"), dt.date(year, 1, 1)
    near = dt.date(year - 1 - WINDOW_ROWS // 12, 1, 1)
    rows = master.where(F.col("year") >= near.year)
    short = rows.groupBy("PERMNO").agg(F.count_if(F.col("MthCalDt") < F.lit(start)).alias("n")).where(f"n < {WINDOW_ROWS}").select("PERMNO")
    rows = rows.unionByName(master.where(F.col("year") < near.year).join(short, "PERMNO", "left_semi")).drop("year")
    raw = features.raw_features(rows, tables["compustat_fundamentals_annual"]).where(F.col("MthCalDt") >= F.lit(start))
    overwrite_years(panel.finite_columns(raw, list(features.NAMES)), processed, "features_raw", "MthCalDt")
    raw = read_table(spark, processed, "features_raw").where(F.col("year") >= year).drop("year")
    overwrite_years(model_ready(raw, list(features.KEYS), list(features.NAMES)), processed, "features_model_ready", "MthCalDt")
    return year


def feature_checks(raw: DataFrame, master: DataFrame, annual: DataFrame, entities: int = 40, months: int = 3, model_ready_rows: DataFrame | None = None) -> DataFrame:
    """All table checks. The behavioural ones rebuild a sample of securities, as rebuilding all would cost as much as the job. model_ready_rows: raw's, if they are there already."""
    names = list(features.NAMES)
    some = master.join(F.broadcast(checks.sampled_entities(master, entities)), "PERMNO", "left_semi")
    dates = checks.sampled_dates(master, months)
    # Size relative to the month's median is rebuilt over the same sample in full and in part.
    build = lambda p: features.raw_features(p, annual)
    ready = features.prepared(master, annual)
    over = {f.category for f in features.REGISTRY if f.name in checks.DENOMINATORS}
    plain = features.raw_features(master, annual, tuple(f for f in features.FAMILIES if f in over), more=tuple(sorted(set(checks.DENOMINATORS.values()))))
    scaled = lambda d: model_ready(d, list(features.KEYS), names)
    there = {} if model_ready_rows is None else {"whole": model_ready_rows}
    return checks.union(
        [
            checks.no_duplicate_keys(raw, ["PERMNO", "MthCalDt"]), checks.no_calendar_gaps(raw), checks.no_infinite_values(raw, names), checks.sources_exist(ready),
            checks.return_bounds(raw), checks.denominators(plain), checks.no_leakage(build, some, dates, names), checks.reproducible(build, some, names), checks.isolated(scaled, raw, dates, names, **there),
        ]
    )


def run_models(spark: SparkSession, processed: str, reports: str, names: list[str] | None = None, config: targets.ModelConfig | None = None, models: dict[str, Runner] | None = None) -> dict[str, DataFrame]:
    """Features -> targets, folds, predictions, checks and ICs. Of the features only those that models read are joined with targets."""
    c = config or targets.ModelConfig()
    names = names or list(features.MODEL_NAMES)
    ready, master = read_table(spark, processed, "features_model_ready").drop("year", "ret_adj"), read_table(spark, processed, "master_panel").drop("year")
    ready = ready.select(*(k for k in features.KEYS if k != "ret_adj"), *dict.fromkeys([*names, c.momentum]))
    table = targets.training_panel(ready, panel.investable(master), c.horizon).where("is_investable").cache()
    folds = targets.walk_forward_folds(targets.months_of(table), c)
    got = walk_forward(table, names, "target_demeaned", folds, models or runners(), c)
    write_table(got, reports, "predictions")
    predictions, fold_table = read_table(spark, reports, "predictions"), targets.folds_table(spark, folds)
    series = ic.monthly_ic(predictions)
    out = {"folds": fold_table, "ic_series": series, "ic_summary": ic.ic_summary(series), "model_checks": checks.model_checks(predictions, fold_table, c.horizon)}
    for name, df in out.items():
        write_result(df, reports, name)
    table.unpersist()
    return out


def run_backtest(spark: SparkSession, processed: str, reports: str, horizon: int = 1, deciles: int = 10, bps: float = 10.0) -> dict[str, DataFrame]:
    """Predictions -> holdings, returns, performance, sensitivity, factor regression."""
    master = read_table(spark, processed, "master_panel").drop("year")
    realized = portfolio.realized_returns(targets.targets(panel.investable(master), horizon))
    held = portfolio.weights(read_table(spark, reports, "predictions"), deciles)
    returns = portfolio.portfolio_returns(held.cache(), realized, bps).cache()
    factors = portfolio.factor_months(master, list(performance.FACTORS))
    out = {"portfolio_returns": returns, "performance": performance.performance(returns), "cost_sensitivity": performance.cost_sensitivity(returns), "factor_regression": performance.factor_regression(returns, factors)}
    for name, df in out.items():
        write_result(df, reports, name)
    returns.unpersist()
    held.unpersist()
    return out

"""Table and fold checks; each gives one row: check_name, passed, affected, detail."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelforge.functions.columns import differs, month_number
from panelforge.functions.counts import infinite
from panelforge.operators.features import REGISTRY

#: Features that are returns and can't lie below -1.
RETURN_FEATURES = ("mom_1m", "mom_3m", "mom_6m", "mom_9m", "mom_12m", "mom_12_1", "mom_6_1", "reversal_1m", "max_ret_12m", "min_ret_12m")
#: Features and the denominators that must be positive where they have a value.
DENOMINATORS = {
    "quality_roe": "cst_seq", "quality_roa": "at_proxy", "quality_gross_profitability": "at_proxy", "quality_net_profit_margin": "cst_revt", "quality_gross_margin": "cst_revt",
    "quality_asset_turnover": "at_proxy", "quality_cf_profitability": "at_proxy", "quality_cf_margin": "cst_revt", "quality_accruals": "at_proxy", "leverage_debt_to_assets": "at_proxy",
    "leverage_debt_to_equity": "cst_seq", "leverage_lt_debt_ratio": "at_proxy", "leverage_current_ratio": "cst_lct", "leverage_cash_ratio": "cst_lct",
    "leverage_net_debt_to_assets": "at_proxy", "leverage_interest_coverage": "cst_xint", "liquidity_share_turnover": "ShrOut",
}


def result(counts: DataFrame, name: str, detail: str) -> DataFrame:
    """counts (affected), one row -> the check's row; it passes without affected rows."""
    n = F.coalesce("affected", F.lit(0)).cast("long")
    return counts.select(F.lit(name).alias("check_name"), (n == 0).alias("passed"), n.alias("affected"), F.lit(detail).alias("detail"))


def union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def no_duplicate_keys(df: DataFrame, keys: list[str], name: str = "no_duplicate_permno_month_keys") -> DataFrame:
    rows = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    return result(rows.agg(F.sum(F.col("n") - 1).alias("affected")), name, "rows beyond the first of their key")


def no_calendar_gaps(df: DataFrame) -> DataFrame:
    month = month_number("MthCalDt")
    gap = month - F.lag(month).over(Window.partitionBy("PERMNO").orderBy("MthCalDt")) > 1
    return result(df.select(gap.alias("gap")).agg(F.count_if("gap").alias("affected")), "no_calendar_gaps", "months that follow more than one month after the security's last")


def no_infinite_values(df: DataFrame, columns: list[str]) -> DataFrame:
    return result(infinite(df, columns), "no_infinite_values", "infinite values")


def sources_exist(df: DataFrame) -> DataFrame:
    missing = sorted({c for f in REGISTRY for c in f.sources} - set(df.columns))
    return result(df.sparkSession.createDataFrame([(len(missing),)], "affected long"), "registry_source_columns_exist", f"missing: {', '.join(missing) or 'none'}")


def return_bounds(df: DataFrame) -> DataFrame:
    return result(df.agg(sum((F.count_if(F.col(c) < -1) for c in RETURN_FEATURES if c in df.columns), F.lit(0)).alias("affected")), "return_based_features_above_negative_100pct", "returns below -100%")


def denominators(df: DataFrame) -> DataFrame:
    """df has the features and their denominators."""
    bad = [F.count_if(F.col(f).isNotNull() & (F.col(d).isNull() | (F.col(d) <= 0))) for f, d in DENOMINATORS.items() if f in df.columns and d in df.columns]
    return result(df.agg(sum(bad, F.lit(0)).alias("affected")), "denominator_handling", "values over a denominator that is not positive")


def mismatches(a: DataFrame, b: DataFrame, keys: list[str], columns: list[str], tol: float) -> DataFrame:
    """One row: affected, the rows of a and b, matched by keys from both sides, that differ in presence or value."""
    x = a.select(*keys, F.struct(*columns).alias("x"))
    y = b.select(*keys, F.struct(*columns).alias("y"))
    both = x.join(y, keys, "full")
    off: Column = F.col("x").isNull() | F.col("y").isNull()
    for c in columns:
        off = off | differs(F.col("x")[c].cast("double"), F.col("y")[c].cast("double"), tol)
    return both.agg(F.count_if(off).alias("affected"))


def sampled_entities(df: DataFrame, n: int = 40) -> DataFrame:
    """n securities, the first by a hash of their id, the same in every run."""
    return df.select("PERMNO").distinct().orderBy(F.xxhash64("PERMNO"), "PERMNO").limit(n)


def sampled_dates(df: DataFrame, n: int = 3) -> list:
    """n of the distinct months, evenly spaced inside the range. There are as many months as the calendar has."""
    months = [r[0] for r in df.select("MthCalDt").distinct().orderBy("MthCalDt").collect()]
    return [months[len(months) * (i + 1) // (n + 1)] for i in range(min(n, len(months)))]


def no_leakage(build: Callable[[DataFrame], DataFrame], panel: DataFrame, cutoffs: list, columns: list[str], tol: float = 1e-8) -> DataFrame:
    """build over all rows and over the rows up to a cutoff must agree in the cutoff's month. All cutoffs meet one full build."""
    at = lambda df, dates: df.where(F.col("MthCalDt").isin(dates))
    cut = union([at(build(panel.where(F.col("MthCalDt") <= F.lit(d))), [d]) for d in cutoffs])
    return result(mismatches(at(build(panel), cutoffs), cut, ["PERMNO", "MthCalDt"], columns, tol), "no_leakage_via_truncation", f"rows that change without later months, at {len(cutoffs)} cutoffs")


def reproducible(build: Callable[[DataFrame], DataFrame], panel: DataFrame, columns: list[str], tol: float = 1e-9) -> DataFrame:
    return result(mismatches(build(panel), build(panel), ["PERMNO", "MthCalDt"], columns, tol), "reproducibility", "rows that differ between two builds")


def isolated(transform: Callable[[DataFrame], DataFrame], df: DataFrame, months: list, columns: list[str], tol: float = 1e-9, whole: DataFrame | None = None) -> DataFrame:
    """A cross-sectional transform of one month alone must equal that month in the whole, which may be there already."""
    at = lambda rows, dates: rows.where(F.col("MthCalDt").isin(dates))
    alone = union([transform(at(df, [d])) for d in months])
    return result(mismatches(at(transform(df) if whole is None else whole, months), alone, ["PERMNO", "MthCalDt"], columns, tol), "cross_sectional_isolation", f"rows that depend on other months, in {len(months)} months")


#: Securities and firms of variant v have the ids id * VARIANTS + v in stacked tables.
VARIANTS = 16
_DATED = {"crsp_monthly_stock": "MthCalDt", "compustat_fundamentals_annual": "datadate", "ccm_link_table": "LINKDT", "crsp_delisting": "DelistingDt"}
_IDS = {"crsp_monthly_stock": ["PERMNO"], "compustat_fundamentals_annual": ["GVKEY"], "ccm_link_table": ["LPERMNO", "gvkey"], "crsp_delisting": ["PERMNO", "DelPERMNO"]}


def stacked(tables: dict[str, DataFrame], cutoffs: list) -> dict[str, DataFrame]:
    """The raw tables with a copy of their rows for each variant: 0 and 1 whole, 2, 3, ... without what comes after one of the cutoffs.

    Ids carry the variant, so one build makes all variants beside each other: what it joins by id or looks up along a security stays
    inside a variant. Only tables by month alone (factors) are shared.
    """
    if len(cutoffs) + 2 > VARIANTS:
        raise ValueError(f"{VARIANTS - 2} cutoffs at most")
    ends = F.array(*[F.lit(None).cast("date")] * 2, *(F.lit(c).cast("date") for c in cutoffs))
    out = dict(tables)
    for name, date in _DATED.items():
        df = tables[name].withColumn("__v", F.explode(F.sequence(F.lit(0), F.lit(len(cutoffs) + 1))))
        df = df.where(F.get(ends, F.col("__v")).isNull() | (F.col(date) <= F.get(ends, F.col("__v"))))
        out[name] = df.withColumns({c: F.col(c) * VARIANTS + F.col("__v") for c in _IDS[name] if c in df.columns}).drop("__v")
    return out


def variant_checks(built: DataFrame, cutoffs: list, columns: list[str], tol: float = 1e-8) -> DataFrame:
    """No look-ahead and reproducibility of a build over stacked tables: each cut variant must agree with the whole in its cutoff's month, the two whole ones everywhere."""
    rows = built.withColumns({"__v": (F.col("PERMNO") % VARIANTS).cast("int"), "PERMNO": F.floor(F.col("PERMNO") / VARIANTS)})
    of = lambda cond: rows.where(cond).drop("__v")
    last = F.get(F.array(*[F.lit(None).cast("date")] * 2, *(F.lit(c).cast("date") for c in cutoffs)), F.col("__v"))
    keys = ["PERMNO", "MthCalDt"]
    leak = mismatches(of((F.col("__v") == 0) & F.col("MthCalDt").isin(cutoffs)), of(F.col("MthCalDt") == last), keys, columns, tol)
    again = mismatches(of("__v = 0"), of("__v = 1"), keys, columns, tol)
    return union([
        result(leak, "no_leakage_via_truncation", f"rows that change without later months, at {len(cutoffs)} cutoffs"), result(again, "reproducibility", "rows that differ between two builds"),
    ])


def fold_gap(folds: DataFrame, horizon: int) -> DataFrame:
    gap = month_number("test_start") - month_number("train_end")
    return result(folds.agg(F.count_if(gap <= horizon).alias("affected")), "fold_purge_embargo", f"folds whose gap is not above {horizon} months")


def folds_expand(folds: DataFrame) -> DataFrame:
    """Same start, strictly later end. A table of folds has few rows."""
    w = Window.orderBy("fold_id")
    bad = (F.col("train_start") != F.lag("train_start").over(w)) | (F.col("train_end") <= F.lag("train_end").over(w))
    return result(folds.select(F.coalesce(bad, F.lit(False)).alias("bad")).agg(F.count_if("bad").alias("affected")), "folds_expanding", "folds that do not grow from one start")


def no_duplicate_predictions(predictions: DataFrame) -> DataFrame:
    return no_duplicate_keys(predictions, ["PERMNO", "MthCalDt", "model"], "no_duplicate_predictions")


def predictions_in_window(predictions: DataFrame, folds: DataFrame) -> DataFrame:
    """Rows of an unknown fold count as outside."""
    rows = predictions.join(F.broadcast(folds.select("fold_id", "test_start", "test_end")), "fold_id", "left")
    inside = F.coalesce(F.col("MthCalDt").between(F.col("test_start"), F.col("test_end")), F.lit(False))
    return result(rows.agg(F.count_if(~inside).alias("affected")), "predictions_within_fold_test_window", "predictions outside their fold's test months")


def model_checks(predictions: DataFrame, folds: DataFrame, horizon: int = 1) -> DataFrame:
    return union([fold_gap(folds, horizon), folds_expand(folds), no_duplicate_predictions(predictions), predictions_in_window(predictions, folds)])

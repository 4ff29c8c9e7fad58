"""From tables to a panel: delisting returns, the master panel, units, derived accounting, growth, the universe."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelforge.functions.columns import finite, zero
from panelforge.operators.asof import attach_annual, attach_factors, link_entities, unmatched
from panelforge.operators.cleaning import resolve_duplicate_keys

#: Annual items that are no facts to attach.
NOT_VALUES = ("GVKEY", "datadate", "indfmt", "consol", "popsrc", "datafmt", "curcd")
#: Items whose growth over fiscal years is taken: item -> name of the feature.
GROWTH_ITEMS = {"at_proxy": "asset", "revt": "sales", "capx": "capx", "invt": "inventory", "rect": "receivables", "ppent": "ppent", "seq": "equity"}
#: Rows of a task while the panel is made (each takes some 4 KB in the sorts of its columns), and so few that another task does not pay.
TASK_ROWS = 100_000
LEAST_ROWS = 2_000


def delisting_returns(panel: DataFrame, delisting: DataFrame) -> DataFrame:
    """panel with is_last_obs, is_delisted, delisting_return_missing, DelRet and ret_adj.

    The last month's return is compounded with the delisting return, a missing month's return counting as 0. Delisting rows must be
    unique by PERMNO: a further one raises at run time.
    """
    events = delisting.groupBy("PERMNO").agg(F.count(F.lit(1)).alias("__n"), F.first("DelRet").alias("DelRet"))
    events = events.withColumn("__n", F.when(F.col("__n") > 1, F.raise_error("delisting rows must be unique by PERMNO")).otherwise(F.col("__n")))
    out = panel.join(events, "PERMNO", "left")
    last = F.col("MthCalDt") == F.max("MthCalDt").over(Window.partitionBy("PERMNO"))
    out = out.withColumn("is_last_obs", last).withColumn("is_delisted", F.col("is_last_obs") & F.col("__n").isNotNull())
    out = out.withColumn("delisting_return_missing", F.col("is_delisted") & F.col("DelRet").isNull())
    adjusted = (1 + F.coalesce("MthRet", F.lit(0.0))) * (1 + F.col("DelRet")) - 1
    return out.withColumn("ret_adj", F.when(F.col("is_delisted") & F.col("DelRet").isNotNull(), adjusted).otherwise(F.col("MthRet"))).drop("__n")


def by_security(panel: DataFrame) -> DataFrame:
    """panel dealt by security, over a task for each TASK_ROWS rows. The number is explicit: of narrow rows Spark would put so many together that they no longer fit a task when they are wide."""
    rows, cores = panel.count(), panel.sparkSession.sparkContext.defaultParallelism
    return panel.repartition(max(-(-rows // TASK_ROWS), min(cores, rows // LEAST_ROWS), 1), "PERMNO")


def value_columns(annual: DataFrame) -> list[str]:
    return [c for c in annual.columns if c not in NOT_VALUES]


def master_panel(t: dict[str, DataFrame]) -> DataFrame:
    """One row per (PERMNO, MthCalDt): duplicates resolved, then delisting, link, fundamentals and factors attached by left joins; no row is lost.

    Rows are dealt by security once, while they are narrow: duplicates, delistings and links need no other order.
    """
    annual = t["compustat_fundamentals_annual"]
    panel = resolve_duplicate_keys(by_security(t["crsp_monthly_stock"]), ["PERMNO", "MthCalDt"])
    panel = delisting_returns(panel, t["crsp_delisting"])
    panel = attach_annual(link_entities(panel, t["ccm_link_table"], None), annual, value_columns(annual))
    return attach_factors(panel, t["fama_french_5f_momentum_monthly"])


def _values(panel: DataFrame) -> list[str]:
    return [c for c in panel.columns if c.startswith("cst_") and c not in ("cst_available_date", "cst_age_months", "cst_expired")]


def merge_diagnostics(panel: DataFrame) -> DataFrame:
    """One row of counts and shares: rows, keys, duplicates, linked, usable and expired fundamentals, factors, delistings; null share of each annual value."""
    usable = F.coalesce(*(F.when(F.col(c).isNotNull(), 1) for c in _values(panel))).isNotNull()
    pct = lambda flag: F.round(100 * F.avg(F.coalesce(flag, F.lit(False)).cast("int")), 4)
    rows = panel.groupBy("PERMNO", "MthCalDt").agg(F.count(F.lit(1)).alias("__n"))
    keys = rows.agg(F.count(F.lit(1)).alias("unique_keys"), F.count_if(F.col("__n") > 1).alias("duplicate_keys"))
    one = panel.agg(
        F.count(F.lit(1)).alias("rows"), pct(F.col("gvkey").isNotNull()).alias("pct_gvkey"), pct(usable).alias("pct_usable"), pct(F.col("cst_expired")).alias("pct_expired"),
        pct(F.col("ff_mktrf").isNotNull()).alias("pct_factor"), F.count_if("is_delisted").alias("delisted"), F.count_if("delisting_return_missing").alias("delisting_return_missing"),
        *(pct(F.col(c).isNull()).alias(f"null_{c}") for c in _values(panel)),
    )
    return one.crossJoin(keys)  # two rows of aggregates


def firm_coverage(panel: DataFrame) -> DataFrame:
    """Per year: distinct firms, those with a gvkey, those with fundamentals that are live."""
    live = F.col("cst_available_date").isNotNull() & ~F.col("cst_expired")
    firm = panel.select(F.year("MthCalDt").alias("year"), "PERMNO", F.col("gvkey").isNotNull().alias("g"), live.alias("f")).groupBy("year", "PERMNO").agg(F.max("g").alias("g"), F.max("f").alias("f"))
    return firm.groupBy("year").agg(F.count(F.lit(1)).alias("firms"), F.count_if("g").alias("with_gvkey"), F.count_if("f").alias("with_fundamentals"))


def normalized_units(panel: DataFrame) -> DataFrame:
    """Adds mktcap_millions (from thousands), dollar_volume_millions, shares_outstanding_actual (from thousands)."""
    return panel.withColumns({"mktcap_millions": F.col("MthCap") / 1000, "dollar_volume_millions": F.col("MthPrc") * F.col("MthVol") / 1e6, "shares_outstanding_actual": F.col("ShrOut") * 1000})


def derived_accounting(panel: DataFrame) -> DataFrame:
    """Adds at_proxy, book_equity, total_debt, enterprise_value, net_debt; preferred stock and deferred taxes count as 0 where missing."""
    out = panel.withColumns({"at_proxy": F.col("cst_lt") + F.col("cst_seq"), "book_equity": F.col("cst_seq") - zero("cst_pstk") + zero("cst_txditc"), "total_debt": F.col("cst_dlc") + F.col("cst_dltt")})
    return out.withColumns({"enterprise_value": F.col("mktcap_millions") + F.col("total_debt") + zero("cst_pstk") - F.col("cst_che"), "net_debt": F.col("total_debt") - F.col("cst_che")})


def growth_table(annual: DataFrame, positive: bool = True) -> DataFrame:
    """(GVKEY, datadate, <item>_growth ...): change from the previous fiscal row over its size; null unless the previous value is positive (or not 0)."""
    items = annual.withColumn("at_proxy", F.col("lt") + F.col("seq")).select("GVKEY", "datadate", *GROWTH_ITEMS)
    w = Window.partitionBy("GVKEY").orderBy("datadate")
    with_previous = items.select("*", *(F.lag(c).over(w).alias(f"__{c}") for c in GROWTH_ITEMS))
    growth = lambda c: (F.col(c) - F.col(f"__{c}")) / F.when(F.col(f"__{c}") > 0 if positive else F.col(f"__{c}") != 0, F.abs(f"__{c}"))
    return with_previous.select("GVKEY", "datadate", *(growth(c).alias(f"{c}_growth") for c in GROWTH_ITEMS))


def attach_growth(panel: DataFrame, annual: DataFrame, lag_months: int = 6) -> DataFrame:
    """panel with cst_<item>_growth of the fiscal row that its levels come from, under the same lag and shelf life.

    The as-of join that brought the levels has left that row's date of availability, so growth comes by an equi join; of rows with
    one such date the latest counts, as there. Rows without gvkey meet nothing, each under a number of its own.
    """
    names = [f"{c}_growth" for c in GROWTH_ITEMS]
    growth = growth_table(annual).where("GVKEY is not null and datadate is not null").groupBy(F.col("GVKEY").alias("__key"), F.add_months("datadate", lag_months).alias("__from"), F.lit(0).cast("long").alias("__all"))
    growth = growth.agg(F.max_by(F.struct(*names), "datadate").alias("__growth"))
    linked = F.col("gvkey").isNotNull() & F.col("cst_available_date").isNotNull()
    keyed = panel.withColumn("__own", F.when(linked, F.lit(0).cast("long")).otherwise(unmatched(panel)))
    keyed = keyed.join(growth, (F.col("gvkey") == F.col("__key")) & (F.col("cst_available_date") == F.col("__from")) & (F.col("__own") == F.col("__all")), "left")
    return keyed.withColumns({f"cst_{c}": F.when(~F.col("cst_expired"), F.col(f"__growth.{c}")) for c in names}).drop("__key", "__from", "__growth", "__own", "__all")


def fundamentals_flag(panel: DataFrame) -> DataFrame:
    return panel.withColumn("has_fundamentals", F.col("cst_available_date").isNotNull() & ~F.coalesce("cst_expired", F.lit(False)))


def investable(panel: DataFrame, least_price: float = 1.0, without_financials: bool = False) -> DataFrame:
    """Adds is_investable: price and cap, traded in the month, optionally no financials (SIC 6000-6999). Unknown is false."""
    ok = (F.col("MthPrc") >= least_price) & (F.col("MthCap") > 0) & (F.col("MthRetFlg") != "NT")
    if without_financials:
        ok = ok & ~F.coalesce(F.col("SICCD").between(6000, 6999), F.lit(False))
    return panel.withColumn("is_investable", F.coalesce(ok, F.lit(False)))


def finite_columns(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.withColumns({c: finite(c) for c in columns})



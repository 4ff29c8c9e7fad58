"""The 51 features: registry and formulas. Rolling features share one sort by (PERMNO, MthCalDt) and are computed over batches of its rows."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from panelforge.functions.columns import divide, enough, positive, zero
from panelforge.operators.panel import GROWTH_ITEMS, attach_growth, derived_accounting, fundamentals_flag, investable, normalized_units


@dataclass(frozen=True)
class Feature:
    """name, category, the columns it is made of, its window in months (0: none), observations it needs, its twin if it repeats another feature."""

    name: str
    category: str
    sources: tuple[str, ...]
    window: int = 0
    least: int = 1
    twin: str | None = None


#: The features and the columns that they are made of, in the order of the feature tables.
REGISTRY: tuple[Feature, ...] = (
    Feature("size_mktcap", "size", ("MthCap",)),
    Feature("size_log_mktcap", "size", ("MthCap",)),
    Feature("size_relative_mktcap", "size", ("MthCap", "is_investable", "MthCalDt")),
    Feature("value_bm", "value", ("cst_seq", "cst_pstk", "cst_txditc", "MthCap")),
    Feature("value_earnings_yield", "value", ("cst_ni", "MthCap")),
    Feature("value_cf_yield", "value", ("cst_oancf", "MthCap")),
    Feature("value_sales_to_price", "value", ("cst_revt", "MthCap")),
    Feature("value_ebitda_to_ev", "value", ("cst_ebitda", "MthCap", "cst_dlc", "cst_dltt", "cst_pstk", "cst_che")),
    Feature("value_cf_to_ev", "value", ("cst_oancf", "MthCap", "cst_dlc", "cst_dltt", "cst_pstk", "cst_che")),
    Feature("mom_1m", "momentum", ("ret_adj",)),
    Feature("mom_3m", "momentum", ("ret_adj", "PERMNO"), 3, 3),
    Feature("mom_6m", "momentum", ("ret_adj", "PERMNO"), 6, 6),
    Feature("mom_9m", "momentum", ("ret_adj", "PERMNO"), 9, 9),
    Feature("mom_12m", "momentum", ("ret_adj", "PERMNO"), 12, 12),
    Feature("mom_12_1", "momentum", ("ret_adj", "PERMNO"), 12, 12),
    Feature("mom_6_1", "momentum", ("ret_adj", "PERMNO"), 6, 6),
    Feature("reversal_1m", "reversal", ("ret_adj",), twin="mom_1m"),
    Feature("quality_roe", "quality", ("cst_ni", "cst_seq")),
    Feature("quality_roa", "quality", ("cst_ni", "cst_lt", "cst_seq")),
    Feature("quality_gross_profitability", "quality", ("cst_gp", "cst_lt", "cst_seq")),
    Feature("quality_operating_profitability", "quality", ("cst_revt", "cst_cogs", "cst_xsga", "cst_xint", "cst_seq", "cst_pstk", "cst_txditc")),
    Feature("quality_net_profit_margin", "quality", ("cst_ni", "cst_revt")),
    Feature("quality_gross_margin", "quality", ("cst_gp", "cst_revt")),
    Feature("quality_asset_turnover", "quality", ("cst_revt", "cst_lt", "cst_seq")),
    Feature("quality_cf_profitability", "quality", ("cst_oancf", "cst_lt", "cst_seq")),
    Feature("quality_cf_margin", "quality", ("cst_oancf", "cst_revt")),
    Feature("quality_accruals", "quality", ("cst_ni", "cst_oancf", "cst_lt", "cst_seq")),
    Feature("growth_asset", "growth", ("cst_at_proxy_growth",), least=2),
    Feature("growth_sales", "growth", ("cst_revt_growth",), least=2),
    Feature("growth_capx", "growth", ("cst_capx_growth",), least=2),
    Feature("growth_inventory", "growth", ("cst_invt_growth",), least=2),
    Feature("growth_receivables", "growth", ("cst_rect_growth",), least=2),
    Feature("growth_ppent", "growth", ("cst_ppent_growth",), least=2),
    Feature("growth_equity", "growth", ("cst_seq_growth",), least=2),
    Feature("leverage_debt_to_assets", "leverage", ("cst_dlc", "cst_dltt", "cst_lt", "cst_seq")),
    Feature("leverage_debt_to_equity", "leverage", ("cst_dlc", "cst_dltt", "cst_seq")),
    Feature("leverage_lt_debt_ratio", "leverage", ("cst_dltt", "cst_lt", "cst_seq")),
    Feature("leverage_current_ratio", "leverage", ("cst_act", "cst_lct")),
    Feature("leverage_cash_ratio", "leverage", ("cst_che", "cst_lct")),
    Feature("leverage_net_debt_to_assets", "leverage", ("cst_dlc", "cst_dltt", "cst_che", "cst_lt", "cst_seq")),
    Feature("leverage_interest_coverage", "leverage", ("cst_ebit", "cst_xint")),
    Feature("liquidity_dollar_volume", "liquidity", ("MthPrc", "MthVol")),
    Feature("liquidity_share_turnover", "liquidity", ("MthVol", "ShrOut")),
    Feature("liquidity_amihud_illiq", "liquidity", ("ret_adj", "MthPrc", "MthVol")),
    Feature("vol_12m", "volatility", ("ret_adj", "PERMNO"), 12, 6),
    Feature("downside_vol_12m", "volatility", ("ret_adj", "PERMNO"), 12, 6),
    Feature("beta_24m", "volatility", ("ret_adj", "ff_mktrf", "ff_rf", "PERMNO"), 24, 12),
    Feature("idio_vol_24m", "volatility", ("ret_adj", "ff_mktrf", "ff_rf", "PERMNO"), 24, 12),
    Feature("max_ret_12m", "volatility", ("ret_adj", "PERMNO"), 12, 6),
    Feature("min_ret_12m", "volatility", ("ret_adj", "PERMNO"), 12, 6),
    Feature("skew_36m", "volatility", ("ret_adj", "PERMNO"), 36, 24),
)

NAMES = tuple(f.name for f in REGISTRY)
#: For models: without features that repeat another.
MODEL_NAMES = tuple(f.name for f in REGISTRY if not f.twin)
#: The column that with_middle adds.
MIDDLE = "__middle_mktcap"
KEYS = ("PERMNO", "MthCalDt", "gvkey", "is_investable", "has_fundamentals", "ret_adj")


def registry_table(spark: SparkSession) -> DataFrame:
    """(position, name, category, sources, window, least, twin, for_models)."""
    rows = [(i, f.name, f.category, ",".join(f.sources), f.window, f.least, f.twin, f.twin is None) for i, f in enumerate(REGISTRY)]
    return spark.createDataFrame(rows, "position int, name string, category string, sources string, window int, least int, twin string, for_models boolean")


def collinear_pairs(spark: SparkSession) -> DataFrame:
    """(a, b): pairs of features that are the same or each other's negative; models leave out b."""
    return spark.createDataFrame([(f.twin, f.name) for f in REGISTRY if f.twin], "a string, b string")


def names_by_category(spark: SparkSession) -> DataFrame:
    """(category, n, names): names in registry order, comma-joined."""
    rows = registry_table(spark).groupBy("category").agg(F.count(F.lit(1)).alias("n"), F.array_sort(F.collect_list(F.struct("position", "name"))).alias("p"))
    return rows.select("category", "n", F.array_join(F.transform("p", lambda x: x["name"]), ",").alias("names"))


def size_features() -> dict[str, Column]:
    cap = positive("mktcap_millions")
    middle = F.col(MIDDLE)
    return {"size_mktcap": cap, "size_log_mktcap": F.ln(cap), "size_relative_mktcap": cap / F.when(middle != 0, middle)}


def with_middle(ready: DataFrame) -> DataFrame:
    """ready with MIDDLE, the month's median cap over the universe. Months order two columns alone, and a row per month comes back."""
    rows = ready.where(F.col("is_investable") & (F.col("mktcap_millions") > 0)).select(F.col("MthCalDt").alias("__month"), F.col("mktcap_millions").alias("v"))
    month = Window.partitionBy("__month")
    rows = rows.select("__month", "v", F.row_number().over(month.orderBy("v")).alias("i"), F.count(F.lit(1)).over(month).alias("n"))
    middle = rows.where(F.col("i").between(F.floor((F.col("n") + 1) / 2), F.floor((F.col("n") + 2) / 2))).groupBy("__month").agg(F.avg("v").alias(MIDDLE))
    return ready.join(F.broadcast(middle), F.col("MthCalDt").eqNullSafe(F.col("__month")), "left").drop("__month")


def value_features() -> dict[str, Column]:
    cap, ev = "mktcap_millions", "enterprise_value"
    return {
        "value_bm": divide(positive("book_equity"), cap), "value_earnings_yield": divide("cst_ni", cap), "value_cf_yield": divide("cst_oancf", cap), "value_sales_to_price": divide("cst_revt", cap),
        "value_ebitda_to_ev": divide("cst_ebitda", ev), "value_cf_to_ev": divide("cst_oancf", ev),
    }


def momentum_features() -> dict[str, Column]:
    """The one-month returns; the compounded ones are rolling."""
    return {"mom_1m": F.col("ret_adj"), "reversal_1m": F.col("ret_adj")}


def quality_features() -> dict[str, Column]:
    operating = F.col("cst_revt") - zero("cst_cogs") - zero("cst_xsga") - zero("cst_xint")
    ratios = {
        "roe": ("cst_ni", "cst_seq"), "roa": ("cst_ni", "at_proxy"), "gross_profitability": ("cst_gp", "at_proxy"), "operating_profitability": (operating, "book_equity"),
        "net_profit_margin": ("cst_ni", "cst_revt"), "gross_margin": ("cst_gp", "cst_revt"), "asset_turnover": ("cst_revt", "at_proxy"), "cf_profitability": ("cst_oancf", "at_proxy"),
        "cf_margin": ("cst_oancf", "cst_revt"), "accruals": (F.col("cst_ni") - F.col("cst_oancf"), "at_proxy"),
    }
    return {f"quality_{k}": divide(a, b) for k, (a, b) in ratios.items()}


def growth_features() -> dict[str, Column]:
    return {f"growth_{label}": F.col(f"cst_{item}_growth") for item, label in GROWTH_ITEMS.items()}


def leverage_features() -> dict[str, Column]:
    ratios = {
        "debt_to_assets": ("total_debt", "at_proxy"), "debt_to_equity": ("total_debt", "cst_seq"), "lt_debt_ratio": ("cst_dltt", "at_proxy"), "current_ratio": ("cst_act", "cst_lct"),
        "cash_ratio": ("cst_che", "cst_lct"), "net_debt_to_assets": ("net_debt", "at_proxy"), "interest_coverage": ("cst_ebit", "cst_xint"),
    }
    return {f"leverage_{k}": divide(a, b) for k, (a, b) in ratios.items()}


def liquidity_features() -> dict[str, Column]:
    volume = F.col("dollar_volume_millions")
    return {"liquidity_dollar_volume": volume, "liquidity_share_turnover": divide("MthVol", "shares_outstanding_actual"), "liquidity_amihud_illiq": divide(F.abs("ret_adj"), volume)}


def compounded(ret: Column, n: int, skip: int = 0) -> Column:
    """Compounded return over n rows as a window, all of which are needed; a return of -100% or less has no logarithm and gives null."""
    first, last = (-n, -1) if skip else (-(n - 1), 0)
    w = Window.partitionBy("PERMNO").orderBy("MthCalDt").rowsBetween(first, last)
    log = F.log1p(ret)
    return enough(log, w, n, F.expm1(F.sum(log).over(w)))


def _lagged(x: np.ndarray, there: np.ndarray, position: np.ndarray, n: int, skip: int = 0) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For the last n rows of each row's security up to `skip` rows before it, oldest first: the values and where there are any. position: from 1 within a security."""
    for lag in range(n - 1 + skip, skip - 1, -1):
        value, mask = np.zeros(len(x)), np.zeros(len(x), bool)
        value[lag:], mask[lag:] = x[: max(0, len(x) - lag)], there[: max(0, len(x) - lag)]
        mask &= position > lag
        yield np.where(mask, value, 0.0), mask


def compounded_values(x: np.ndarray, there: np.ndarray, position: np.ndarray, n: int, skip: int = 0) -> np.ndarray:
    """Compounded return over n rows, all of which are needed; a return of -100% or less has no logarithm and gives NaN."""
    usable = there & ~(x <= -1)
    log = np.log1p(np.where(usable, x, 0.0))
    total, count = np.zeros(len(x)), np.zeros(len(x))
    for value, mask in _lagged(log, usable, position, n, skip):
        total += value
        count += mask
    return np.where(count >= n, np.expm1(total), np.nan)


def rolling_moments(x: np.ndarray, there: np.ndarray, position: np.ndarray, n: int) -> tuple[np.ndarray, ...]:
    """Count, second and third central moment (sums), least and largest of the last n rows, taken up one row after another: equal values have moments of exactly 0."""
    count, mean, m2, m3 = (np.zeros(len(x)) for _ in range(4))
    low, high = np.full(len(x), np.inf), np.full(len(x), -np.inf)
    for value, mask in _lagged(x, there, position, n):
        count += mask
        delta = np.where(mask, value - mean, 0.0)
        step = delta / np.maximum(count, 1)
        mean += step
        m2 += delta * (delta - step)
        m3 += delta * (delta * delta - step * step) - 3 * step * m2
        low, high = np.where(mask, np.minimum(low, value), low), np.where(mask, np.maximum(high, value), high)
    return count, m2, m3, low, high


def beta(x: np.ndarray, has_x: np.ndarray, y: np.ndarray, has_y: np.ndarray, position: np.ndarray, months: int = 24, least: int = 12) -> tuple[np.ndarray, np.ndarray]:
    """Rolling beta and idiosyncratic volatility from five rolling means, each over its own rows with a value."""

    def mean(v: np.ndarray, there: np.ndarray) -> np.ndarray:
        total, count = np.zeros(len(v)), np.zeros(len(v))
        for value, mask in _lagged(v, there, position, months):
            total += value
            count += mask
        return np.where(count >= least, total / np.maximum(count, 1), np.nan)

    both = has_x & has_y
    mx, my, mxy, mxx, myy = mean(x, has_x), mean(y, has_y), mean(x * y, both), mean(x * x, has_x), mean(y * y, has_y)
    vx, vy = mxx - mx * mx, myy - my * my
    slope = (mxy - mx * my) / np.where(vx > 0, vx, np.nan)
    left = vy - slope * slope * vx
    return slope, np.sqrt(np.where(left < 0, 0.0, left))


def rolling_values(r: np.ndarray, has_r: np.ndarray, market: np.ndarray, has_market: np.ndarray, free: np.ndarray, has_free: np.ndarray, position: np.ndarray, families: tuple[str, ...]) -> dict[str, np.ndarray]:
    """The rolling features of rows in the order of securities and months; NaN where there are too few values."""
    out = {}
    if "momentum" in families:
        for name, n, skip in (("mom_3m", 3, 0), ("mom_6m", 6, 0), ("mom_9m", 9, 0), ("mom_12m", 12, 0), ("mom_12_1", 12, 1), ("mom_6_1", 6, 1)):
            out[name] = compounded_values(r, has_r, position, n, skip)
    if "volatility" in families:
        n, m2, _, low, high = rolling_moments(r, has_r, position, 12)
        out |= {"vol_12m": np.where(n >= 6, np.sqrt(m2 / np.maximum(n - 1, 1)), np.nan), "max_ret_12m": np.where(n >= 6, high, np.nan), "min_ret_12m": np.where(n >= 6, low, np.nan)}
        n, m2, *_ = rolling_moments(r, has_r & (r < 0), position, 12)
        out["downside_vol_12m"] = np.where(n >= 6, np.sqrt(m2 / np.maximum(n - 1, 1)), np.nan)
        out["beta_24m"], out["idio_vol_24m"] = beta(market, has_market, r - free, has_r & has_free, position)
        n, m2, m3, low, high = rolling_moments(r, has_r, position, 36)
        skew = np.sqrt(n) * m3 / np.sqrt(m2 * m2 * m2) * np.sqrt(n * (n - 1)) / (n - 2)
        out["skew_36m"] = np.where(n >= 24, np.where(low == high, 0.0, skew), np.nan)
    return out


#: Rolling features by family, and what they are made of.
ROLLING = {f: tuple(x.name for x in REGISTRY if x.window and x.category == f) for f in ("momentum", "volatility")}
_ROLLED_FROM = ("ret_adj", "ff_mktrf", "ff_rf")


#: A further step over the batches of a Python pass, and the schema of what it gives.
Step = tuple[Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], str]


def with_rolling(df: DataFrame, families: tuple[str, ...], then: Step | None = None) -> DataFrame:
    """df (PERMNO, MthCalDt and what the features are made of) with the rolling features of the families, or what `then` makes of it in the same pass.

    A window numbers each security's months, so a task has whole securities in order; it computes batch by batch and carries the rows
    that the longest window reaches back.
    """
    reach = max(f.window for f in REGISTRY) + 1
    names = [n for f in families for n in ROLLING[f]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before = None
        for b in batches:
            if not b.num_rows:
                continue
            some = [b.column(b.schema.get_field_index(c)) for c in (*_ROLLED_FROM, "__position")]
            now = [x for c in some[:3] for x in (c.fill_null(0.0).to_numpy(zero_copy_only=False), c.is_valid().to_numpy(zero_copy_only=False))] + [some[3].to_numpy()]
            rows = now if before is None else [np.concatenate(x) for x in zip(before, now, strict=True)]
            before = [x[-reach:] for x in rows]
            with np.errstate(all="ignore"):
                got = rolling_values(*rows, families)
            new = [pa.array(got[n][-b.num_rows :], pa.float64(), from_pandas=True) for n in names]
            kept = [(n, c) for n, c in zip(b.schema.names, b.columns, strict=True) if n != "__position"]
            yield pa.RecordBatch.from_arrays([*(c for _, c in kept), *new], names=[*(n for n, _ in kept), *names])

    made = df.withColumn("__position", F.row_number().over(Window.partitionBy("PERMNO").orderBy("MthCalDt")))
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields), *(f"`{n}` double" for n in names)])
    if then:
        step, kinds = then
        return made.mapInArrow(lambda batches: step(run(batches)), kinds)
    return made.mapInArrow(run, schema)


def volatility_features() -> dict[str, Column]:
    """All of them are rolling."""
    return {}


FAMILIES = {
    "size": size_features, "value": value_features, "momentum": momentum_features, "quality": quality_features,
    "growth": growth_features, "leverage": leverage_features, "liquidity": liquidity_features, "volatility": volatility_features,
}


def prepared(panel: DataFrame, annual: DataFrame) -> DataFrame:
    """The master panel with units, accounting, growth, flags: all that the formulas read."""
    return investable(fundamentals_flag(attach_growth(derived_accounting(normalized_units(panel)), annual)))


def raw_features(panel: DataFrame, annual: DataFrame, families: tuple[str, ...] = tuple(FAMILIES), more: tuple[str, ...] = (), then: Step | None = None) -> DataFrame:
    """KEYS and the features, every row kept; columns in registry order, then `more` columns of the prepared panel. With `then`, what that makes of them, without another way between Spark and Python."""
    ready = prepared(panel, annual)
    made = {k: v for f in families for k, v in FAMILIES[f]().items()}
    if "size" in families:
        ready = with_middle(ready)
    rolling = tuple(f for f in families if f in ROLLING)
    extra = [c for c in dict.fromkeys((*more, *(_ROLLED_FROM if rolling else ()))) if c not in KEYS]
    out = ready.select(*KEYS, *(v.alias(k) for k, v in made.items()), *extra)
    if rolling:
        out = with_rolling(out, rolling, then)
    if then:
        return out if rolling else out.mapInArrow(*then)
    return out.select(*KEYS, *(n for n in NAMES if n in out.columns), *(c for c in more if c not in KEYS))

"""Performance, cost sensitivity and factor regressions of return series."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

YEAR = 12
COST_BPS = (0.0, 5.0, 10.0, 20.0, 50.0)
FACTORS = ("ff_mktrf", "ff_smb", "ff_hml", "ff_rmw", "ff_cma", "ff_umd")


def _sharpe(x: str):
    sd = F.stddev_samp(x)
    return F.when(sd > 0, F.avg(x) / sd * F.sqrt(F.lit(float(YEAR))))


def performance(returns: DataFrame) -> DataFrame:
    """Per model and kind (gross, net): annualized return and volatility, Sharpe, Sortino, maximal drawdown, hit rate, periods.

    Drawdowns start at the first cumulative value; Sortino takes the spread of the negative returns alone, two at least.
    """
    rows = returns.unpivot(["MthCalDt", "model"], ["gross_return", "net_return"], "kind", "r").withColumn("kind", F.regexp_replace("kind", "_return$", ""))
    so_far = Window.partitionBy("model", "kind").orderBy("MthCalDt").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("__c", F.product(1 + F.col("r")).over(so_far))
    rows = rows.withColumn("__d", F.col("__c") / F.max("__c").over(so_far) - 1)
    loss = F.when(F.col("r") < 0, F.col("r"))
    sd = F.stddev_samp(loss)
    return rows.groupBy("model", "kind").agg(
        (F.avg("r") * YEAR).alias("annualized_return"), (F.stddev_samp("r") * F.sqrt(F.lit(float(YEAR)))).alias("annualized_vol"), _sharpe("r").alias("sharpe"),
        F.when((F.count(loss) >= 2) & (sd > 0), F.avg("r") / sd * F.sqrt(F.lit(float(YEAR)))).alias("sortino"), F.min("__d").alias("max_drawdown"),
        F.avg((F.col("r") > 0).cast("int")).alias("hit_rate"), F.count(F.lit(1)).alias("n_periods"),
    )


def cost_sensitivity(returns: DataFrame, bps: tuple[float, ...] = COST_BPS) -> DataFrame:
    """Per model and cost level: Sharpe and annualized return after costs."""
    levels = F.explode(F.array(*map(F.lit, bps))).alias("cost_bps")
    rows = returns.select("model", "gross_return", "turnover", levels)
    rows = rows.withColumn("r", F.col("gross_return") - F.coalesce("turnover", F.lit(0.0)) * F.col("cost_bps") / 10_000)
    return rows.groupBy("model", "cost_bps").agg(_sharpe("r").alias("sharpe"), (F.avg("r") * YEAR).alias("annualized_return"))


def newey_west(y: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """Least squares with a constant: coefficients, t statistics with Bartlett weights (no small-sample correction), R squared."""
    n = len(y)
    z = np.column_stack([np.ones(n), x])
    inverse = np.linalg.pinv(z.T @ z)
    beta = inverse @ z.T @ y
    e = y - z @ beta
    lags = max(1, round(4 * (n / 100) ** (2 / 9)))
    u = z * e[:, None]
    middle = u.T @ u
    for k in range(1, lags + 1):
        g = u[k:].T @ u[:-k]
        middle += (1 - k / (lags + 1)) * (g + g.T)
    sd = np.sqrt(np.diag(inverse @ middle @ inverse))
    with np.errstate(divide="ignore", invalid="ignore"):
        return beta, beta / sd, float(1 - e @ e / np.sum((y - y.mean()) ** 2))


def factor_regression(returns: DataFrame, factors: DataFrame, names: tuple[str, ...] = FACTORS, column: str = "net_return") -> DataFrame:
    """Per model: n_months, alpha and loadings with Newey-West t statistics, R squared. A model with fewer than factors + 5 months has no row. Months without a factor are left out. A group is one model's months."""
    rows = returns.select("MthCalDt", "model", column).join(factors.select("MthCalDt", *names), "MthCalDt").na.drop()
    fields = "model string, n_months long, alpha double, alpha_t_stat double, " + ", ".join(f"{f}_beta double, {f}_t_stat double" for f in names) + ", r_squared double"

    def fit(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values("MthCalDt")
        if len(g) < len(names) + 5:
            return pd.DataFrame(columns=[f.split()[0] for f in fields.split(", ")])
        b, t, r2 = newey_west(g[column].to_numpy(float), g[list(names)].to_numpy(float))
        row = [g["model"].iloc[0], len(g), *np.stack([b, t], axis=1).ravel(), r2]
        return pd.DataFrame([row], columns=[f.split()[0] for f in fields.split(", ")])

    return rows.groupBy("model").applyInPandas(fit, fields)

"""Long/short portfolios from scores: weights, turnover, returns, costs."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

BY = ("MthCalDt", "model")


def weights(predictions: DataFrame, deciles: int = 10, scheme: str = "equal") -> DataFrame:
    """(PERMNO, MthCalDt, model, weight), non-zero weights only: the top bucket of scores long, the bottom one short, +1 and -1 in sum.

    Months with fewer than 2 * deciles scores hold nothing. Equal scores are ordered by PERMNO. scheme "score" weights by positive
    scores on the long side, by negative ones on the short side.
    """
    if deciles < 2:
        raise ValueError("two buckets at least are needed for two legs")
    if scheme not in ("equal", "score"):
        raise ValueError(f"no weighting scheme {scheme!r}")
    rows = predictions.where(F.col("y_pred").isNotNull())
    n = F.count(F.lit(1)).over(Window.partitionBy(*BY))
    rank = F.row_number().over(Window.partitionBy(*BY).orderBy("y_pred", "PERMNO"))
    bucket = F.least(F.greatest(F.ceil(rank / n * deciles), F.lit(1)), F.lit(deciles))
    rows = rows.withColumns({"__n": n, "__b": bucket}).where(F.col("__n") >= 2 * deciles)
    leg = F.when(F.col("__b") == deciles, 1).when(F.col("__b") == 1, -1)
    rows = rows.withColumn("__leg", leg).where("__leg is not null")
    mass = F.lit(1.0) if scheme == "equal" else F.greatest(F.col("__leg") * F.col("y_pred"), F.lit(0.0))
    rows = rows.withColumn("__m", mass)
    total = F.sum("__m").over(Window.partitionBy(*BY, "__leg"))
    weight = F.when(total > 0, F.col("__leg") * F.col("__m") / total)
    return rows.select("PERMNO", *BY, weight.alias("weight")).where("weight <> 0")


def turnover(holdings: DataFrame) -> DataFrame:
    """(MthCalDt, model, turnover): half the absolute change against the previous date that has holdings; at first half the gross weight.

    Each position counts once at its own date and once, negated, at the model's next one, so no outer join is needed.
    """
    dates = holdings.select(*BY).distinct()
    following = dates.withColumn("__next", F.lead("MthCalDt").over(Window.partitionBy("model").orderBy("MthCalDt")))
    gone = holdings.join(following, list(BY)).where("__next is not null").select("PERMNO", F.col("__next").alias("MthCalDt"), "model", (-F.col("weight")).alias("weight"))
    change = holdings.select("PERMNO", *BY, "weight").unionByName(gone).groupBy("PERMNO", *BY).agg(F.sum("weight").alias("w"))
    return change.groupBy(*BY).agg((0.5 * F.sum(F.abs("w"))).alias("turnover"))


def portfolio_returns(holdings: DataFrame, realized: DataFrame, bps: float = 10.0) -> DataFrame:
    """(MthCalDt, model, gross_return, turnover, cost, net_return). Positions without a return are left out and not rescaled."""
    held = holdings.join(realized.select("PERMNO", "MthCalDt", "target_raw"), ["PERMNO", "MthCalDt"], "left").where("target_raw is not null")
    gross = held.groupBy(*BY).agg(F.sum(F.col("weight") * F.col("target_raw")).alias("gross_return"))
    out = gross.join(turnover(holdings), list(BY), "left")
    cost = F.coalesce("turnover", F.lit(0.0)) * bps / 10_000
    return out.withColumn("cost", cost).withColumn("net_return", F.col("gross_return") - F.col("cost")).select(*BY, "gross_return", "turnover", "cost", "net_return")


def realized_returns(training: DataFrame) -> DataFrame:
    return training.select("PERMNO", "MthCalDt", "target_raw")


def factor_months(panel: DataFrame, factors: list[str]) -> DataFrame:
    """One row per month of the panel's factor columns."""
    return panel.groupBy("MthCalDt").agg(*(F.max(c).alias(c) for c in factors))

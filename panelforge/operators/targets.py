"""Forward returns, targets and walk-forward folds."""

from __future__ import annotations

import datetime as dt
from dataclasses import astuple, dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


@dataclass(frozen=True)
class ModelConfig:
    """Months of horizon, purge (default: the horizon), first training window and refit; share of the first window for validation; seed; feature of the momentum baseline."""

    horizon: int = 1
    purge: int | None = None
    min_train: int = 72
    refit: int = 12
    inner_share: float = 0.2
    seed: int = 42
    momentum: str = "mom_12_1"

    @property
    def gap(self) -> int:
        return self.horizon if self.purge is None else self.purge


@dataclass(frozen=True)
class Fold:
    """Inclusive months of one fold."""

    fold_id: int
    train_start: dt.date
    train_end: dt.date
    test_start: dt.date
    test_end: dt.date
    inner_train_end: dt.date
    inner_val_start: dt.date
    inner_val_end: dt.date


def forward_return(ret: Column, horizon: int = 1) -> Column:
    """Compounded return of the next `horizon` rows of the security, all of which are needed; a return below -100% gives null."""
    w = Window.partitionBy("PERMNO").orderBy("MthCalDt").rowsBetween(1, horizon)
    usable = F.when(ret >= -1, ret)
    return F.when(F.count(usable).over(w) == horizon, F.product(1 + usable).over(w) - 1)


def targets(panel: DataFrame, horizon: int = 1) -> DataFrame:
    """(PERMNO, MthCalDt, target_raw, target_valid, target_demeaned): the last less the month's mean over investable rows with a target."""
    out = panel.select("PERMNO", "MthCalDt", "is_investable", forward_return(F.col("ret_adj"), horizon).alias("target_raw"))
    out = out.withColumn("target_valid", F.col("target_raw").isNotNull())
    middle = F.avg(F.when(F.col("is_investable"), F.col("target_raw"))).over(Window.partitionBy("MthCalDt"))
    return out.select("PERMNO", "MthCalDt", "target_raw", "target_valid", (F.col("target_raw") - middle).alias("target_demeaned"))


def demeaned(rows: DataFrame, panel: DataFrame) -> DataFrame:
    """rows that have target_raw already, with target_valid and target_demeaned as of targets(); panel: MthCalDt, is_investable and target_raw of all rows. A row per month is joined."""
    middle = panel.groupBy(F.col("MthCalDt").alias("__month")).agg(F.avg(F.when(F.col("is_investable"), F.col("target_raw"))).alias("__middle"))
    out = rows.join(F.broadcast(middle), F.col("MthCalDt").eqNullSafe(F.col("__month")), "left")
    return out.withColumns({"target_valid": F.col("target_raw").isNotNull(), "target_demeaned": F.col("target_raw") - F.col("__middle")}).drop("__month", "__middle")


def training_panel(features: DataFrame, panel: DataFrame, horizon: int = 1) -> DataFrame:
    """Features with targets by left joins; targets are computed over all rows, the universe is a filter for later."""
    return features.join(targets(panel, horizon), ["PERMNO", "MthCalDt"], "left")


def months_of(df: DataFrame) -> list[dt.date]:
    """The distinct months, sorted: a few hundred values."""
    return [r[0] for r in df.select("MthCalDt").distinct().orderBy("MthCalDt").collect()]


def walk_forward_folds(months: list[dt.date], config: ModelConfig | None = None) -> list[Fold]:
    """Expanding, purged and embargoed folds by position in the sorted months."""
    c = config or ModelConfig()
    n, gap = len(months), c.gap
    if not n:
        return []
    inner = max(1, round(c.min_train * c.inner_share))
    if c.min_train > n:
        raise ValueError(f"a first window of {c.min_train} months does not fit {n} months")
    if c.min_train < inner + 2 * gap + 1:
        raise ValueError(f"a first window of {c.min_train} months leaves no room for {inner} months of validation and gaps of {gap}")
    folds, end = [], c.min_train - 1
    while end + 1 + gap <= n - 1:
        last, stop = end - gap, min(end + c.refit, n - 1)
        inner_start = last - inner + 1
        at = [months[i] for i in (0, last, end + 1 + gap, stop, inner_start - 1 - gap, inner_start + gap, last)]
        folds.append(Fold(len(folds), *at))
        if stop == n - 1:
            break
        end = stop
    return folds


def folds_table(spark: SparkSession, folds: list[Fold]) -> DataFrame:
    names = "train_start train_end test_start test_end inner_train_end inner_val_start inner_val_end".split()
    return spark.createDataFrame([astuple(f) for f in folds], "fold_id int, " + ", ".join(f"{c} date" for c in names))


def fold_rows(df: DataFrame, folds: DataFrame, part: str = "test") -> DataFrame:
    """df's rows in each fold's part (train, inner_train, inner_val, test), with fold_id: a range join with the few folds."""
    start = {"train": "train_start", "inner_train": "train_start", "inner_val": "inner_val_start", "test": "test_start"}[part]
    end = {"train": "train_end", "inner_train": "inner_train_end", "inner_val": "inner_val_end", "test": "test_end"}[part]
    spans = F.broadcast(folds.select("fold_id", F.col(start).alias("__a"), F.col(end).alias("__b")))
    return df.join(spans, F.col("MthCalDt").between(F.col("__a"), F.col("__b"))).drop("__a", "__b")


def between(df: DataFrame, start: dt.date, end: dt.date) -> DataFrame:
    return df.where(F.col("MthCalDt").between(F.lit(start), F.lit(end)))


def complete_cases(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.na.drop(subset=columns)

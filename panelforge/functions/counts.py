"""Counts and moments of many columns at once: tasks add up batches in numpy, as one aggregation of hundreds of cells is too wide to be compiled."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_MOMENTS = "i int, n long, mean double, m2 double"


def _merged(n: int, mean: float, m2: float, k: int, own: float, around: float) -> tuple[int, float, float]:
    """Two parts as one; parts of one mean keep it as it is."""
    step = own - mean
    return n + k, mean + step * k / (n + k), m2 + around + step * step * n * k / (n + k)


def column_moments(df: DataFrame, columns: list[str]) -> list[tuple[int, float, float]]:
    """For each column the number of its values, their mean and the sum of their squared distances from it, exactly 0 for equal values. A few numbers a column come to the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = [(0, 0.0, 0.0)] * len(columns)
        for b in batches:
            for j, c in enumerate(b.columns):
                x = c.drop_null().to_numpy(zero_copy_only=False)
                if len(x):
                    with np.errstate(all="ignore"):
                        low = x.min()
                        own = float(low if low == x.max() else x.mean())
                        found[j] = _merged(*found[j], len(x), own, float(np.square(x - own).sum()))
        yield pa.RecordBatch.from_arrays([pa.array(range(len(columns)), pa.int32()), *(pa.array(v) for v in zip(*found, strict=True))], names=["i", "n", "mean", "m2"])

    def together(parts: pa.Table) -> pa.Table:
        n, mean, m2 = 0, 0.0, 0.0
        for r in parts.to_pylist():
            n, mean, m2 = _merged(n, mean, m2, r["n"], r["mean"], r["m2"])
        return pa.table({"i": parts.column("i").slice(0, 1), "n": pa.array([n]), "mean": pa.array([mean]), "m2": pa.array([m2])})

    parts = df.select(*(F.col(c).cast("double").alias(c) for c in columns)).mapInArrow(run, _MOMENTS).where("n > 0")
    out = [(0, 0.0, 0.0)] * len(columns)
    for i, *found in parts.groupBy("i").applyInArrow(together, _MOMENTS).collect():  # a row for each column
        out[i] = tuple(found)
    return out


def non_null(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column, rows, non_null) by column."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, there = 0, np.zeros(len(columns), np.int64)
        for b in batches:
            rows += b.num_rows
            there += [b.num_rows - c.null_count for c in b.columns]
        yield pa.RecordBatch.from_arrays([pa.array(columns), pa.array(np.full(len(columns), rows)), pa.array(there)], names=["column", "rows", "non_null"])

    parts = df.select(*columns).mapInArrow(run, "`column` string, rows long, non_null long")
    return parts.groupBy("column").agg(F.sum("rows").alias("rows"), F.sum("non_null").alias("non_null"))


def non_null_by_month(df: DataFrame, columns: list[str], rows: str = "__rows") -> DataFrame:
    """(MthCalDt, rows, columns): a row for each month with its rows and non-null values of each column."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int | None, np.ndarray] = {}
        for b in batches:
            month, *cells = b.columns
            known, day = month.is_valid().to_numpy(zero_copy_only=False), month.fill_null(0).to_numpy(zero_copy_only=False)
            days, at = np.unique(np.where(known, day.astype(np.int64), np.iinfo(np.int64).min), return_inverse=True)
            there = np.column_stack([np.bincount(at, minlength=len(days)), *(np.bincount(at, c.is_valid().to_numpy(zero_copy_only=False), len(days)).astype(np.int64) for c in cells)])
            for d, n in zip(days.tolist(), there, strict=True):
                d = None if d == np.iinfo(np.int64).min else d
                total[d] = total[d] + n if d in total else n
        if total:
            yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), *(pa.array(c) for c in np.stack(list(total.values())).T)], names=["month", rows, *columns])

    kinds = ", ".join(["month int", f"`{rows}` long", *(f"`{c}` long" for c in columns)])
    parts = df.select(F.unix_date("MthCalDt").alias("month"), *columns).mapInArrow(run, kinds)
    return parts.groupBy(F.date_from_unix_date("month").alias("MthCalDt")).agg(*(F.sum(c).alias(c) for c in (rows, *columns)))


def infinite(df: DataFrame, columns: list[str]) -> DataFrame:
    """One row with affected, the number of infinite values of all columns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = sum(int(np.isinf(c.drop_null().to_numpy()).sum()) for b in batches for c in b.columns)
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64())], names=["n"])

    return df.select(*(F.col(c).cast("double").alias(c) for c in columns)).mapInArrow(run, "n long").agg(F.sum("n").alias("affected"))

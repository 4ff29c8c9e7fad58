"""Null-safe arithmetic, month arithmetic, ranks."""

from __future__ import annotations

from pyspark.sql import Column, Window, WindowSpec
from pyspark.sql import functions as F


def divide(num: Column | str, den: Column | str, positive: bool = True) -> Column:
    """num / den; null unless den > 0 (or != 0). Never infinite, never an error."""
    num, den = (F.col(x) if isinstance(x, str) else x for x in (num, den))
    return num / F.when(den > 0 if positive else den != 0, den)


def positive(x: Column | str) -> Column:
    x = F.col(x) if isinstance(x, str) else x
    return F.when(x > 0, x)


def zero(x: str) -> Column:
    """The column, null as 0."""
    return F.coalesce(F.col(x), F.lit(0.0))


def finite(x: Column | str) -> Column:
    """Infinite values and NaN as null."""
    x = F.col(x) if isinstance(x, str) else x
    return F.when(~(F.isnan(x) | x.isin(float("inf"), float("-inf"))), x)


def month_number(d: Column | str) -> Column:
    """Months since year 0, so that differences count calendar months."""
    return F.year(d) * 12 + F.month(d)


def differs(a: Column, b: Column, tol: float) -> Column:
    """True where presence differs, or both are there and differ by more than tol."""
    return F.coalesce((a.isNull() != b.isNull()) | (F.abs(a - b) > tol), F.lit(False))


def average_rank(value: Column, *by: Column | str) -> Column:
    """Rank of value among the non-null values of its group, ties averaged; null for null."""
    ordered = Window.partitionBy(*by, value.isNull()).orderBy(value)
    same = Window.partitionBy(*by, value)
    return F.when(value.isNotNull(), F.rank().over(ordered) + (F.count(F.lit(1)).over(same) - 1) / 2)


def rank_share(value: Column, *by: Column | str) -> Column:
    """average_rank over the number of non-null values: (0, 1]."""
    return average_rank(value, *by) / F.count(value).over(Window.partitionBy(*by))


def enough(x: Column, w: WindowSpec, least: int, result: Column) -> Column:
    """result where the window has `least` non-null x, else null."""
    return F.when(F.count(x).over(w) >= least, result)

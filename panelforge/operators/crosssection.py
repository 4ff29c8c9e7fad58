"""Transforms within a month: winsorizing, rank scaling, z-scores."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from decimal import ROUND_HALF_UP, Context, Decimal

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelforge.functions.columns import rank_share

LOW, HIGH, LEAST = 0.01, 0.99, 10


def winsorized(value: Column, by: list[str], inside: Column, low: float = LOW, high: float = HIGH, least: int = LEAST) -> Column:
    """value clipped to its group's quantiles over the rows inside the universe; groups with fewer than `least` values are left alone. All rows are clipped."""
    w = Window.partitionBy(*by)
    own = F.when(inside, value)
    many = F.count(own).over(w) >= least
    bounds = F.percentile(own, F.array(F.lit(low), F.lit(high))).over(w)
    return F.when(value.isNotNull(), F.when(many, F.least(F.greatest(value, bounds[0]), bounds[1])).otherwise(value))


def ranked(value: Column, by: list[str], inside: Column) -> Column:
    """Rank share of the universe's values, scaled to (-1, 1]; null outside."""
    return F.when(inside, rank_share(F.when(inside, value), *by) * 2 - 1)


def standardized(value: Column, by: list[str], inside: Column) -> Column:
    """z-score within the universe; null outside or without spread."""
    w, own = Window.partitionBy(*by), F.when(inside, value)
    spread = F.stddev_samp(own).over(w)
    return (own - F.avg(own).over(w)) / F.when(spread > 0, spread)


def long_form(df: DataFrame, keys: list[str], features: list[str]) -> DataFrame:
    """(keys, feature, value): one row per row and feature."""
    return df.unpivot(keys, features, "feature", "value")


#: A scaling of one group's values: (values, where there is one, where the universe is) -> values, where there is one. The same as the column of that name.
Scaling = Callable[[np.ndarray, np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]


def _quantile(ordered: np.ndarray, p: float) -> float:
    at = (len(ordered) - 1) * p
    low, high = ordered[int(np.floor(at))], ordered[int(np.ceil(at))]
    return low if low == high else (np.ceil(at) - at) * low + (at - np.floor(at)) * high


def winsorized_values(x: np.ndarray, there: np.ndarray, inside: np.ndarray, low: float = LOW, high: float = HIGH, least: int = LEAST) -> tuple[np.ndarray, np.ndarray]:
    own = np.sort(x[there & inside])
    if len(own) < least:
        return x, there
    bottom, top = _quantile(own, low), _quantile(own, high)
    out = np.where(x < bottom, bottom, x)
    return np.where((out > top) | np.isnan(out) & ~np.isnan(top), top, out), there


def ranked_values(x: np.ndarray, there: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    own = np.flatnonzero(there & inside)
    order = own[np.argsort(x[own])]  # equal values get one rank in any order
    s, n = x[order], len(order)
    out = np.zeros(len(x))
    if n:
        new = np.r_[True, (s[1:] != s[:-1]) & ~(np.isnan(s[1:]) & np.isnan(s[:-1]))]
        starts = np.flatnonzero(new)
        same = np.diff(np.r_[starts, n])
        out[order] = ((starts + 1 + (same - 1) / 2) / n * 2 - 1)[np.cumsum(new) - 1]
    return out, there & inside


def standardized_values(x: np.ndarray, there: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    own = there & inside
    s = x[own]
    spread = np.std(s, ddof=1) if len(s) > 1 and s.min() != s.max() else 0.0  # equal values have none, whatever their mean rounds to
    return ((x - s.mean()) / spread, own) if spread > 0 else (x, np.zeros(len(x), bool))


_WIDE = Context(prec=400)


def rounded_values(x: np.ndarray, digits: int) -> np.ndarray:
    """As of Spark's round: half up by the decimal digits that a double is shown with. Only values near a tie and very large ones are rounded one by one. There is no -0."""
    scale = 10.0**digits
    with np.errstate(all="ignore"):
        y = np.abs(x) * scale
        out = np.copysign(np.floor(y + 0.5) / scale, x)
        doubt = np.isfinite(x) & ~((y < 2.0**50) & (np.abs(y - np.floor(y) - 0.5) > np.maximum(1e-6, y * 2.0**-50)))
    out = np.where(np.isfinite(x), out, x)
    step = Decimal(1).scaleb(-digits)
    for i in np.flatnonzero(doubt):
        out[i] = float(Decimal(repr(float(x[i]))).quantize(step, ROUND_HALF_UP, _WIDE))
    return out + 0.0


def scaled(raw: DataFrame, keys: list[str], features: list[str], steps: tuple[Scaling, ...], digits: int | None = None) -> DataFrame:
    """(keys, features), scaled by month over the universe, one step after another, and rounded to digits if given. keys have MthCalDt and is_investable.

    Months are dealt whole, in columns: one shuffle of as many rows as there are, and a task holds one month's rows at a time.
    """
    rows = raw.select(*keys, *(F.col(f).cast("double").alias(f) for f in features))

    def run(month: pa.Table) -> pa.Table:
        inside = month.column("is_investable").combine_chunks().fill_null(False).to_numpy(zero_copy_only=False)
        columns = {}
        for f in features:
            c = month.column(f).combine_chunks()
            x, there = c.fill_null(0.0).to_numpy(zero_copy_only=False), c.is_valid().to_numpy(zero_copy_only=False)
            with np.errstate(all="ignore"):
                for step in steps:
                    x, there = step(x, there, inside)
            x = x if digits is None else rounded_values(x, digits)
            columns[f] = pa.array(x, pa.float64(), mask=~there)
        return pa.table([*(month.column(k) for k in keys), *columns.values()], names=[*keys, *features])

    return rows.groupBy("MthCalDt").applyInArrow(run, rows.schema)


def model_ready(raw: DataFrame, keys: list[str], features: list[str], digits: int | None = None) -> DataFrame:
    """All features winsorized, then rank-scaled, by month over the universe."""
    return scaled(raw, keys, features, (winsorized_values, ranked_values), digits)


#: Rows that a task sorts by month at a time.
PACKED_ROWS = 50_000


def _packed(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.RecordBatch]:
    """(month, i, v): for each month of some `rows` rows and each column after the first, the bytes of the column's values, none included."""

    def pack(some: list[pa.RecordBatch]) -> pa.RecordBatch:
        month, *cells = pa.Table.from_batches(some).columns
        month = month.combine_chunks()
        order = pc.array_sort_indices(month, null_placement="at_end").to_numpy()
        sorted_ = month.take(pa.array(order))
        day, known = sorted_.cast(pa.int32()).fill_null(0).to_numpy(), sorted_.is_valid().to_numpy(zero_copy_only=False)
        starts = np.flatnonzero(np.r_[True, (day[1:] != day[:-1]) | (known[1:] != known[:-1])])
        values = []
        for c in cells:
            c = c.cast(pa.float64())
            there = c.is_valid().to_numpy()[order]
            ends = np.r_[0, np.cumsum(there)][np.r_[starts, len(order)]]  # of the months, in the values that are there
            x = np.ascontiguousarray(c.fill_null(0.0).to_numpy()[order][there], "<f8").tobytes()
            values += [x[8 * a : 8 * b] for a, b in zip(ends[:-1], ends[1:], strict=True)]
        places = np.repeat(np.arange(len(cells), dtype=np.int32), len(starts))
        return pa.RecordBatch.from_arrays([sorted_.take(pa.array(np.tile(starts, len(cells)))), pa.array(places), pa.array(values, pa.binary())], names=["month", "i", "v"])

    some, n = [], 0
    for b in batches:
        some, n = [*some, b], n + b.num_rows
        if n >= rows:
            yield pack(some)
            some, n = [], 0
    if n:
        yield pack(some)


def packing(columns: list[str]) -> tuple[Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], str]:
    """What lays the values of rows with MthCalDt and the columns side by side by month and column, and its schema: a step for mapInArrow."""
    names, rows = ["MthCalDt", *columns], PACKED_ROWS
    return lambda batches: _packed((b.select(names) for b in batches), rows), "month date, i int, v binary"


def packed_medians(packed: DataFrame, columns: list[str]) -> DataFrame:
    """(MthCalDt, column, median) from what packing has made: few rows are shuffled however many values there are, and a task holds one column of a month at a time."""

    def run(part: pa.Table) -> pa.Table:
        x = np.frombuffer(b"".join(part.column("v").to_pylist()), "<f8")
        middle = None
        if len(x):
            k = (len(x) - 1) // 2
            low, high = np.partition(x, [k, len(x) // 2])[[k, len(x) // 2]]
            middle = low if low == high else 0.5 * low + 0.5 * high
        return pa.table({"MthCalDt": part.column("month").slice(0, 1), "column": pa.array([columns[part.column("i")[0].as_py()]]), "median": pa.array([middle], pa.float64())})

    return packed.groupBy("month", "i").applyInArrow(run, "MthCalDt date, `column` string, median double")


def month_medians(df: DataFrame, columns: list[str]) -> DataFrame:
    """(MthCalDt, column, median) of each month's values, null without any."""
    rows = df.select(F.col("MthCalDt").cast("date").alias("MthCalDt"), *(F.col(c).cast("double").alias(c) for c in columns))
    return packed_medians(rows.mapInArrow(*packing(columns)), columns)

"""Coverage, distribution and stability tables."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelforge.functions.counts import column_moments, non_null, non_null_by_month
from panelforge.operators.crosssection import month_medians
from panelforge.sources.shared import materialize

QUANTILES = (0.01, 0.25, 0.5, 0.75, 0.99)
#: Ranges of values that exact quantiles are looked for in.
CUTS = 512


def coverage(df: DataFrame, columns: list[str]) -> DataFrame:
    """column, rows, non_null, pct_non_null, pct_missing; most missing first."""
    out = non_null(df, columns)
    pct = 100 * F.col("non_null") / F.col("rows")
    return out.withColumns({"pct_non_null": pct, "pct_missing": 100 - pct}).orderBy(F.desc("pct_missing"), "column")


def coverage_over_time(df: DataFrame, columns: list[str], unit: str = "year") -> DataFrame:
    """period, column, share of non-null rows in percent, by year or month."""
    return _shares(non_null_by_month(df, columns), columns, unit)


def coverage_by_year_and_month(df: DataFrame, columns: list[str]) -> DataFrame:
    """The same by year and by month, from one pass."""
    counts = materialize(non_null_by_month(df, columns), "month-counts")
    return _shares(counts, columns, "year").unionByName(_shares(counts, columns, "month"))


def _shares(counts: DataFrame, columns: list[str], unit: str) -> DataFrame:
    period = F.year("MthCalDt").cast("string") if unit == "year" else F.date_format("MthCalDt", "yyyy-MM")
    sums = counts.groupBy(period.alias("period")).agg(*(F.sum(c).alias(c) for c in ("__rows", *columns)))
    return sums.unpivot(["period", "__rows"], columns, "column", "n").select("period", "column", (100 * F.col("n") / F.col("__rows")).alias("pct_non_null"))


def _at_ranks(cells: DataFrame, wanted: DataFrame) -> DataFrame:
    """(column, q) from all cells (column, range, value) of the ranges that are wanted. wanted: a row for each column, quantile and rank, with its place and its range's first rank."""
    few = F.broadcast
    inside = cells.groupBy("column", "range", "value").agg(F.count(F.lit(1)).alias("n"))
    last = F.sum("n").over(Window.partitionBy("column", "range").orderBy("value"))
    inside = inside.select("column", "range", "value", (last - F.col("n")).alias("from"), last.alias("to"))
    hit = inside.join(few(wanted), ["column", "range"]).where((F.col("rank") - F.col("start") >= F.col("from")) & (F.col("rank") - F.col("start") < F.col("to")))
    low, high = F.min_by("value", "rank"), F.max_by("value", "rank")
    one = hit.groupBy("column", "i").agg((low + (high - low) * (F.first("at") - F.floor(F.first("at")))).alias("q"))
    return one.groupBy("column").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "q"))), lambda x: x["q"]).alias("q"))


def quantiles_in_columns(df: DataFrame, columns: list[str], cuts: list[list[float]], probabilities: tuple[float, ...] = QUANTILES) -> DataFrame:
    """(column, q): exact quantiles of the columns' values with linear interpolation, without all values of a column in one place.

    cuts part each column's values into ranges; each task counts its values by range, and only values of ranges that hold a wanted
    rank become rows, of which each range orders the distinct ones by itself.
    """
    edges = [np.unique(np.array(c, float)) for c in cuts]

    def placed(b: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        for j, c in enumerate(b.columns):
            x = c.drop_null().to_numpy()
            yield j, x, np.searchsorted(edges[j], x, "left")

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = [np.zeros(len(e) + 1, np.int64) for e in edges]
        for b in batches:
            for j, _, at in placed(b):
                total[j] += np.bincount(at, minlength=len(total[j]))
        i, r, n = (np.concatenate(x) for x in zip(*((np.full(len(t), j, np.int32), np.arange(len(t), dtype=np.int32), t) for j, t in enumerate(total)), strict=True))
        yield pa.RecordBatch.from_arrays([pa.array(i), pa.array(r), pa.array(n)], names=["i", "range", "n"])

    wide, sizes = df.select(*columns), [np.zeros(len(e) + 1, np.int64) for e in edges]
    for i, r, n in wide.mapInArrow(counted, "i int, range int, n long").groupBy("i", "range").agg(F.sum("n")).collect():  # a row for each column and range
        sizes[i][r] = n
    rows = []
    for c, size in zip(columns, sizes, strict=True):
        ends, total = np.cumsum(size), int(size.sum())
        for i, p in enumerate(probabilities if total else ()):
            at = p * (total - 1)
            for rank in sorted({math.floor(at), math.ceil(at)}):
                r = int(np.searchsorted(ends, rank, "right"))
                rows.append((c, r, int(ends[r] - size[r]), i, float(at), rank))
    open_ = [np.array(sorted({r for c, r, *_ in rows if c == name}), int) for name in columns]

    def inside(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for j, x, at in placed(b):
                mine = np.isin(at, open_[j])
                yield pa.RecordBatch.from_arrays([pa.array([columns[j]] * int(mine.sum()), pa.string()), pa.array(at[mine].astype(np.int32)), pa.array(x[mine])], names=["column", "range", "value"])

    wanted = df.sparkSession.createDataFrame(rows, "`column` string, range int, start long, i int, at double, rank long")
    return _at_ranks(wide.mapInArrow(inside, "`column` string, range int, value double"), wanted)


def distributions(df: DataFrame, columns: list[str], exact: bool = True) -> DataFrame:
    """column, count, mean, std, min, quantiles, max. exact=False takes percentile_approx."""
    df = materialize(df.select(*(F.col(c).cast("double").alias(c) for c in columns)), "distributions")  # read several times
    cut = [i / CUTS for i in range(1, CUTS)] if exact else list(QUANTILES)
    cuts = lambda c: F.percentile_approx(c, cut, 10 * CUTS)
    figures = {"n": F.count, "mean": F.avg, "std": F.stddev_samp, "min": F.min, "max": F.max, "cuts": cuts}
    one = df.agg(F.array(*(F.struct(F.lit(c).alias("column"), *(f(c).alias(k) for k, f in figures.items())) for c in columns)).alias("c"))
    out = materialize(one.select(F.inline("c")).where("n > 0"), "figures")
    many = out.select("column", F.col("cuts").alias("q"))
    if exact:
        found = dict(many.collect())  # CUTS numbers for each column
        many = quantiles_in_columns(df, columns, [found.get(c) or [] for c in columns])
    out = out.join(F.broadcast(many), "column")  # a row for each column
    return out.select("column", "n", "mean", "std", "min", *(F.col("q")[i].alias(f"p{int(p * 100):02d}") for i, p in enumerate(QUANTILES)), "max")


def correlations(df: DataFrame, columns: list[str]) -> DataFrame:
    """(a, b, n, corr) for each pair of columns, a before b, over rows that have both; null without spread.

    A task keeps cross products of values and of masks of what is there, as distances from the columns' means; of each pair it sends
    one row.
    """
    p = len(columns)
    df = materialize(df.select(*columns), "correlated")  # read twice
    shift = np.array([mean for _, mean, _ in column_moments(df, columns)])

    def products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, x1, xy, xx = (np.zeros((p, p)) for _ in range(4))
        for b in batches:
            x = np.column_stack([c.to_numpy(zero_copy_only=False).astype(float) for c in b.columns]) - shift
            there = ~np.isnan(x)
            x, m = np.where(there, x, 0.0), there.astype(float)
            n += m.T @ m
            x1 += x.T @ m  # sums of a column's values where another one is there
            xy += x.T @ x
            xx += (x * x).T @ m
        i, j = np.triu_indices(p, 1)
        cells = (i.astype(np.int32), j.astype(np.int32), n[i, j], x1[i, j], x1[j, i], xy[i, j], xx[i, j], xx[j, i])
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in cells], names=["i", "j", "n", "x", "y", "xy", "xx", "yy"])

    parts = df.select(*(F.col(c).cast("double").alias(c) for c in columns)).mapInArrow(products, "i int, j int, n double, x double, y double, xy double, xx double, yy double")
    sums = parts.groupBy("i", "j").agg(*(F.sum(c).alias(c) for c in ("n", "x", "y", "xy", "xx", "yy")))
    spread = lambda s, q: F.col("n") * F.col(q) - F.col(s) * F.col(s)
    flat = (spread("x", "xx") <= 1e-12 * F.col("n") * F.col("xx")) | (spread("y", "yy") <= 1e-12 * F.col("n") * F.col("yy"))
    corr = F.when(~flat, F.try_divide(F.col("n") * F.col("xy") - F.col("x") * F.col("y"), F.sqrt(F.greatest(spread("x", "xx"), F.lit(0.0))) * F.sqrt(F.greatest(spread("y", "yy"), F.lit(0.0)))))
    names = F.array(*map(F.lit, columns))
    return sums.select(F.get(names, F.col("i")).alias("a"), F.get(names, F.col("j")).alias("b"), F.col("n").cast("long").alias("n"), corr.alias("corr"))


def outliers(df: DataFrame, columns: list[str], n_std: float = 3.0) -> DataFrame:
    """column, n, percent of its values farther than n_std standard deviations from its mean."""
    df = materialize(df.select(*(F.col(c).cast("double").alias(c) for c in columns)), "outliers")  # read twice
    moments = column_moments(df, columns)
    middle = [mean for _, mean, _ in moments]
    least = [n_std * math.sqrt(m2 / (n - 1)) if n > 1 else math.nan for n, _, m2 in moments]  # nothing is farther than NaN

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, far = np.zeros(len(columns), np.int64), np.zeros(len(columns), np.int64)
        for b in batches:
            for j, c in enumerate(b.columns):
                x = c.drop_null().to_numpy()
                n[j] += len(x)
                with np.errstate(all="ignore"):
                    far[j] += np.count_nonzero(np.abs(x - middle[j]) > least[j])
        yield pa.RecordBatch.from_arrays([pa.array(columns), pa.array(n), pa.array(far)], names=["column", "n", "far"])

    counts = df.mapInArrow(run, "`column` string, n long, far long").groupBy("column").agg(F.sum("n").alias("n"), F.sum("far").alias("far"))
    return counts.where("n > 0").select("column", "n", (100 * F.col("far") / F.col("n")).alias("pct_outlier"))


def stability(df: DataFrame, columns: list[str]) -> DataFrame:
    """(MthCalDt, column, median) of the month's values."""
    return month_medians(df, columns)


def universe_size(df: DataFrame) -> DataFrame:
    """MthCalDt, rows, investable rows and their percentage."""
    out = df.groupBy("MthCalDt").agg(F.count(F.lit(1)).alias("rows"), F.count_if("is_investable").alias("investable"))
    return out.withColumn("pct_investable", 100 * F.col("investable") / F.col("rows"))


def unit_audit(panel: DataFrame) -> DataFrame:
    """Quantiles of ratios that show a unit slip: price * shares / cap, and book value per share."""
    ratios = {"price_shares_to_cap": F.col("MthPrc") * F.col("ShrOut") / F.when(F.col("MthCap") > 0, F.col("MthCap")), "book_per_share": F.col("cst_seq") / F.when(F.col("ShrOut") > 0, F.col("ShrOut"))}
    return distributions(panel.select(*(v.alias(k) for k, v in ratios.items())), list(ratios))

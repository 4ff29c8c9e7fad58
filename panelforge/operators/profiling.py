"""Column, date, key and duplicate profiles."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelforge.sources.io import date_counts
from panelforge.sources.schema import DatasetSpec

SAMPLES = 5
#: Sketches of one pass over a table.
SKETCHES = 128


def profile_columns(df: DataFrame) -> DataFrame:
    """Per column: column, dtype, rows, nulls, null_pct (4 places), distinct non-null values and the five smallest of them as text.

    One pass over the table in long form: (column, value) pairs are pre-aggregated before the shuffle, so that no column's distinct
    values meet in one task.
    """
    if not df.columns:
        raise ValueError("a table without columns has no profile")
    kinds = dict(df.dtypes)
    cells = df.select(F.explode(F.array(*(F.struct(F.lit(c).alias("column"), F.col(f"`{c}`").cast("string").alias("value")) for c in df.columns))).alias("c")).select("c.*")
    counted = cells.groupBy("column", "value").count()
    out = counted.groupBy("column").agg(
        F.sum("count").alias("rows"),
        F.coalesce(F.sum(F.when(F.col("value").isNull(), F.col("count"))), F.lit(0)).alias("nulls"),
        F.count("value").alias("distinct"),
        F.min("value").alias("smallest"),
    )
    names = df.sparkSession.createDataFrame([(c, kinds[c], i) for i, c in enumerate(df.columns)], "column string, dtype string, position int")
    out = names.join(out, "column", "left").fillna(0, ["rows", "nulls", "distinct"])
    pct = F.when(F.col("rows") > 0, F.round(100 * F.col("nulls") / F.col("rows"), 4)).otherwise(0.0)
    return out.select("column", "dtype", "position", "rows", "nulls", pct.alias("null_pct"), "distinct", "smallest")


def column_samples(df: DataFrame) -> DataFrame:
    """Per column the five smallest distinct non-null values as text."""
    cells = df.select(F.explode(F.array(*(F.struct(F.lit(c).alias("column"), F.col(f"`{c}`").cast("string").alias("value")) for c in df.columns))).alias("c")).select("c.*")
    distinct = cells.where("value is not null").distinct()
    ranked = distinct.withColumn("n", F.row_number().over(Window.partitionBy("column").orderBy("value"))).where(f"n <= {SAMPLES}")
    return ranked.groupBy("column").agg(F.array_sort(F.collect_list("value")).alias("samples"))


def profile_dates(df: DataFrame, spec: DatasetSpec) -> DataFrame:
    """Per date column of the spec: valid, sentinel and invalid counts, first and last date, invalid samples."""
    parts = [date_counts(df, c, spec.sentinels.get(c, {})) for c in spec.date_columns]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def suggest_key(df: DataFrame, longest: int = 3) -> tuple[str, ...] | None:
    """The first smallest combination of columns, in table order, without duplicates; () for an empty table, None without one of up to `longest` columns.

    One pass keeps a distinct-count sketch for each combination of a size; only combinations whose estimate comes near the number of rows
    are counted exactly, in order. A combination that holds a smaller one's columns can't be excluded by it, so each size is one pass.
    """
    columns, few = df.columns, 0.02
    n = df.count()
    if n == 0:
        return ()
    together = lambda at: F.struct(*(F.col(f"`{columns[i]}`") for i in at))
    for size in range(1, longest + 1):
        combos = list(combinations(range(len(columns)), size))
        if not combos:
            break
        near: list[tuple[int, ...]] = []
        for a in range(0, len(combos), SKETCHES):
            part = combos[a : a + SKETCHES]
            got = df.agg(*(F.approx_count_distinct(F.xxhash64(*(F.col(f"`{columns[i]}`") for i in at)), few).alias(f"k{j}") for j, at in enumerate(part))).first()
            near += [at for j, at in enumerate(part) if got[f"k{j}"] >= n * (1 - 6 * few)]
        for at in near:  # in table order; the exact count is one shuffle of the combination's distinct values
            if df.select(together(at).alias("key")).distinct().count() == n:
                return tuple(columns[i] for i in at)
    return None


def profile_duplicates(df: DataFrame, key: tuple[str, ...] | None) -> DataFrame:
    """One row: key_columns, key_source, rows, rows in duplicate groups, excess rows, exact full-row duplicates among them, conflicting rows."""
    source = "declared"
    if key is None:
        key = suggest_key(df)
        source = "auto-detected" if key else "none-found"
        key = key or tuple(df.columns)
    rest = [c for c in df.columns if c not in key]
    # Equal full rows first, then keys: two aggregations, each with map-side sums.
    rows = df.groupBy(*key, *rest).agg(F.count(F.lit(1)).alias("__n"))
    keys = rows.groupBy(*key).agg(F.sum("__n").alias("n"), F.sum(F.when(F.col("__n") > 1, F.col("__n")).otherwise(0)).alias("exact"))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long")
    out = keys.agg(
        zero(F.sum("n")).alias("rows"),
        zero(F.sum(F.when(F.col("n") > 1, F.col("n")))).alias("duplicate_key_rows"),
        zero(F.sum(F.col("n") - 1)).alias("excess_rows"),
        zero(F.sum(F.when(F.col("n") > 1, F.col("exact")))).alias("exact_rows"),
    )
    return out.select(F.lit(",".join(key)).alias("key_columns"), F.lit(source).alias("key_source"), "*", (F.col("duplicate_key_rows") - F.col("exact_rows")).alias("conflicting_rows"))


def profile_dataset(df: DataFrame, spec: DatasetSpec) -> dict[str, DataFrame]:
    """The whole profile as tables: columns, samples, dates (if the spec has any), duplicates."""
    out = {"columns": profile_columns(df), "samples": column_samples(df), "duplicates": profile_duplicates(df, spec.key)}
    return out | ({"dates": profile_dates(df, spec)} if spec.date_columns else {})

"""Exact and conflicting duplicates."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelforge.sources.io import parse_dates
from panelforge.sources.schema import DatasetSpec


def drop_exact_duplicates(df: DataFrame) -> DataFrame:
    """One of each set of wholly equal rows; nulls are equal to nulls."""
    return df.dropDuplicates()


def clean(df: DataFrame, spec: DatasetSpec) -> DataFrame:
    """Exact duplicates dropped, declared dates cast."""
    return parse_dates(drop_exact_duplicates(df), spec)


def cleaning_summary(df: DataFrame) -> DataFrame:
    """One row: rows_in, rows_out, rows_dropped."""
    distinct = df.groupBy(*df.columns).count()
    return distinct.agg(F.coalesce(F.sum("count"), F.lit(0)).alias("rows_in"), F.count(F.lit(1)).alias("rows_out")).withColumn("rows_dropped", F.col("rows_in") - F.col("rows_out"))


def resolve_duplicate_keys(df: DataFrame, keys: list[str], order: list[str] | None = None) -> DataFrame:
    """One row per key: the one with the fewest nulls over all columns. Ties go to the first by `order` (an ingest sequence), else by all other columns ascending."""
    nulls = sum((F.col(c).isNull().cast("int") for c in df.columns), F.lit(0))
    ties = order or [c for c in df.columns if c not in keys]
    w = Window.partitionBy(*keys).orderBy("__nulls", *(F.col(c).asc_nulls_last() for c in ties))
    return df.withColumn("__nulls", nulls).withColumn("__row", F.row_number().over(w)).where("__row = 1").drop("__nulls", "__row")


def duplicate_summary(df: DataFrame, keys: list[str]) -> DataFrame:
    """One row: rows_in, rows_out, duplicate_groups, rows_dropped."""
    groups = df.groupBy(*keys).count()
    return groups.agg(F.coalesce(F.sum("count"), F.lit(0)).alias("rows_in"), F.count(F.lit(1)).alias("rows_out"), F.count_if(F.col("count") > 1).alias("duplicate_groups")).withColumn(
        "rows_dropped", F.col("rows_in") - F.col("rows_out")
    )

"""Scans and sinks: CSV with declared schemas, dates parsed with counts, Parquet tables, small result tables."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from panelforge.sources.schema import DATASETS, DatasetSpec

#: Formats tried in this order; the first that fits wins.
DATE_FORMATS = ("yyyy-MM-dd", "yyyyMMdd", "MM/dd/yyyy", "dd-MMM-yyyy", "yyyy-MM-dd HH:mm:ss")
#: Tables of the interim layer that later steps read.
INTERIM = ("crsp_monthly_stock", "crsp_delisting", "ccm_link_table", "compustat_fundamentals_annual", "fama_french_5f_momentum_monthly")


def load_raw(spark: SparkSession, spec: DatasetSpec, folder: str) -> DataFrame:
    """CSV scan with the declared schema, dates as strings; other column names raise, and a missing file raises FileNotFoundError. The path may lie in any store that Spark reads."""
    try:
        return spark.read.schema(spec.raw_ddl).option("header", True).option("mode", "FAILFAST").option("enforceSchema", False).csv(f"{folder}/{spec.filename}")
    except AnalysisException as e:
        if "PATH_NOT_FOUND" in str(e):
            raise FileNotFoundError(f"{folder}/{spec.filename}") from e
        raise


def load_all_raw(spark: SparkSession, folder: str, specs: dict[str, DatasetSpec] | None = None) -> dict[str, DataFrame]:
    return {name: load_raw(spark, spec, folder) for name, spec in (specs or DATASETS).items()}


def parsed_date(raw: Column, formats: Iterable[str] = DATE_FORMATS) -> Column:
    """The date of a string in any of the formats, else null. Never raises."""
    return F.coalesce(*(F.to_date(F.try_to_timestamp(F.trim(raw), F.lit(f))) for f in formats))


def date_class(raw: Column, sentinels: Iterable[str] = (), formats: Iterable[str] = DATE_FORMATS) -> Column:
    """valid, sentinel, invalid or blank. A blank is no invalid value."""
    text = F.trim(raw)
    known = text.isin(*sentinels) if tuple(sentinels) else F.lit(False)
    return F.when(text.isNull() | (text == ""), "blank").when(known, "sentinel").when(parsed_date(raw, formats).isNotNull(), "valid").otherwise("invalid")


def date_counts(df: DataFrame, column: str, sentinels: Iterable[str] = (), formats: Iterable[str] = DATE_FORMATS) -> DataFrame:
    """One row: column, n_valid, n_sentinel, n_invalid, min_date, max_date and the five smallest distinct invalid values."""
    kind, date = date_class(F.col(column), sentinels, formats), parsed_date(F.col(column), formats)
    valid = F.when(kind == "valid", date)
    counts = df.agg(F.lit(column).alias("column"), *(F.count_if(kind == k).alias(f"n_{k}") for k in ("valid", "sentinel", "invalid")), F.min(valid).alias("min_date"), F.max(valid).alias("max_date"))
    return counts.crossJoin(smallest(df.where(kind == "invalid"), F.col(column), 5).withColumnRenamed("samples", "invalid_samples"))


def smallest(df: DataFrame, value: Column, n: int) -> DataFrame:
    """One row with samples, the n smallest distinct values in order: each task keeps n, so no group gathers all values."""
    return df.select(value.alias("v")).where("v is not null").distinct().orderBy("v").limit(n).agg(F.array_sort(F.collect_list("v")).alias("samples"))


def parse_dates(df: DataFrame, spec: DatasetSpec) -> DataFrame:
    """df with the spec's date columns as dates; sentinels and invalid values are null."""
    return df.withColumns({c: F.when(date_class(F.col(c), spec.sentinels.get(c, {})) == "valid", parsed_date(F.col(c))) for c in spec.date_columns if c in df.columns})


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def read_interim(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """The five interim tables; the names table, which has no key, is left out on purpose."""
    return {name: read_table(spark, folder, name) for name in INTERIM}


def write_table(df: DataFrame, folder: str, name: str, date_column: str | None = None) -> None:
    """Parquet sink; with a date column the table is partitioned by its year."""
    out, writer = df, lambda d: d.write.mode("overwrite")
    if date_column:
        out = df.withColumn("year", F.year(date_column))
        writer(out).partitionBy("year").parquet(f"{folder}/{name}.parquet")
    else:
        writer(out).parquet(f"{folder}/{name}.parquet")


def overwrite_years(df: DataFrame, folder: str, name: str, date_column: str) -> None:
    """Rewrites the years that df has of a table that write_table partitioned by year; all other years stay as they are."""
    out = df.withColumn("year", F.year(date_column))
    out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("year").parquet(f"{folder}/{name}.parquet")


def write_raw(df: DataFrame, spec: DatasetSpec, folder: str, sentinel: dict[str, str] | None = None) -> None:
    """CSV sink in the raw layout: all columns of the spec, missing ones empty; sentinel: what stands for no date, by column."""
    cell = lambda c: F.col(c).cast("string") if c in df.columns else F.lit(None).cast("string")
    out = df.select(*(F.coalesce(cell(c), F.lit((sentinel or {}).get(c))).alias(c) for c in spec.types))
    out.write.mode("overwrite").option("header", True).csv(f"{folder}/{spec.filename}")


def write_result(df: DataFrame, folder: str, name: str, kind: str = "csv") -> None:
    """Sink of a small result table, one file of CSV or JSON lines."""
    writer = df.coalesce(1).write.mode("overwrite")
    writer.option("header", True).csv(f"{folder}/{name}.csv") if kind == "csv" else writer.json(f"{folder}/{name}.json")

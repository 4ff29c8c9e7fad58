"""As-of joins without look-ahead: equi joins on key and years with a range of validity, made by lead()."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelforge.functions.columns import month_number

#: Order of preference of link kinds; any other comes last.
LINK_PREFERENCE = ("P", "C", "J", "N")
#: Years of a bucket of the as-of joins: a span of a year lies in one or two of them.
BUCKET_YEARS = 2


def unmatched(df: DataFrame) -> Column:
    """A negative number by a row's hash: the join key of rows that are to meet nothing, spread over all tasks."""
    return F.pmod(F.xxhash64(*df.columns), F.lit(4096)) - 4096


def latest_before(left: DataFrame, right: DataFrame, left_key: str, left_time: str, right_key: str, right_time: str, ties: list[Column], keep: dict[str, str], bucket_years: int | None = BUCKET_YEARS) -> DataFrame:
    """left with columns of the latest right row of the same key whose time is at or before left's: keep maps right's columns to new names.

    Of right rows with one key and time the first by `ties` counts. Each right row is valid until the next one's time, and its span is
    laid out over buckets of a few years: the join is an equi join on (key, bucket) with a range condition that at most one row
    meets, so the rows of a hot key spread over its years and meet only the spans of their bucket. All years after the newest right row
    are one bucket, in which a key has one span. Left rows without a key, without a time or before the first right row get nulls;
    those without key or time stand under buckets of their own by hash, so that they meet no span and never meet in one task.
    bucket_years None joins by key alone: for a left side that is dealt by key already, which then stays where it is.
    """
    w = Window.partitionBy(right_key, right_time).orderBy(*ties) if ties else Window.partitionBy(right_key, right_time).orderBy(F.lit(0))
    one = right.where(F.col(right_key).isNotNull() & F.col(right_time).isNotNull()).withColumn("__n", F.row_number().over(w)).where("__n = 1")
    spans = one.select(
        F.col(right_key).alias("__key"), F.col(right_time).alias("__from"), F.lead(right_time).over(Window.partitionBy(right_key).orderBy(right_time)).alias("__to"),
        *(F.col(c).alias(to) for c, to in keep.items()),
    )
    if bucket_years is None:
        fits = (F.col(left_key) == F.col("__key")) & (F.col(left_time) >= F.col("__from")) & (F.col("__to").isNull() | (F.col(left_time) < F.col("__to")))
        return left.join(spans, fits, "left").drop("__key", "__from", "__to")
    bucket = lambda t: F.floor(F.year(t) / bucket_years)
    last = F.coalesce(right.agg(F.max(bucket(F.col(right_time)))).scalar(), F.lit(0)) + 1
    spans = spans.withColumn("__in", F.explode(F.sequence(bucket(F.col("__from")), F.coalesce(bucket(F.date_sub("__to", 1)), last))))
    known = F.col(left_key).isNotNull() & F.col(left_time).isNotNull()
    keyed = left.withColumn("__bucket", F.when(known, F.least(bucket(F.col(left_time)), last)).otherwise(unmatched(left)))
    fits = (F.col(left_key) == F.col("__key")) & (F.col("__bucket") == F.col("__in")) & (F.col(left_time) >= F.col("__from")) & (F.col("__to").isNull() | (F.col(left_time) < F.col("__to")))
    return keyed.join(spans, fits, "left").drop("__key", "__from", "__to", "__in", "__bucket")


def link_entities(panel: DataFrame, links: DataFrame, bucket_years: int | None = BUCKET_YEARS) -> DataFrame:
    """panel with gvkey and link_matched: the newest link that began at or before the month; none if that one has ended, even where an older link is still open. bucket_years: as of latest_before."""
    order = F.coalesce(F.array_position(F.array(*map(F.lit, LINK_PREFERENCE)), F.col("LINKPRIM")), F.lit(0))
    ties = [F.when(order == 0, len(LINK_PREFERENCE) + 1).otherwise(order), F.col("gvkey")]
    right = links.select("LPERMNO", "LINKDT", "LINKENDDT", "LINKPRIM", "gvkey")
    out = latest_before(panel, right, "PERMNO", "MthCalDt", "LPERMNO", "LINKDT", ties, {"gvkey": "gvkey", "LINKENDDT": "__end"}, bucket_years)
    live = F.col("__end").isNull() | (F.col("MthCalDt") <= F.col("__end"))
    out = out.withColumn("gvkey", F.when(live, F.col("gvkey"))).drop("__end")
    return out.withColumn("link_matched", F.col("gvkey").isNotNull())


def attach_annual(panel: DataFrame, annual: DataFrame, columns: list[str], lag_months: int = 6, shelf_months: int = 12, prefix: str = "cst_", book: str = "cst_") -> DataFrame:
    """panel with the latest annual facts that were available: availability is datadate + lag_months.

    Facts older than shelf_months calendar months at the panel's month are nulled, but {book}available_date, {book}age_months and
    {book}expired stay. Rows without gvkey pass through with nulls.
    """
    right = annual.withColumn("__available", F.add_months("datadate", lag_months))
    keep = {c: f"{prefix}{c}" for c in columns} | {"__available": f"{book}available_date"}
    ties = [F.col("datadate").desc(), *(F.col(c).asc_nulls_last() for c in columns)]
    out = latest_before(panel, right, "gvkey", "MthCalDt", "GVKEY", "__available", ties, keep)
    age = month_number("MthCalDt") - month_number(f"{book}available_date")
    out = out.withColumn(f"{book}age_months", age).withColumn(f"{book}expired", F.coalesce(F.col(f"{book}age_months") > shelf_months, F.lit(False)))
    return out.withColumns({f"{prefix}{c}": F.when(~F.col(f"{book}expired"), F.col(f"{prefix}{c}")) for c in columns})


def attach_factors(panel: DataFrame, factors: DataFrame, prefix: str = "ff_") -> DataFrame:
    """panel with the month's factors, prefixed; months without factors get nulls. The series has a row per calendar month, so it is broadcast."""
    named = factors.select(F.trunc("dateff", "MM").alias("__month"), *(F.col(c).alias(f"{prefix}{c}") for c in factors.columns))
    return panel.withColumn("__month", F.trunc("MthCalDt", "MM")).join(F.broadcast(named), "__month", "left").drop("__month")

"""Cross-table checks; each gives one finding row of a fixed schema."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelforge.sources.io import smallest

SAMPLES = 10
#: How one identifier is spelled in the raw tables.
SPELLINGS = {"permno": ("PERMNO", "permno", "LPERMNO"), "permco": ("PERMCO", "permco", "LPERMCO"), "gvkey": ("GVKEY", "gvkey")}


def finding(counts: DataFrame, name: str, datasets: str, description: str, warn: bool = True) -> DataFrame:
    """counts (affected, total, samples), one row -> finding; the status is ok without affected rows, else warning (info if warn is off)."""
    affected = F.coalesce("affected", F.lit(0)).cast("long")
    status = F.when(affected == 0, "ok").otherwise("warning" if warn else "info")
    return counts.select(
        F.lit(name).alias("check_name"), F.lit(datasets).alias("datasets"), status.alias("status"), affected.alias("affected"),
        F.coalesce("total", F.lit(0)).cast("long").alias("total"), F.lit(description).alias("description"), F.coalesce("samples", F.array().cast("array<string>")).alias("samples"),
    )


def _missing(rows: DataFrame, column: str, known: DataFrame, known_column: str) -> DataFrame:
    """rows with __missing: whether their column is in none of known's rows."""
    ids = known.select(F.col(known_column).alias("__id")).distinct()
    return rows.join(ids, F.col(column) == F.col("__id"), "left").withColumn("__missing", F.col("__id").isNull())


def _found(rows: DataFrame, flag: Column, total: Column, sample: Column) -> DataFrame:
    """One row: affected, total, and the SAMPLES smallest values of sample among the flagged rows, as text."""
    samples = smallest(rows.where(flag), sample, SAMPLES).select(F.transform("samples", lambda v: v.cast("string")).alias("samples"))
    return rows.agg(F.count_if(flag).alias("affected"), total.alias("total")).crossJoin(samples)


def delisting_in_panel(panel: DataFrame, delisting: DataFrame) -> DataFrame:
    found = _found(_missing(delisting, "PERMNO", panel, "PERMNO"), F.col("__missing"), F.count(F.lit(1)), F.col("PERMNO"))
    return finding(found, "delisting_permno_in_crsp_monthly", "crsp_delisting,crsp_monthly_stock", "delisting rows whose PERMNO the monthly table lacks")


def delisting_returns(delisting: DataFrame) -> DataFrame:
    found = _found(delisting, F.col("DelRet").isNull(), F.count(F.lit(1)), F.col("PERMNO"))
    return finding(found, "delisting_missing_delret", "crsp_delisting", "delisting rows without a delisting return")


def delisting_successors(panel: DataFrame, delisting: DataFrame) -> DataFrame:
    rows = _missing(delisting.where("DelPERMNO <> 0"), "DelPERMNO", panel, "PERMNO")
    found = _found(rows, F.col("__missing"), F.count(F.lit(1)), F.col("DelPERMNO"))
    return finding(found, "delisting_successor_permno_in_crsp_monthly", "crsp_delisting,crsp_monthly_stock", "successor securities that the monthly table lacks")


def missing_delistings(panel: DataFrame, delisting: DataFrame, months: int = 6) -> DataFrame:
    """Securities whose last month lies more than `months` before the table's last one, without a delisting row."""
    last = panel.groupBy("PERMNO").agg(F.max("MthCalDt").alias("last"))
    end = panel.agg(F.max("MthCalDt").alias("end"))  # one row
    gone = last.crossJoin(F.broadcast(end)).where(F.col("last") < F.add_months("end", -months))
    rows = _missing(gone.withColumnRenamed("PERMNO", "entity"), "entity", delisting, "PERMNO")
    found = _found(rows, F.col("__missing"), F.count(F.lit(1)), F.col("entity"))
    return finding(found, "possible_missing_delisting_records", "crsp_monthly_stock,crsp_delisting", f"securities without a month in the last {months} and without a delisting row")


def _coverage(links: DataFrame, key: str, known: DataFrame, known_key: str, date: str, name: str, datasets: str) -> DataFrame:
    """Linked entities that a table lacks, except those whose links all ended before the table's first date."""
    start = known.agg(F.min(date).alias("start"))  # one row
    # An open link never ends.
    ends = links.groupBy(key).agg(F.max("LINKENDDT").alias("end"), F.max(F.col("LINKENDDT").isNull()).alias("open"))
    rows = _missing(ends.where(F.col(key).isNotNull()).withColumnRenamed(key, "entity"), "entity", known, known_key).where("__missing").crossJoin(F.broadcast(start))
    unexplained = F.col("open") | ~F.coalesce(F.col("end") < F.col("start"), F.lit(False))
    return finding(_found(rows, unexplained, F.count(F.lit(1)), F.col("entity")), name, datasets, "linked entities that the table lacks although their links reach its first date; total: all that it lacks")


def link_permnos(links: DataFrame, panel: DataFrame) -> DataFrame:
    return _coverage(links, "LPERMNO", panel, "PERMNO", "MthCalDt", "ccm_lpermno_in_crsp_monthly", "ccm_link_table,crsp_monthly_stock")


def link_gvkeys(links: DataFrame, annual: DataFrame) -> DataFrame:
    return _coverage(links, "gvkey", annual, "GVKEY", "datadate", "ccm_gvkey_in_compustat", "ccm_link_table,compustat_fundamentals_annual")


def annual_links(links: DataFrame, annual: DataFrame) -> DataFrame:
    rows = _missing(annual.select(F.col("GVKEY").alias("entity")).distinct(), "entity", links, "gvkey")
    found = _found(rows, F.col("__missing"), F.count(F.lit(1)), F.col("entity"))
    return finding(found, "compustat_gvkey_in_ccm", "compustat_fundamentals_annual,ccm_link_table", "fundamentals entities without any link row")


def link_overlaps(links: DataFrame) -> DataFrame:
    """(gvkey, LIID) groups in which a link ends after the next one, by start, begins. Only neighbours are compared."""
    w = Window.partitionBy("gvkey", "LIID").orderBy("LINKDT", F.coalesce("LINKENDDT", F.lit("2099-12-31").cast("date")))
    end = F.coalesce("LINKENDDT", F.lit("2099-12-31").cast("date"))
    rows = links.withColumn("__over", F.coalesce(end > F.lead("LINKDT").over(w), F.lit(False)))
    groups = rows.groupBy("gvkey", "LIID").agg(F.max("__over").alias("over"))
    label = F.concat(F.lit("gvkey="), F.col("gvkey").cast("string"), F.lit(", LIID="), F.col("LIID"))
    return finding(_found(groups, F.col("over"), F.count(F.lit(1)), label), "ccm_link_period_overlaps", "ccm_link_table", "(gvkey, LIID) groups with overlapping windows")


def factor_months(factors: DataFrame, panel: DataFrame) -> DataFrame:
    """Calendar months of the panel that the factor table lacks."""
    months = panel.select(F.date_format("MthCalDt", "yyyy-MM").alias("month")).distinct()
    known = factors.select(F.date_format("dateff", "yyyy-MM").alias("known"))
    found = _found(_missing(months, "month", known, "known"), F.col("__missing"), F.count(F.lit(1)), F.col("month"))
    return finding(found, "fama_french_month_coverage", "fama_french_5f_momentum_monthly,crsp_monthly_stock", "months of the monthly table that the factor table lacks")


def identifier_spellings(tables: dict[str, DataFrame]) -> DataFrame:
    """Identifiers that are spelled differently across the tables at hand; a note, not a warning."""
    spark = next(iter(tables.values())).sparkSession
    seen = {c for t in tables.values() for c in t.columns}
    mixed = sorted(k for k, names in SPELLINGS.items() if len(seen.intersection(names)) > 1)
    counts = spark.createDataFrame([(len(mixed), len(SPELLINGS), mixed)], "affected long, total long, samples array<string>")
    return finding(counts, "identifier_naming_consistency", ",".join(sorted(tables)), "identifiers whose column names differ across tables", warn=False)


def all_findings(t: dict[str, DataFrame]) -> DataFrame:
    """All checks, one row each. t: the six tables by name, dates parsed, open links with a null end."""
    panel, delisting, links = t["crsp_monthly_stock"], t["crsp_delisting"], t["ccm_link_table"]
    annual, factors = t["compustat_fundamentals_annual"], t["fama_french_5f_momentum_monthly"]
    parts = [
        delisting_in_panel(panel, delisting), delisting_returns(delisting), delisting_successors(panel, delisting), missing_delistings(panel, delisting), link_permnos(links, panel),
        link_gvkeys(links, annual), annual_links(links, annual), link_overlaps(links), factor_months(factors, panel), identifier_spellings(t),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out

"""The registered queries of the panel operators, with SQL where SQL can express them."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from itertools import combinations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelforge.operators import asof, checks, cleaning, crosssection, diagnostics, features, ic, integrity, models, panel, performance, portfolio, profiling, targets
from panelforge.plans import oracle as O
from panelforge.plans import pipelines
from panelforge.plans.relations import by_raw_name, ctes, relations
from panelforge.sources.io import date_counts, read_interim, read_table, write_raw, write_table
from panelforge.sources.schema import DATASETS
from panelforge.sources.shared import materialize, shared_dir

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}
#: The supplied tables have 83 months, so the first training window is shorter than the default.
CONFIG = targets.ModelConfig(min_train=36)
#: Relations that the panel reads several times.
WRITTEN = ("crsp", "fund", "delist", "factors")
#: Features of the monthly regressions (M9): they need prices and returns alone, so that many rows are complete.
MODEL_FEATURES = ["mom_1m", "mom_3m", "vol_12m", "liquidity_share_turnover", "size_log_mktcap"]


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


#: Decimals of doubles in results.
DIGITS = 6


def shown(df: DataFrame, digits: int | None = DIGITS) -> DataFrame:
    """Dates as text, counts and flags as bigint (double where they may be null), doubles rounded (None: they are already): the form in which results are compared."""
    out = []
    for c, kind in df.dtypes:
        x = F.col(f"`{c}`")
        if kind == "date":
            x = x.cast("string")
        elif c in O.NULLABLE:
            x = x.cast("double")
        elif kind in ("boolean", "int", "bigint", "smallint"):
            x = x.cast("long")
        elif kind == "double" and digits is not None:
            x = F.round(x, 3 if c in O.COARSE else digits) + F.lit(0.0)
        out.append(x.alias(c))
    return df.select(*out)


def _master(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, dict[str, DataFrame]]:
    t = by_raw_name(relations(spark, sf_dir, WRITTEN))
    return panel.master_panel(t), t


def _ready(spark: SparkSession, sf_dir: str) -> DataFrame:
    master, t = _master(spark, sf_dir)
    return features.prepared(master, t["compustat_fundamentals_annual"])


def _raw(spark: SparkSession, sf_dir: str, families: tuple[str, ...] = tuple(features.FAMILIES)) -> DataFrame:
    master, t = _master(spark, sf_dir)
    return features.raw_features(master, t["compustat_fundamentals_annual"], families)


# ---- scans, cleaning, profiles

_DATES = """
select case when l_orderkey % 7 = 0 then 'E' when l_orderkey % 11 = 0 then '' when l_orderkey % 13 = 0 then 'bad' || cast(l_linenumber as {text})
  when l_orderkey % 5 = 0 then replace(cast(cast(l_shipdate as date) as {text}), '-', '') else cast(cast(l_shipdate as date) as {text}) end as raw from {lineitem}"""


@query(f"""with d as ({_DATES.format(text="varchar", lineitem="lineitem")}),
p as (select raw, coalesce(try_strptime(trim(raw), '%Y-%m-%d'), try_strptime(trim(raw), '%Y%m%d')) as parsed from d)
select 'raw' as "column", cast(count(*) filter (where parsed is not null) as bigint) as n_valid, cast(count(*) filter (where raw = 'E') as bigint) as n_sentinel,
  cast(count(*) filter (where parsed is null and raw <> 'E' and raw <> '') as bigint) as n_invalid, cast(cast(min(parsed) as date) as varchar) as min_date, cast(cast(max(parsed) as date) as varchar) as max_date,
  (select string_agg(v, ',' order by v) from (select distinct raw as v from p where parsed is null and raw not in ('E', '') order by 1 limit 5)) as invalid_samples from p""")
def io2_parse_dates(spark, sf_dir):
    raw = spark.sql(_DATES.replace("{text}", "string"), lineitem=spark.read.parquet(f"{sf_dir}/lineitem.parquet"))
    return shown(date_counts(raw, "raw", ["E"], ("yyyy-MM-dd", "yyyyMMdd"))).withColumn("invalid_samples", F.array_join("invalid_samples", ","))


@query("""select cast(count(*) as bigint) as rows_in, cast(count(distinct (l_suppkey, l_linenumber, l_quantity, l_returnflag)) as bigint) as rows_out,
  cast(count(*) - count(distinct (l_suppkey, l_linenumber, l_quantity, l_returnflag)) as bigint) as rows_dropped from lineitem""")
def cl1_exact_duplicates(spark, sf_dir):
    return shown(cleaning.cleaning_summary(spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_suppkey", "l_linenumber", "l_quantity", "l_returnflag")))


_PARTLY = "select l_orderkey, l_linenumber, case when l_partkey % 3 <> 0 then l_partkey end as l_partkey, l_suppkey, case when l_quantity > 10 then l_quantity end as l_quantity, case when l_suppkey % 4 <> 0 then l_extendedprice end as l_extendedprice from {lineitem}"


@query(f"""with d as ({_PARTLY.format(lineitem="lineitem")}),
r as (select *, row_number() over (partition by l_orderkey, l_linenumber order by (l_partkey is null)::int + (l_quantity is null)::int + (l_extendedprice is null)::int,
  l_partkey nulls last, l_suppkey nulls last, l_quantity nulls last, l_extendedprice nulls last) as rn from d)
select {O.shown(ints="l_orderkey l_linenumber l_partkey l_suppkey", doubles="l_quantity l_extendedprice")} from r where rn = 1""")
def cl2_resolve_duplicate_keys(spark, sf_dir):
    df = spark.sql(_PARTLY, lineitem=spark.read.parquet(f"{sf_dir}/lineitem.parquet"))
    return shown(cleaning.resolve_duplicate_keys(df, ["l_orderkey", "l_linenumber"]))


@query("""select cast(sum(n) as bigint) as rows_in, cast(count(*) as bigint) as rows_out, cast(count(*) filter (where n > 1) as bigint) as duplicate_groups, cast(sum(n) - count(*) as bigint) as rows_dropped
from (select count(*) as n from lineitem group by l_orderkey, l_linenumber)""")
def cl2_duplicate_summary(spark, sf_dir):
    return shown(cleaning.duplicate_summary(spark.read.parquet(f"{sf_dir}/lineitem.parquet"), ["l_orderkey", "l_linenumber"]))


_PROFILED = {"o_orderkey": "bigint", "o_orderstatus": "string", "o_orderpriority": "string"}


@query(" union all ".join(
    f"""select '{c}' as "column", '{t}' as dtype, cast({i} as bigint) as position, cast(count(*) as bigint) as rows, cast(count(*) - count({c}) as bigint) as nulls,
round(100.0 * (count(*) - count({c})) / count(*), 4) + 0.0 as null_pct, cast(count(distinct {c}) as bigint) as "distinct", min(cast({c} as varchar)) as smallest
from (select case when o_orderkey % 9 <> 0 then o_orderkey end as o_orderkey, o_orderstatus, case when o_custkey % 4 <> 0 then o_orderpriority end as o_orderpriority from orders)"""
    for i, (c, t) in enumerate(_PROFILED.items())
))
def pr1_profile_columns(spark, sf_dir):
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    o = o.select(F.when(F.col("o_orderkey") % 9 != 0, F.col("o_orderkey")).alias("o_orderkey"), "o_orderstatus", F.when(F.col("o_custkey") % 4 != 0, F.col("o_orderpriority")).alias("o_orderpriority"))
    return shown(profiling.profile_columns(o))


@query("""select * from (
select 'o_orderstatus' as "column", (select string_agg(v, ',' order by v) from (select distinct o_orderstatus as v from orders order by 1 limit 5)) as samples
union all select 'o_orderpriority', (select string_agg(v, ',' order by v) from (select distinct o_orderpriority as v from orders order by 1 limit 5)))""")
def pr1_column_samples(spark, sf_dir):
    return profiling.column_samples(spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderstatus", "o_orderpriority")).withColumn("samples", F.array_join("samples", ","))


def _key_sql(table: str, columns: list[str], longest: int = 3) -> str:
    """The first smallest combination without duplicates, by exact counts of all."""
    combos = [c for k in range(1, longest + 1) for c in combinations(columns, k)]
    counts = " union all ".join(f"select {i} as i, '{','.join(c)}' as key_columns, count(distinct ({', '.join(c)}, 1)) as d, count(*) as n from t" for i, c in enumerate(combos))
    return f"with t as ({table}), c as ({counts}) select (select key_columns from c where d = n order by i limit 1) as key_columns"


@query(_key_sql("select o_orderstatus, o_custkey, o_orderkey from orders", ["o_orderstatus", "o_custkey", "o_orderkey"]))
def pr3_suggest_key(spark, sf_dir):
    key = profiling.suggest_key(spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderstatus", "o_custkey", "o_orderkey"))
    return spark.createDataFrame([(",".join(key) if key is not None else None,)], "key_columns string")


_MONTHLY = ["PERMNO", "MthRetFlg", "ShrOut", "MthCalDt"]


@query(f"with {ctes('crsp')}, t0 as (select * from crsp), " + _key_sql("select PERMNO, MthRetFlg, ShrOut, MthCalDt from t0", _MONTHLY).removeprefix("with "))
def pr3_suggest_key_of_two_columns(spark, sf_dir):
    """No column of the monthly table is a key by itself."""
    key = profiling.suggest_key(relations(spark, sf_dir)["crsp"].select(*_MONTHLY))
    return spark.createDataFrame([(",".join(key) if key is not None else None,)], "key_columns string")


@query("""with f as (select l_orderkey, l_linenumber, l_returnflag, l_linestatus, count(*) as n from lineitem group by all),
k as (select l_orderkey, l_linenumber, sum(n) as n, sum(case when n > 1 then n else 0 end) as exact from f group by 1, 2)
select 'l_orderkey,l_linenumber' as key_columns, 'declared' as key_source, cast(sum(n) as bigint) as rows, cast(coalesce(sum(case when n > 1 then n end), 0) as bigint) as duplicate_key_rows,
  cast(sum(n - 1) as bigint) as excess_rows, cast(coalesce(sum(case when n > 1 then exact end), 0) as bigint) as exact_rows,
  cast(coalesce(sum(case when n > 1 then n - exact end), 0) as bigint) as conflicting_rows from k""")
def pr4_profile_duplicates(spark, sf_dir):
    df = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_orderkey", "l_linenumber", "l_returnflag", "l_linestatus")
    return shown(profiling.profile_duplicates(df, ("l_orderkey", "l_linenumber")))


# ---- integrity

def _finding_sql(name: str, datasets: str, body: str, key: str, warn: str = "warning") -> str:
    """body: rows (flag, v); key: how v is ordered."""
    return f"""select '{name}' as check_name, '{datasets}' as datasets, case when count(*) filter (where flag) = 0 then 'ok' else '{warn}' end as status, cast(count(*) filter (where flag) as bigint) as affected,
cast(count(*) as bigint) as total, coalesce((select string_agg(cast(v as varchar), '|' order by v) from (select distinct v from ({body}) where flag order by v limit 10)), '') as samples from ({body})"""


_IC = [
    _finding_sql("delisting_permno_in_crsp_monthly", "crsp_delisting,crsp_monthly_stock", "select PERMNO not in (select PERMNO from crsp) as flag, PERMNO as v from delist", "v"),
    _finding_sql("delisting_missing_delret", "crsp_delisting", "select DelRet is null as flag, PERMNO as v from delist", "v"),
    _finding_sql("delisting_successor_permno_in_crsp_monthly", "crsp_delisting,crsp_monthly_stock", "select DelPERMNO not in (select PERMNO from crsp) as flag, DelPERMNO as v from delist where DelPERMNO <> 0", "v"),
    _finding_sql("possible_missing_delisting_records", "crsp_monthly_stock,crsp_delisting", "select PERMNO not in (select PERMNO from delist) as flag, PERMNO as v from (select PERMNO, max(MthCalDt) as m from crsp group by 1) where m < (select max(MthCalDt) from crsp) - interval 6 month", "v"),
    _finding_sql("ccm_lpermno_in_crsp_monthly", "ccm_link_table,crsp_monthly_stock", "select max(coalesce(LINKENDDT, date '2099-12-31')) >= (select min(MthCalDt) from crsp) as flag, LPERMNO as v from links where LPERMNO not in (select PERMNO from crsp) group by LPERMNO", "v"),
    _finding_sql("ccm_gvkey_in_compustat", "ccm_link_table,compustat_fundamentals_annual", "select max(coalesce(LINKENDDT, date '2099-12-31')) >= (select min(datadate) from fund) as flag, gvkey as v from links where gvkey not in (select GVKEY from fund) group by gvkey", "v"),
    _finding_sql("compustat_gvkey_in_ccm", "compustat_fundamentals_annual,ccm_link_table", "select GVKEY not in (select gvkey from links) as flag, GVKEY as v from (select distinct GVKEY from fund)", "v"),
    _finding_sql("ccm_link_period_overlaps", "ccm_link_table", "select bool_or(coalesce(e > nxt, false)) as flag, 'gvkey=' || gvkey || ', LIID=' || LIID as v from (select gvkey, LIID, coalesce(LINKENDDT, date '2099-12-31') as e, lead(LINKDT) over (partition by gvkey, LIID order by LINKDT, coalesce(LINKENDDT, date '2099-12-31')) as nxt from links) group by gvkey, LIID", "v"),
    _finding_sql("fama_french_month_coverage", "fama_french_5f_momentum_monthly,crsp_monthly_stock", "select m not in (select strftime(dateff, '%Y-%m') from factors) as flag, m as v from (select distinct strftime(MthCalDt, '%Y-%m') as m from crsp)", "v"),
    "select 'identifier_naming_consistency', 'ccm_link_table,compustat_fundamentals_annual,crsp_delisting,crsp_monthly_stock,fama_french_5f_momentum_monthly', case when count(*) = 0 then 'ok' else 'info' end, cast(count(*) as bigint), "
    f"cast({len(integrity.SPELLINGS)} as bigint), coalesce(string_agg(k, '|' order by k), '') from (select k from (" + " union all ".join(f"select '{k}' as k, unnest([{', '.join(map(repr, v))}]) as c" for k, v in integrity.SPELLINGS.items())
    + ") s where c in (" + " union all ".join(f"select unnest(json_keys(to_json(r))) from (select * from {t} limit 1) r" for t in ("crsp", "fund", "links", "delist", "factors")) + ") group by k having count(distinct c) > 1)",
]


@query(f"with {ctes('crsp', 'fund', 'links', 'delist', 'factors')}\n" + "\nunion all\n".join(_IC))
def ic_all_findings(spark, sf_dir):
    found = integrity.all_findings(by_raw_name(relations(spark, sf_dir)))
    return shown(found.drop("description").withColumn("samples", F.array_join("samples", "|")))


# ---- joins and the panel

@query(f"with {ctes('crsp', 'links')},{O.LINKED}\nselect {O.shown('MthCalDt', 'PERMNO gvkey')}, cast(gvkey is not null as bigint) as link_matched from linked")
def j1_link_entities(spark, sf_dir):
    t = relations(spark, sf_dir)
    return shown(asof.link_entities(t["crsp"], t["links"]).select("MthCalDt", "PERMNO", "gvkey", "link_matched"))


@query(f"with {ctes('crsp', 'fund', 'links')},{O.LINKED},{O.ATTACHED}\nselect {O.shown('MthCalDt cst_available_date', 'PERMNO gvkey cst_age_months cst_expired', 'cst_revt cst_ni cst_xint')} from attached")
def j2_attach_annual(spark, sf_dir):
    t = relations(spark, sf_dir)
    out = asof.attach_annual(asof.link_entities(t["crsp"], t["links"]), t["fund"], panel.value_columns(t["fund"]))
    return shown(out.select("MthCalDt", "cst_available_date", "PERMNO", "gvkey", "cst_age_months", "cst_expired", "cst_revt", "cst_ni", "cst_xint"))


@query(f"""with {ctes("crsp", "factors")}
select {O.shown("MthCalDt", "PERMNO", "ff_mktrf ff_smb ff_umd")} from (select c.*, mktrf as ff_mktrf, smb as ff_smb, umd as ff_umd from crsp c left join factors f on date_trunc('month', MthCalDt) = date_trunc('month', dateff))""")
def j3_attach_factors(spark, sf_dir):
    t = relations(spark, sf_dir)
    return shown(asof.attach_factors(t["crsp"], t["factors"]).select("MthCalDt", "PERMNO", "ff_mktrf", "ff_smb", "ff_umd"))


@query(O.master_sql(f"select {O.shown('MthCalDt', 'PERMNO is_last_obs is_delisted delisting_return_missing', 'DelRet ret_adj')} from master"))
def p1_delisting_returns(spark, sf_dir):
    t = relations(spark, sf_dir)
    return shown(panel.delisting_returns(t["crsp"], t["delist"]).select("MthCalDt", "PERMNO", "is_last_obs", "is_delisted", "delisting_return_missing", "DelRet", "ret_adj"))


_MASTER_INTS = "PERMNO ShrOut SICCD gvkey cst_age_months cst_expired is_last_obs is_delisted delisting_return_missing"
_MASTER_DOUBLES = "MthPrc MthVol MthCap MthRet ret_adj cst_seq cst_lt cst_oancf cst_ppent ff_mktrf ff_cma"


@query(O.master_sql(f"select {O.shown('MthCalDt cst_available_date', _MASTER_INTS, _MASTER_DOUBLES, 'MthRetFlg')} from master"))
def p2_master_panel(spark, sf_dir):
    return shown(_master(spark, sf_dir)[0].select("MthCalDt", "cst_available_date", *_MASTER_INTS.split(), *_MASTER_DOUBLES.split(), "MthRetFlg"))


_VALUES = [f"cst_{c}" for c in O.ITEMS]


@query(O.master_sql(f"""select cast(count(*) as bigint) as rows, {", ".join(f"round(100.0 * avg(cast(coalesce({e}, false) as int)), 4) + 0.0 as {n}" for n, e in
    {"pct_gvkey": "gvkey is not null", "pct_usable": f"coalesce({', '.join(f'case when {v} is not null then 1 end' for v in _VALUES)}) is not null", "pct_expired": "cst_expired", "pct_factor": "ff_mktrf is not null",
     **{f"null_{v}": f"{v} is null" for v in _VALUES}}.items())},
cast(count(*) filter (where is_delisted) as bigint) as delisted, cast(count(*) filter (where delisting_return_missing) as bigint) as delisting_return_missing,
cast(count(distinct (PERMNO, MthCalDt)) as bigint) as unique_keys, cast((select count(*) from (select 1 from master group by PERMNO, MthCalDt having count(*) > 1)) as bigint) as duplicate_keys from master"""))
def p3_merge_diagnostics(spark, sf_dir):
    return shown(panel.merge_diagnostics(_master(spark, sf_dir)[0]), 4)


@query(O.master_sql("""select cast(year(MthCalDt) as bigint) as year, cast(count(distinct PERMNO) as bigint) as firms, cast(count(distinct case when gvkey is not null then PERMNO end) as bigint) as with_gvkey,
cast(count(distinct case when cst_available_date is not null and not cst_expired then PERMNO end) as bigint) as with_fundamentals from master group by 1"""))
def p4_firm_coverage(spark, sf_dir):
    return shown(panel.firm_coverage(_master(spark, sf_dir)[0]))


_READY = "mktcap_millions dollar_volume_millions at_proxy book_equity total_debt enterprise_value net_debt cst_at_proxy_growth cst_revt_growth cst_seq_growth"


@query(O.ready_sql(f"select {O.shown('MthCalDt', 'PERMNO shares_outstanding_actual has_fundamentals is_investable', _READY)} from ready"))
def p5_to_p10_prepared_panel(spark, sf_dir):
    return shown(_ready(spark, sf_dir).select("MthCalDt", "PERMNO", "shares_outstanding_actual", "has_fundamentals", "is_investable", *_READY.split()))


@query(f"with {ctes('fund')}, av as (select *, datadate as available from fund),{O.GROWTH}\nselect {O.shown('datadate', 'GVKEY', 'at_proxy_growth revt_growth capx_growth invt_growth rect_growth ppent_growth seq_growth')} from grown")
def p7_growth_table(spark, sf_dir):
    return shown(panel.growth_table(relations(spark, sf_dir)["fund"]))


# ---- features

def _family_of(category: str) -> list[str]:
    return [f.name for f in features.REGISTRY if f.category == category or (category == "momentum" and f.category == "reversal")]


for _name in features.FAMILIES:
    def _run(spark, sf_dir, _name=_name):
        return shown(_raw(spark, sf_dir, (_name,)).select("MthCalDt", "PERMNO", *_family_of(_name)))

    _run.__name__ = f"f_{_name}_features"
    query(O.raw_sql(f"select {O.shown('MthCalDt', 'PERMNO', ' '.join(_family_of(_name)))} from raw", _family_of(_name)))(_run)


@query(O.raw_sql(f"select {O.shown('MthCalDt', 'PERMNO gvkey is_investable has_fundamentals', 'ret_adj ' + ' '.join(features.NAMES))} from raw", list(features.NAMES)))
def p13_raw_features(spark, sf_dir):
    return shown(_raw(spark, sf_dir))




# ---- cross-sections

_X = ["liquidity_amihud_illiq", "mom_1m", "vol_12m", "value_bm"]
_CLIPPED = ", ".join(f"case when {c} is not null then case when n_{c} >= 10 then least(greatest({c}, lo_{c}), hi_{c}) else {c} end end as {c}" for c in _X)
_BOUNDS = f"""
bounds as (select MthCalDt, {", ".join(f"count({c}) filter (where is_investable) as n_{c}, quantile_cont({c}, 0.01) filter (where is_investable) as lo_{c}, quantile_cont({c}, 0.99) filter (where is_investable) as hi_{c}" for c in _X)} from raw group by 1),
clipped as (select PERMNO, raw.MthCalDt, is_investable, {_CLIPPED} from raw join bounds b on raw.MthCalDt = b.MthCalDt)"""


def _ranks(table: str, columns: list[str]) -> str:
    inside = "case when is_investable then {c} end"
    parts = []
    for c in columns:
        x = inside.format(c=c)
        rank = f"rank() over (partition by MthCalDt, ({x}) is null order by {x})"
        same = f"count(*) over (partition by MthCalDt, {x})"
        parts.append(f"case when {x} is not null then ({rank} + ({same} - 1) / 2.0) / count({x}) over (partition by MthCalDt) * 2 - 1 end as {c}")
    return f"select PERMNO, MthCalDt, {', '.join(parts)} from {table}"


def _by_month(spark: SparkSession, sf_dir: str, f) -> DataFrame:
    raw = _raw(spark, sf_dir)
    return shown(raw.select("MthCalDt", "PERMNO", *(f(F.col(c), ["MthCalDt"], F.col("is_investable")).alias(c) for c in _X)))


@query(O.raw_sql(f"select {O.shown('MthCalDt', 'PERMNO', ' '.join(_X))} from clipped", _X, _BOUNDS))
def x1_winsorize_by_month(spark, sf_dir):
    return _by_month(spark, sf_dir, crosssection.winsorized)


@query(O.raw_sql(f"select {O.shown('MthCalDt', 'PERMNO', ' '.join(_X))} from ({_ranks('raw', _X)})", _X))
def x2_rank_by_month(spark, sf_dir):
    return _by_month(spark, sf_dir, crosssection.ranked)


_Z = "case when is_investable then {c} end"
@query(O.raw_sql(f"select {O.shown('MthCalDt', 'PERMNO', ' '.join(_X))} from (select PERMNO, MthCalDt, " + ", ".join(
    f"({_Z.format(c=c)} - avg({_Z.format(c=c)}) over m) / case when stddev_samp({_Z.format(c=c)}) over m > 0 then stddev_samp({_Z.format(c=c)}) over m end as {c}" for c in _X) + " from raw window m as (partition by MthCalDt))", _X))
def x3_zscore_by_month(spark, sf_dir):
    return _by_month(spark, sf_dir, crosssection.standardized)


@query(O.raw_sql(f"select {O.shown('MthCalDt', 'PERMNO', ' '.join(_X))} from ({_ranks('clipped', _X)})", _X, _BOUNDS))
def x4_model_ready_columns(spark, sf_dir):
    raw = _raw(spark, sf_dir).withColumns({c: crosssection.winsorized(F.col(c), ["MthCalDt"], F.col("is_investable")) for c in _X})
    return shown(raw.select("MthCalDt", "PERMNO", *(crosssection.ranked(F.col(c), ["MthCalDt"], F.col("is_investable")).alias(c) for c in _X)))


_ALL = list(features.NAMES)
#: CTEs after raw: all features in long form, winsorized and rank-scaled by month over the universe.
_SCALED = f"""
cells as (select * from (select PERMNO, MthCalDt, is_investable, {', '.join(f'cast({c} as double) as {c}' for c in _ALL)} from raw) unpivot (value for feature in ({', '.join(_ALL)}))),
b as (select feature, MthCalDt, count(value) filter (where is_investable) as n, quantile_cont(value, 0.01) filter (where is_investable) as lo, quantile_cont(value, 0.99) filter (where is_investable) as hi from cells group by 1, 2),
scaled as (select PERMNO, MthCalDt, feature, v from (
select *, case when x is not null then (rank() over (partition by feature, MthCalDt, x is null order by x) + (count(*) over (partition by feature, MthCalDt, x) - 1) / 2.0) / count(x) over (partition by feature, MthCalDt) * 2 - 1 end as v
from (select c.*, case when is_investable then case when n >= 10 then least(greatest(value, lo), hi) else value end end as x from cells c join b on c.feature = b.feature and c.MthCalDt = b.MthCalDt)) where v is not null)"""


@query(O.raw_sql("select cast(MthCalDt as varchar) as MthCalDt, PERMNO, feature, round(v, 6) + 0.0 as value from scaled", _ALL, _SCALED))
def x5_model_ready_features(spark, sf_dir):
    ready = crosssection.model_ready(_raw(spark, sf_dir), list(features.KEYS), _ALL, DIGITS)
    return shown(crosssection.long_form(ready, ["MthCalDt", "PERMNO"], _ALL).where("value is not null"), None)


_IN = "case when is_investable then value end"
_CLIPPED_CELLS = "(select c.PERMNO, c.MthCalDt, c.feature, is_investable, case when n >= 10 then least(greatest(value, lo), hi) else value end as value from cells c join b on c.feature = b.feature and c.MthCalDt = b.MthCalDt)"
_ZSCORE = f"(value - avg({_IN}) over m) / case when stddev_samp({_IN}) over m > 0 then stddev_samp({_IN}) over m end"
_RANK = f"(rank() over (partition by feature, MthCalDt, {_IN} is null order by {_IN}) + (count(*) over (partition by feature, MthCalDt, {_IN}) - 1) / 2.0) / count({_IN}) over m * 2 - 1"


def _scaled_sql(value: str, cells: str = "cells") -> str:
    scaled = f"select PERMNO, MthCalDt, feature, {value} as value, {_IN} as own from {cells} window m as (partition by feature, MthCalDt)"
    return O.raw_sql(f"select {O.shown('MthCalDt', 'PERMNO', 'value', 'feature')} from ({scaled}) where own is not null and value is not null", _ALL, _SCALED)


def _all_by_month(spark: SparkSession, sf_dir: str, *steps) -> DataFrame:
    """Scalings of all 51 features one after another, in long form at the end: one shuffle by month. Months are rounded in columns, as Spark's round goes by way of text for each cell."""
    done = crosssection.scaled(_raw(spark, sf_dir), ["PERMNO", "MthCalDt", "is_investable"], _ALL, steps, DIGITS)
    return shown(crosssection.long_form(done, ["MthCalDt", "PERMNO"], _ALL).where("value is not null"), None)


@query(_scaled_sql(_ZSCORE, _CLIPPED_CELLS))
def x1_x3_winsorized_zscore_all_features(spark, sf_dir):
    return _all_by_month(spark, sf_dir, crosssection.winsorized_values, crosssection.standardized_values)


@query(_scaled_sql(_RANK))
def x2_rank_all_features(spark, sf_dir):
    return _all_by_month(spark, sf_dir, crosssection.ranked_values)


@query(_scaled_sql(_ZSCORE))
def x3_zscore_all_features(spark, sf_dir):
    return _all_by_month(spark, sf_dir, crosssection.standardized_values)


# ---- diagnostics

_D = ["mom_1m", "vol_12m", "value_bm", "size_log_mktcap", "quality_roa"]
_DSELECT: dict[str, str] = {}


def _d(name: str, select: str, columns: list[str] = _D) -> str:
    _DSELECT[name] = select
    return O.raw_sql(select, columns, f"cells as (select * from (select MthCalDt, {', '.join(f'cast({c} as double) as {c}' for c in columns)} from raw) unpivot include nulls (value for \"column\" in ({', '.join(columns)})))")


@query(_d("d1_d2_coverage", """select "column", cast(count(*) as bigint) as rows, cast(count(value) as bigint) as non_null, round(100.0 * count(value) / count(*), 6) + 0.0 as pct_non_null, round(100 - 100.0 * count(value) / count(*), 6) + 0.0 as pct_missing from cells group by 1"""))
def d1_d2_coverage(spark, sf_dir):
    return shown(diagnostics.coverage(_raw(spark, sf_dir), _D))


@query(_d("d3_coverage_over_time", """select period, "column", round(100.0 * count(value) / count(*), 6) + 0.0 as pct_non_null from (select cast(year(MthCalDt) as varchar) as period, "column", value from cells union all select strftime(MthCalDt, '%Y-%m'), "column", value from cells) group by 1, 2"""))
def d3_coverage_over_time(spark, sf_dir):
    return shown(diagnostics.coverage_by_year_and_month(_raw(spark, sf_dir), _D))


@query(_d("d4_distributions", """select "column", cast(count(value) as bigint) as n, round(avg(value), 6) + 0.0 as mean, round(stddev_samp(value), 6) + 0.0 as std, round(min(value), 6) + 0.0 as min, """ + ", ".join(
    f"round(quantile_cont(value, {p}), 6) + 0.0 as p{int(p * 100):02d}" for p in diagnostics.QUANTILES) + """, round(max(value), 6) + 0.0 as max from cells where value is not null group by 1"""))
def d4_distributions(spark, sf_dir):
    return shown(diagnostics.distributions(_raw(spark, sf_dir), _D))


def _corr(columns: list[str]) -> str:
    names = ", ".join(columns)
    cells = f"""cells as (select PERMNO, MthCalDt, c, value, list_position([{", ".join(map(repr, columns))}], c) as i
  from (select * from (select PERMNO, MthCalDt, {", ".join(f"cast({c} as double) as {c}" for c in columns)} from raw) unpivot (value for c in ({names}))))"""
    pairs = f"select x.a, y.b from (select unnest([{', '.join(map(repr, columns))}]) as a, unnest(range({len(columns)})) as i) x join (select unnest([{', '.join(map(repr, columns))}]) as b, unnest(range({len(columns)})) as j) y on i < j"
    return O.raw_sql("select p.a, p.b, cast(coalesce(n, 0) as bigint) as n, case when sx > 0 and sy > 0 then round(corr, 6) + 0.0 end as corr from pairs p left join found f on p.a = f.a and p.b = f.b", columns,
        f"{cells}, pairs as ({pairs}), found as (select x.c as a, y.c as b, count(*) as n, corr(x.value, y.value) as corr, stddev_pop(x.value) as sx, stddev_pop(y.value) as sy from cells x join cells y on x.PERMNO = y.PERMNO and x.MthCalDt = y.MthCalDt and x.i < y.i group by 1, 2)")


@query(_corr(_D))
def d5_correlations(spark, sf_dir):
    return shown(diagnostics.correlations(_raw(spark, sf_dir), _D))


@query(_corr(_ALL))
def d5_correlations_all_features(spark, sf_dir):
    """All 1275 pairs."""
    return shown(diagnostics.correlations(_raw(spark, sf_dir), _ALL))


@query(_d("d6_outliers", """select c."column", cast(count(*) as bigint) as n, round(100 * avg(case when abs(value - m) > 3 * s then 1.0 else 0.0 end), 6) + 0.0 as pct_outlier
from cells c join (select "column", avg(value) as m, stddev_samp(value) as s from cells group by 1) z on c."column" = z."column" where value is not null group by 1"""))
def d6_outliers(spark, sf_dir):
    return shown(diagnostics.outliers(_raw(spark, sf_dir), _D))


@query(_d("d7_stability", """select cast(MthCalDt as varchar) as MthCalDt, "column", round(median(value), 6) + 0.0 as median from cells group by 1, 2"""))
def d7_stability(spark, sf_dir):
    return shown(_stability(spark, sf_dir, _D))


def _stability(spark: SparkSession, sf_dir: str, columns: list[str]) -> DataFrame:
    """diagnostics.stability of the raw features, packed in the pass that makes them."""
    master, t = _master(spark, sf_dir)
    return crosssection.packed_medians(features.raw_features(master, t["compustat_fundamentals_annual"], then=crosssection.packing(columns)), columns)


# The same tables over all features, as the reference's reports have them.
for _name, _table in {"d1_d2_coverage": diagnostics.coverage, "d3_coverage_over_time": diagnostics.coverage_by_year_and_month, "d4_distributions": diagnostics.distributions, "d6_outliers": diagnostics.outliers}.items():
    def _run(spark, sf_dir, _table=_table):
        return shown(_table(_raw(spark, sf_dir), _ALL))

    _run.__name__ = f"{_name}_all_features"
    query(_d(_name, _DSELECT[_name], _ALL))(_run)


@query(_d("d7_stability", _DSELECT["d7_stability"], _ALL))
def d7_stability_all_features(spark, sf_dir):
    return shown(_stability(spark, sf_dir, _ALL))


@query(O.ready_sql("select cast(MthCalDt as varchar) as MthCalDt, cast(count(*) as bigint) as rows, cast(count(*) filter (where is_investable) as bigint) as investable, round(100.0 * count(*) filter (where is_investable) / count(*), 6) + 0.0 as pct_investable from ready group by 1"))
def d8_universe_size(spark, sf_dir):
    return shown(diagnostics.universe_size(_ready(spark, sf_dir)))


_AUDIT = {"price_shares_to_cap": "MthPrc * ShrOut / case when MthCap > 0 then MthCap end", "book_per_share": "cst_seq / case when ShrOut > 0 then ShrOut end"}
@query(O.master_sql(" union all ".join(f"""select '{k}' as "column", cast(count(v) as bigint) as n, round(avg(v), 6) + 0.0 as mean, round(stddev_samp(v), 6) + 0.0 as std, round(min(v), 6) + 0.0 as min, """ + ", ".join(
    f"round(quantile_cont(v, {p}), 6) + 0.0 as p{int(p * 100):02d}" for p in diagnostics.QUANTILES) + f", round(max(v), 6) + 0.0 as max from (select {e} as v from master)" for k, e in _AUDIT.items())))
def d9_unit_audit(spark, sf_dir):
    return shown(diagnostics.unit_audit(_master(spark, sf_dir)[0]))


_TWINS = [(f.twin, f.name) for f in features.REGISTRY if f.twin]


@query(O.raw_sql(" union all ".join(f"select '{a}' as a, '{b}' as b, cast(count(*) as bigint) as n, cast(count(*) filter (where {a} <> {b}) as bigint) as unlike, round(corr({a}, {b}), 6) + 0.0 as corr from raw where {a} is not null and {b} is not null" for a, b in _TWINS), sorted({c for t in _TWINS for c in t})))
def r4_collinear_pairs(spark, sf_dir):
    """The registry's pairs of features of which models take one, and how far their values agree."""
    raw = _raw(spark, sf_dir)
    pairs = features.collinear_pairs(spark)
    cells = [F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(a).alias("x"), F.col(b).alias("y")) for a, b in _TWINS]
    rows = raw.select(F.explode(F.array(*cells)).alias("c")).select("c.*").where("x is not null and y is not null").join(F.broadcast(pairs), ["a", "b"])  # a row for each pair
    return shown(rows.groupBy("a", "b").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("x") != F.col("y")).alias("unlike"), F.corr("x", "y").alias("corr")))


@query(O.raw_sql("select category, cast(count(*) as bigint) as features, cast(sum(n) as bigint) as \"values\" from (" + " union all ".join(f"select '{f.category}' as category, count({f.name}) as n from raw" for f in features.REGISTRY) + ") group by 1", _ALL))
def r1_to_r4_registry_coverage(spark, sf_dir):
    """The registry's categories with the values that the features of each have."""
    seen = diagnostics.coverage(_raw(spark, sf_dir), _ALL).select(F.col("column").alias("name"), "non_null")
    rows = features.registry_table(spark).join(seen, "name")
    return shown(rows.groupBy("category").agg(F.count(F.lit(1)).alias("features"), F.sum("non_null").alias("values")))


# ---- checks

_SOURCES = sorted({c for f in features.REGISTRY for c in f.sources})


def _affected(parts: dict[str, str]) -> str:
    return " union all ".join(f"select '{name}' as check_name, cast(coalesce({n}, 0) as bigint) as affected" for name, n in parts.items())


@query(O.ready_sql(_affected({
    "no_duplicate_permno_month_keys": "(select count(*) - count(distinct (PERMNO, MthCalDt)) from plain)",
    "no_calendar_gaps": "(select count(*) from (select year(MthCalDt) * 12 + month(MthCalDt) as m, lag(year(MthCalDt) * 12 + month(MthCalDt)) over (partition by PERMNO order by MthCalDt) as p from plain) where m - p > 1)",
    "no_infinite_values": f"(select {' + '.join(f'count(case when isinf({c}) then 1 end)' for c in features.NAMES)} from plain)",
    "registry_source_columns_exist": f"(select count(*) from (select unnest([{', '.join(map(repr, _SOURCES))}]) as c) where c not in (select unnest(json_keys(to_json(r))) from (select * from ready limit 1) r))",
    "return_based_features_above_negative_100pct": f"(select {' + '.join(f'count(case when {c} < -1 then 1 end)' for c in checks.RETURN_FEATURES)} from plain)",
    "denominator_handling": f"(select {' + '.join(f'count(case when {f} is not null and ({d} is null or {d} <= 0) then 1 end)' for f, d in checks.DENOMINATORS.items())} from plain)",
}), f"plain as (select *, {', '.join(f'{O.FEATURES[c]} as {c}' for c in features.NAMES)} from ready)"))
def v1_to_v6_table_checks(spark, sf_dir):
    master, t = _master(spark, sf_dir)
    annual, names = t["compustat_fundamentals_annual"], list(features.NAMES)
    raw = materialize(features.raw_features(master, annual, more=tuple(sorted(set(checks.DENOMINATORS.values())))), "checked")  # with the denominators, read by every check
    found = [checks.no_duplicate_keys(raw, ["PERMNO", "MthCalDt"]), checks.no_calendar_gaps(raw), checks.no_infinite_values(raw, names), checks.sources_exist(features.prepared(master, annual)), checks.return_bounds(raw), checks.denominators(raw)]
    return shown(checks.union(found).select("check_name", "affected"))


@query("""select check_name, cast(1 as bigint) as passed, cast(0 as bigint) as affected from (values ('no_leakage_via_truncation'), ('reproducibility'), ('cross_sectional_isolation')) as v(check_name)""")
def v7_to_v12_behaviour_checks(spark, sf_dir):
    """No look-ahead, reproducibility and isolation of all features, at every sampled month. The raw tables are cut, so that the as-of joins are seen too."""
    t, names = by_raw_name(relations(spark, sf_dir, WRITTEN)), list(features.NAMES)
    dates = checks.sampled_dates(t["crsp_monthly_stock"])
    some = t | {"crsp_monthly_stock": t["crsp_monthly_stock"].join(F.broadcast(checks.sampled_entities(t["crsp_monthly_stock"])), "PERMNO", "left_semi")}
    stack = checks.stacked(some, dates)
    built = materialize(features.raw_features(panel.master_panel(stack), stack["compustat_fundamentals_annual"]), "variants")
    raw = materialize(_raw(spark, sf_dir), "raw")
    scaled = lambda d: crosssection.model_ready(d, list(features.KEYS), names)
    return shown(checks.union([checks.variant_checks(built, dates, names), checks.isolated(scaled, raw, dates, names)]).select("check_name", "passed", "affected"))


# ---- targets, folds, models

def _training(spark: SparkSession, sf_dir: str, families: tuple[str, ...] = ("size", "momentum", "liquidity", "volatility")) -> DataFrame:
    raw = materialize(_raw(spark, sf_dir, families), "training-features")  # its keys have what the targets are made of
    return targets.training_panel(raw, raw)


_T = """
t0 as (select *, lead(ret_adj) over (partition by PERMNO order by MthCalDt) as target_raw from raw),
training as (select *, target_raw is not null as target_valid, target_raw - avg(case when is_investable then target_raw end) over (partition by MthCalDt) as target_demeaned from t0)"""
_F = """
usable as (select * from training where is_investable),
months as (select MthCalDt as m, row_number() over (order by MthCalDt) - 1 as i, count(*) over () as n from (select distinct MthCalDt from usable)),
ends as (select unnest(range(35, 2000, 12)) as e),
folds as (select cast((e - 35) / 12 as int) as fold_id, (select m from months where i = 0) as train_start, (select m from months where i = e - 1) as train_end, (select m from months where i = e + 2) as test_start,
  (select m from months where i = least(e + 12, n.n - 1)) as test_end, (select m from months where i = e - 1 - 7 + 1 - 1 - 1) as inner_train_end, (select m from months where i = e - 1 - 7 + 1 + 1) as inner_val_start, (select m from months where i = e - 1) as inner_val_end
  from ends, (select max(n) as n from months) n where e + 2 <= n.n - 1)"""
_P = """
preds as (select PERMNO, MthCalDt, 'momentum_sort' as model, fold_id, target_raw, target_demeaned as y_true, mom_12_1 as y_pred from usable join folds on MthCalDt between test_start and test_end where mom_12_1 is not null)"""


def _m(select: str, more: str = "") -> str:
    return O.raw_sql(select, ["mom_12_1"], f"{_T},{_F}{',' + more if more else ''}")


@query(O.master_sql(f"select {O.shown('MthCalDt', 'PERMNO', 'target')} from (select PERMNO, MthCalDt, case when least(r1, r2, r3) >= -1 and r1 is not null and r2 is not null and r3 is not null then (1 + r1) * (1 + r2) * (1 + r3) - 1 end as target from (select PERMNO, MthCalDt, lead(ret_adj, 1) over w as r1, lead(ret_adj, 2) over w as r2, lead(ret_adj, 3) over w as r3 from master window w as (partition by PERMNO order by MthCalDt)))"))
def m1_forward_return(spark, sf_dir):
    return shown(_master(spark, sf_dir)[0].select("MthCalDt", "PERMNO", targets.forward_return(F.col("ret_adj"), 3).alias("target")))


@query(_m(f"select {O.shown('MthCalDt', 'PERMNO is_investable target_valid', 'mom_12_1 target_raw target_demeaned')} from training"))
def m2_m3_training_panel(spark, sf_dir):
    return shown(_training(spark, sf_dir, ("momentum",)).select("MthCalDt", "PERMNO", "is_investable", "target_valid", "mom_12_1", "target_raw", "target_demeaned"))


def _usable(spark, sf_dir, families=("momentum",)) -> tuple[DataFrame, list[targets.Fold], DataFrame]:
    table = materialize(_training(spark, sf_dir, families).where("is_investable"), "training")  # months, predictions and returns all read it
    folds = targets.walk_forward_folds(targets.months_of(table), CONFIG)
    return table, folds, targets.folds_table(spark, folds)


@query(_m(f"select {O.shown('train_start train_end test_start test_end inner_train_end inner_val_start inner_val_end', 'fold_id')} from folds"))
def m4_folds(spark, sf_dir):
    return shown(_usable(spark, sf_dir)[2])


@query(_m(" union all ".join(f"select cast(fold_id as bigint) as fold_id, '{p}' as part, cast(count(*) as bigint) as rows, cast(count(case when mom_12_1 is not null and target_demeaned is not null then 1 end) as bigint) as complete from usable join folds on MthCalDt between {a} and {b} group by 1"
    for p, a, b in (("train", "train_start", "train_end"), ("inner_train", "train_start", "inner_train_end"), ("inner_val", "inner_val_start", "inner_val_end"), ("test", "test_start", "test_end")))))
def m5_m6_fold_slices(spark, sf_dir):
    table, _, folds = _usable(spark, sf_dir)
    complete = F.col("mom_12_1").isNotNull() & F.col("target_demeaned").isNotNull()
    parts = [targets.fold_rows(table, folds, p).groupBy("fold_id").agg(F.lit(p).alias("part"), F.count(F.lit(1)).alias("rows"), F.count_if(complete).alias("complete")) for p in ("train", "inner_train", "inner_val", "test")]
    return shown(checks.union(parts))


def _predictions(spark, sf_dir) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Momentum predictions over all folds' test months, the training table, the folds."""
    table, _, folds = _usable(spark, sf_dir)
    rows = targets.fold_rows(table, folds, "test")
    scored = models.momentum_scores(rows, CONFIG.momentum)
    return scored.select("PERMNO", "MthCalDt", F.lit("momentum_sort").alias("model"), "fold_id", F.col("target_demeaned").alias("y_true"), "y_pred"), table, folds


_EW = "(select PERMNO, MthCalDt, model, fold_id, y_true, y_pred from preds union all select PERMNO, MthCalDt, 'equal_weight', fold_id, target_demeaned, 0.0 from usable join folds on MthCalDt between test_start and test_end)"


@query(_m(f"select {O.shown('MthCalDt', 'PERMNO fold_id', 'y_true y_pred', 'model')} from {_EW}", _P))
def m7_m8_baseline_predictions(spark, sf_dir):
    """The momentum baseline and the equal-weight one over all folds' test months."""
    momentum, table, folds = _predictions(spark, sf_dir)
    flat = models.equal_scores(targets.fold_rows(table, folds, "test"))
    return shown(momentum.unionByName(flat.select("PERMNO", "MthCalDt", F.lit("equal_weight").alias("model"), "fold_id", F.col("target_demeaned").alias("y_true"), "y_pred")))


_CROSS = f"""
cross_section as (select * from (select MthCalDt, target_demeaned, {', '.join(MODEL_FEATURES)}, count(*) over (partition by MthCalDt) as n_rows from training where target_demeaned is not null and {' and '.join(f'{c} is not null' for c in MODEL_FEATURES)}) where n_rows >= {len(MODEL_FEATURES) + 5}),
{O.least_squares('cross_section', 'MthCalDt', 'target_demeaned', MODEL_FEATURES)},
monthly as (select MthCalDt, {', '.join(f'sum(w{i} * target_demeaned) as b{i}' for i in range(len(MODEL_FEATURES) + 1))} from fitted group by 1)"""


@query(O.raw_sql(f"select {O.shown('MthCalDt', '', ' '.join(f'b{i}' for i in range(len(MODEL_FEATURES) + 1)))} from monthly", MODEL_FEATURES, f"{_T},{_CROSS}"))
def m9_fama_macbeth_coefficients(spark, sf_dir):
    """A regression per month over features that need prices and returns alone and are not collinear within a month: b0 is the constant."""
    monthly = models.monthly_regressions(_training(spark, sf_dir), MODEL_FEATURES, "target_demeaned")
    return shown(monthly.select("MthCalDt", *(F.col("coefficients")[i].alias(f"b{i}") for i in range(len(MODEL_FEATURES) + 1))))


def _model_table(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, list[targets.Fold]]:
    """Model-ready features with targets over the universe, and the folds, as the job has them: features are written and read back, so no plan holds them all.

    Forward returns are taken where securities lie together, and travel with the features: nothing wide is joined.
    """
    master, t = _master(spark, sf_dir)
    given = master.withColumn("target_raw", targets.forward_return(F.col("ret_adj"), CONFIG.horizon))
    raw = materialize(features.raw_features(given, t["compustat_fundamentals_annual"], more=("target_raw",)), "model-features")
    ready = crosssection.model_ready(raw, [*features.KEYS, "target_raw"], list(features.NAMES)).drop("ret_adj")
    table = materialize(targets.demeaned(ready, raw).where("is_investable"), "model-table")
    return table, targets.walk_forward_folds(targets.months_of(table), CONFIG)


def _training_of(spark: SparkSession, sf_dir: str) -> models.Training:
    table, folds = _model_table(spark, sf_dir)
    return models.Training(table, list(features.MODEL_NAMES), "target_demeaned", folds, CONFIG)


_N = len(features.MODEL_NAMES)
#: CTEs after raw, training and folds: ridge by elimination on each window's centred cross products, the inner trials and each fold's best penalty.
_RIDGE = f"""
held as (select u.PERMNO, u.MthCalDt, u.target_demeaned as y from usable u join (select PERMNO, MthCalDt from scaled where feature in ({', '.join(f"'{c}'" for c in features.MODEL_NAMES)}) group by 1, 2 having count(*) = {_N}) w on u.PERMNO = w.PERMNO and u.MthCalDt = w.MthCalDt),
cols as materialized (select h.PERMNO, h.MthCalDt, y, list_position([{', '.join(f"'{c}'" for c in features.MODEL_NAMES)}], feature) as j, v from held h join scaled s on h.PERMNO = s.PERMNO and h.MthCalDt = s.MthCalDt where feature in ({', '.join(f"'{c}'" for c in features.MODEL_NAMES)})),
known as materialized (select PERMNO, MthCalDt, j, v from cols where y is not null union all select PERMNO, MthCalDt, {_N + 1}, y from held where y is not null),
parts as (select fold_id, 'inner' as part, train_start as s, inner_train_end as e from folds union all select fold_id, 'train', train_start, train_end from folds),
alphas as (select unnest([{', '.join(f'cast({a} as double)' for a in models.RIDGE.grid['alpha'])}]) as alpha),
means as (select fold_id, part, j, avg(v) as m, count(*) as n from parts join known on MthCalDt between s and e group by 1, 2, 3),
gram as (select fold_id, part, i, j, sum(v) as v from parts join (select a.MthCalDt, a.j as i, b.j as j, sum(a.v * b.v) as v from known a join known b on a.PERMNO = b.PERMNO and a.MthCalDt = b.MthCalDt group by 1, 2, 3) g on MthCalDt between s and e where i <= {_N} group by 1, 2, 3, 4),
equations as materialized (select g.fold_id, g.part, alpha, g.i, g.j, g.v - a.n * a.m * b.m + case when g.i = g.j then alpha else 0 end as v from gram g join means a on g.fold_id = a.fold_id and g.part = a.part and g.i = a.j
  join means b on g.fold_id = b.fold_id and g.part = b.part and g.j = b.j, alphas),
solved as materialized (with recursive steps as (select *, 0 as k from equations union all
  select fold_id, part, alpha, i, j, case when i = k + 1 then v / d else v - c * r / d end, k + 1 from (select *, max(case when i = k + 1 and j = k + 1 then v end) over (partition by fold_id, part, alpha) as d,
    max(case when j = k + 1 then v end) over (partition by fold_id, part, alpha, i) as c, max(case when i = k + 1 then v end) over (partition by fold_id, part, alpha, j) as r from steps where k < {_N}))
  select fold_id, part, alpha, i, v as b from steps where k = {_N} and j = {_N + 1}),
weights as (select s.*, y.m - sum(b * x.m) over (partition by s.fold_id, s.part, alpha) as b0 from solved s join means x on s.fold_id = x.fold_id and s.part = x.part and s.i = x.j join means y on s.fold_id = y.fold_id and s.part = y.part and y.j = {_N + 1}),
tried as (select f.fold_id, alpha, y, sum(v * b) + max(b0) as p from folds f join cols c on MthCalDt between inner_val_start and inner_val_end join weights w on w.fold_id = f.fold_id and part = 'inner' and w.i = c.j where y is not null group by f.fold_id, alpha, PERMNO, MthCalDt, y),
placed as (select fold_id, alpha, rank() over (partition by fold_id, alpha order by y) + (count(*) over (partition by fold_id, alpha, y) - 1) / 2.0 as rx, rank() over (partition by fold_id, alpha order by p) + (count(*) over (partition by fold_id, alpha, p) - 1) / 2.0 as ry from tried),
trials as (select f.fold_id, a.alpha, ic from folds f cross join alphas a left join (select fold_id, alpha, case when count(*) >= 2 and stddev_pop(rx) * stddev_pop(ry) > 0 then covar_pop(ry, rx) / (stddev_pop(rx) * stddev_pop(ry)) end as ic from placed group by 1, 2) t on t.fold_id = f.fold_id and t.alpha = a.alpha),
best as (select fold_id, alpha from (select *, row_number() over (partition by fold_id order by round(ic, 11) desc nulls last, alpha) as n from trials) where n = 1),
scored as (select PERMNO, MthCalDt, f.fold_id, y, sum(v * b) + max(b0) as p from folds f join best t on t.fold_id = f.fold_id join cols c on MthCalDt between test_start and test_end left join weights w on w.fold_id = f.fold_id and part = 'train' and w.alpha = t.alpha and w.i = c.j group by PERMNO, MthCalDt, f.fold_id, y)"""


@query(O.raw_sql(f"select {O.shown('', 'fold_id', 'alpha ic')} from trials", _ALL, f"{_SCALED},{_T},{_F},{_RIDGE}"))
def m10_m16_tune_ridge(spark, sf_dir):
    """Trials of the ridge grid on every fold's inner split, over all model features."""
    trials = models.tuned(models.RIDGE, _training_of(spark, sf_dir))
    return shown(spark.createDataFrame([(f, p["alpha"], ic_) for f, found in trials.items() for p, ic_ in found], "fold_id int, alpha double, ic double"))  # folds * candidates rows


def _walk(spark: SparkSession, sf_dir: str, runners: dict[str, models.Runner]) -> DataFrame:
    table, folds = _model_table(spark, sf_dir)
    return models.walk_forward(table, list(features.MODEL_NAMES), "target_demeaned", folds, runners, CONFIG)


@query(O.raw_sql(f"select {O.shown('MthCalDt', 'PERMNO fold_id', 'y_true y_pred', 'model')} from (select PERMNO, MthCalDt, fold_id, 'ridge' as model, y as y_true, p as y_pred from scored)", _ALL, f"{_SCALED},{_T},{_F},{_RIDGE}"))
def m10_m17_walk_forward_ridge(spark, sf_dir):
    """Ridge over all folds and model features: tuned on the inner splits, fitted on the whole windows, scored on the test months."""
    got = _walk(spark, sf_dir, {"ridge": models.estimator_runner(models.RIDGE)})
    return shown(got.select("PERMNO", "MthCalDt", "fold_id", "model", "y_true", "y_pred"))


@query()
def m18_walk_forward(spark, sf_dir):
    """Baselines and all five estimators over all folds and model features, as the job runs them."""
    return _walk(spark, sf_dir, models.runners())


@query()
def m13_walk_forward_forest(spark, sf_dir):
    """The forest over all folds and model features, with its whole grid."""
    return _walk(spark, sf_dir, {"random_forest": models.estimator_runner(models.RANDOM_FOREST)})


@query()
def m14_walk_forward_boosting(spark, sf_dir):
    """Boosting over all folds and model features, with its whole grid."""
    return _walk(spark, sf_dir, {"hist_gradient_boosting": models.estimator_runner(models.GRADIENT_BOOSTING)})


_RANKED = """
ranked as (select MthCalDt, model, y_true, case when y_true is not null then rank() over (partition by MthCalDt, y_true is null order by y_true) + (count(*) over (partition by MthCalDt, y_true) - 1) / 2.0 end as rx,
  case when y_true is not null then rank() over (partition by MthCalDt, y_true is null order by y_pred) + (count(*) over (partition by MthCalDt, y_true is null, y_pred) - 1) / 2.0 end as ry from preds),
series as (select MthCalDt, model, case when count(rx) >= 2 and stddev_pop(rx) * stddev_pop(ry) > 0 then covar_pop(ry, rx) / (stddev_pop(rx) * stddev_pop(case when rx is not null then ry end)) end as ic, count(*) as n from ranked group by 1, 2)"""


@query(_m(f"select {O.shown('MthCalDt', 'n', 'ic', 'model')} from series", f"{_P},{_RANKED}"))
def m15_m19_monthly_ic(spark, sf_dir):
    return shown(ic.monthly_ic(_predictions(spark, sf_dir)[0]))


@query(_m("select model, round(avg(ic), 6) + 0.0 as ic_mean, round(stddev_samp(ic), 6) + 0.0 as ic_std, round(avg(ic) / (stddev_samp(ic) / sqrt(count(ic))), 6) + 0.0 as ic_t_stat, cast(count(ic) as bigint) as n_months from series group by 1", f"{_P},{_RANKED}"))
def m20_ic_summary(spark, sf_dir):
    return shown(ic.ic_summary(ic.monthly_ic(_predictions(spark, sf_dir)[0])))


def _importance(spark: SparkSession, sf_dir: str, estimator: models.Estimator) -> DataFrame:
    table, folds = _model_table(spark, sf_dir)
    return models.category_importance(models.permutation_importance(estimator, table, list(features.MODEL_NAMES), "target_demeaned", folds, CONFIG))


@query()
def m21_m22_permutation_importance(spark, sf_dir):
    """Category importances of ridge over all model features, on every fold's inner validation rows."""
    return _importance(spark, sf_dir, models.RIDGE)


@query()
def m21_m22_permutation_importance_boosting(spark, sf_dir):
    """The same of boosting."""
    return _importance(spark, sf_dir, models.GRADIENT_BOOSTING)


@query(_m("select check_name, cast(affected = 0 as bigint) as passed, affected from (" + _affected({
    "fold_purge_embargo": "(select count(*) from folds where year(test_start) * 12 + month(test_start) - year(train_end) * 12 - month(train_end) <= 1)",
    "folds_expanding": "(select count(*) from (select *, lag(train_start) over (order by fold_id) as s, lag(train_end) over (order by fold_id) as e from folds) where train_start <> s or train_end <= e)",
    "no_duplicate_predictions": "(select count(*) - count(distinct (PERMNO, MthCalDt, model)) from preds)",
    "predictions_within_fold_test_window": "(select count(*) from preds p left join folds f on p.fold_id = f.fold_id where coalesce(not MthCalDt between test_start and test_end, true))",
}) + ")", _P))
def v13_to_v17_model_checks(spark, sf_dir):
    predictions, _, folds = _predictions(spark, sf_dir)
    return shown(checks.model_checks(predictions, folds).select("check_name", "passed", "affected"))


# ---- portfolios

_W = """
bucketed as (select *, least(greatest(ceil(rn / n * 10), 1), 10) as b from (select *, cast(row_number() over (partition by MthCalDt, model order by y_pred, PERMNO) as double) as rn, cast(count(*) over (partition by MthCalDt, model) as double) as n from preds)),
held as (select PERMNO, MthCalDt, model, y_pred, target_raw, case when b = 10 then 1.0 else -1.0 end / count(*) over (partition by MthCalDt, model, b) as weight from bucketed where n >= 20 and b in (1, 10))"""
_R = """
nexts as (select model, MthCalDt, lead(MthCalDt) over (partition by model order by MthCalDt) as nxt from (select distinct model, MthCalDt from held)),
moves as (select PERMNO, MthCalDt, model, weight as w from held union all select PERMNO, nxt, h.model, -weight from held h join nexts n on h.model = n.model and h.MthCalDt = n.MthCalDt where nxt is not null),
turn as (select MthCalDt, model, 0.5 * sum(abs(w)) as turnover from (select PERMNO, MthCalDt, model, sum(w) as w from moves group by 1, 2, 3) group by 1, 2),
rets as (select g.*, turnover, turnover * 10.0 / 10000 as cost, gross_return - turnover * 10.0 / 10000 as net_return from (select MthCalDt, model, sum(weight * target_raw) as gross_return from held where target_raw is not null group by 1, 2) g join turn t on g.MthCalDt = t.MthCalDt and g.model = t.model)"""


@query(_m(f"select {O.shown('MthCalDt', 'PERMNO', 'weight', 'model')} from held", f"{_P},{_W}"))
def b1_b3_holdings(spark, sf_dir):
    return shown(portfolio.weights(_predictions(spark, sf_dir)[0]))


_WS = """
scored as (select PERMNO, MthCalDt, model, case when b = 10 then 1 else -1 end as leg, greatest(case when b = 10 then y_pred else -y_pred end, 0) as mass from bucketed where n >= 20 and b in (1, 10)),
weighted as (select PERMNO, MthCalDt, model, case when sum(mass) over (partition by MthCalDt, model, leg) > 0 then leg * mass / sum(mass) over (partition by MthCalDt, model, leg) end as weight from scored)"""


@query(_m(f"select {O.shown('MthCalDt', 'PERMNO', 'weight', 'model')} from weighted where weight <> 0", f"{_P},{_W},{_WS}"))
def b2_score_weights(spark, sf_dir):
    return shown(portfolio.weights(_predictions(spark, sf_dir)[0], scheme="score"))


def _returns(spark, sf_dir) -> DataFrame:
    predictions, table, _ = _predictions(spark, sf_dir)
    return portfolio.portfolio_returns(materialize(portfolio.weights(predictions), "holdings"), portfolio.realized_returns(table))


@query(_m(f"select {O.shown('MthCalDt', '', 'turnover', 'model')} from turn", f"{_P},{_W},{_R}"))
def b4_turnover(spark, sf_dir):
    return shown(portfolio.turnover(portfolio.weights(_predictions(spark, sf_dir)[0])))


@query(_m(f"select {O.shown('MthCalDt', '', 'gross_return turnover cost net_return', 'model')} from rets", f"{_P},{_W},{_R}"))
def b5_b6_portfolio_returns(spark, sf_dir):
    return shown(_returns(spark, sf_dir))


@query(_m("""select model, kind, round(avg(r) * 12, 6) + 0.0 as annualized_return, round(stddev_samp(r) * sqrt(12), 6) + 0.0 as annualized_vol, round(avg(r) / stddev_samp(r) * sqrt(12), 6) + 0.0 as sharpe,
round(case when count(case when r < 0 then r end) >= 2 then avg(r) / stddev_samp(case when r < 0 then r end) * sqrt(12) end, 6) + 0.0 as sortino, round(min(c / top - 1), 6) + 0.0 as max_drawdown,
round(avg(case when r > 0 then 1.0 else 0.0 end), 6) + 0.0 as hit_rate, cast(count(*) as bigint) as n_periods from (select *, max(c) over (partition by model, kind order by MthCalDt) as top
from (select *, product(1 + r) over (partition by model, kind order by MthCalDt) as c from (select MthCalDt, model, 'gross' as kind, gross_return as r from rets union all select MthCalDt, model, 'net', net_return from rets))) group by 1, 2""", f"{_P},{_W},{_R}"))
def b7_performance(spark, sf_dir):
    return shown(performance.performance(_returns(spark, sf_dir)))


@query(_m("""select model, round(bps, 6) + 0.0 as cost_bps, round(avg(r) / stddev_samp(r) * sqrt(12), 6) + 0.0 as sharpe, round(avg(r) * 12, 6) + 0.0 as annualized_return
from (select model, bps, gross_return - turnover * bps / 10000 as r from rets, (select unnest([0.0, 5.0, 10.0, 20.0, 50.0]::double[]) as bps)) group by model, bps""", f"{_P},{_W},{_R}"))
def b8_cost_sensitivity(spark, sf_dir):
    return shown(performance.cost_sensitivity(_returns(spark, sf_dir)))


_LAGS = "greatest(1, round_even(4 * power(count(*) / 100.0, 2.0 / 9), 0))"
_NW = f"""
regressed as (select r.MthCalDt, r.model, r.net_return, {', '.join(performance.FACTORS)} from rets r join (select distinct MthCalDt, {', '.join(performance.FACTORS)} from master) f on r.MthCalDt = f.MthCalDt
  where net_return is not null and {' and '.join(f'{c} is not null' for c in performance.FACTORS)}),
{O.least_squares('regressed', 'model', 'net_return', list(performance.FACTORS))},
scores as (select model, MthCalDt, net_return as y, e, i, w, row_number() over (partition by model, i order by MthCalDt) as t
  from (select model, MthCalDt, net_return, e, unnest(range(0, {len(performance.FACTORS) + 1})) as i, unnest([{', '.join(f'w{i}' for i in range(len(performance.FACTORS) + 1))}]) as w from fitted)),
lags as (select model, {_LAGS} as lag_max from fitted group by 1),
spread as (select a.model, a.i, sum(case when a.t = b.t then 1 else 2 * (1 - (a.t - b.t) / (lag_max + 1)) end * a.w * a.e * b.w * b.e) as v
  from scores a join scores b on a.model = b.model and a.i = b.i join lags l on a.model = l.model where a.t - b.t between 0 and lag_max group by 1, 2),
coefs as (select s.model, s.i, sum(s.w * s.y) as b, sum(s.w * s.y) / sqrt(any_value(v)) as t_stat, count(*) as n_months, 1 - sum(e * e) / (var_pop(y) * count(*)) as r_squared
  from scores s join spread p on s.model = p.model and s.i = p.i group by 1, 2)"""


@query(_m(f"select model, cast(max(n_months) as bigint) as n_months, " + ", ".join(f"round(max(case when i = {i} then {x} end), 6) + 0.0 as {name}"
    for i, f in enumerate(["alpha", *performance.FACTORS]) for x, name in (("b", f if i == 0 else f"{f}_beta"), ("t_stat", f"{f}_t_stat"))) + f", round(max(r_squared), 6) + 0.0 as r_squared from coefs group by model having max(n_months) >= {len(performance.FACTORS) + 5}", f"{_P},{_W},{_R},{_NW}"))
def b9_b10_factor_regression(spark, sf_dir):
    master, _ = _master(spark, sf_dir)
    return shown(performance.factor_regression(_returns(spark, sf_dir), portfolio.factor_months(master, list(performance.FACTORS))))


# ---- the composed jobs, written and read back

def _folders(spark: SparkSession) -> dict[str, str]:
    """New folders below the shared one."""
    top = f"{shared_dir(spark)}/jobs-{uuid.uuid4().hex}"
    return {k: f"{top}/{k}" for k in ("raw", "interim", "processed", "reports")}


def _interim(tables: dict[str, DataFrame], folder: str, before: str | None = None) -> None:
    """The interim tables; the monthly one up to a month, if given."""
    for name, df in by_raw_name(tables).items():
        write_table(df.where(f"MthCalDt < '{before}'") if before and name == "crsp_monthly_stock" else df, folder, name)


_NAMES = "select s_suppkey as permno, s_suppkey as permco, concat('T', cast(s_suppkey as string)) as ticker, s_name as issuernm, cast(3000 + (s_suppkey * 37) % 4000 as bigint) as siccd from {supplier}"


@query(f"with {ctes('crsp', 'fund', 'links', 'delist', 'factors')}\n" + """
select 'crsp_monthly_stock' as dataset, cast(count(*) as bigint) as rows, cast(count(*) filter (where ShrOut % 19 = 0) as bigint) as dropped, round(sum(MthPrc), 3) + 0.0 as total, cast(max(MthCalDt) as varchar) as last_date from crsp
union all select 'crsp_delisting', count(*), 0, round(sum(DelRet), 3) + 0.0, cast(max(DelistingDt) as varchar) from delist
union all select 'ccm_link_table', count(*), 0, round(sum(gvkey), 3) + 0.0, cast(max(LINKENDDT) as varchar) from links
union all select 'compustat_fundamentals_annual', count(*), 0, round(sum(revt), 3) + 0.0, cast(max(datadate) as varchar) from fund
union all select 'fama_french_5f_momentum_monthly', count(*), 0, round(sum(mktrf), 3) + 0.0, cast(max(dateff) as varchar) from factors""")
def pl1_raw_to_interim(spark, sf_dir):
    """CSV files with repeated rows, sentinels and dates as text -> profiles, findings, cleaned interim tables, read back."""
    at, t = _folders(spark), by_raw_name(relations(spark, sf_dir))
    t["crsp_monthly_stock"] = t["crsp_monthly_stock"].unionByName(t["crsp_monthly_stock"].where("ShrOut % 19 = 0"))
    t["crsp_names"] = spark.sql(_NAMES, supplier=spark.read.parquet(f"{sf_dir}/supplier.parquet"))
    for name, df in t.items():
        write_raw(df, DATASETS[name], at["raw"], {"LINKENDDT": "E"})
    made = pipelines.validate(spark, at["raw"], at["interim"], at["reports"])
    sums = {"crsp_monthly_stock": ("MthPrc", "MthCalDt"), "crsp_delisting": ("DelRet", "DelistingDt"), "ccm_link_table": ("gvkey", "LINKENDDT"), "compustat_fundamentals_annual": ("revt", "datadate"), "fama_french_5f_momentum_monthly": ("mktrf", "dateff")}
    parts = []
    for name, df in read_interim(spark, at["interim"]).items():
        value, date = sums[name]
        one = df.agg(F.lit(name).alias("dataset"), F.count(F.lit(1)).alias("rows"), F.sum(F.col(value).cast("double")).alias("total"), F.max(date).cast("string").alias("last_date"))
        parts.append(one.crossJoin(made[f"{name}_cleaning"].select(F.col("rows_dropped").alias("dropped"))))  # one row
    return shown(checks.union(parts), 3)


_BY_YEAR = "cast(year(MthCalDt) as bigint) as year, cast(count(*) as bigint) as rows"


@query(O.master_sql(f"select {_BY_YEAR}, cast(count(gvkey) as bigint) as linked, cast(count(*) filter (where is_delisted) as bigint) as delisted, round(sum(ret_adj), 6) + 0.0 as ret_adj, round(sum(cst_revt) / 1e9, 6) + 0.0 as revt from master group by 1"))
def pl2_master_panel_job(spark, sf_dir):
    """Interim tables -> master panel by year, read back."""
    at = _folders(spark)
    _interim(relations(spark, sf_dir, WRITTEN), at["interim"])
    pipelines.build_panel(spark, at["interim"], at["processed"], at["reports"])
    rows = read_table(spark, at["processed"], "master_panel").groupBy("year")
    return shown(rows.agg(F.count(F.lit(1)).alias("rows"), F.count("gvkey").alias("linked"), F.count_if("is_delisted").alias("delisted"), F.sum("ret_adj").alias("ret_adj"), (F.sum("cst_revt") / 1e9).alias("revt")))


_TOLD = ["mom_12m", "vol_12m", "skew_36m", "beta_24m", "size_relative_mktcap", "growth_sales"]
_PL3_SQL = O.raw_sql(f"select {_BY_YEAR}, " + ", ".join(f"cast(count({c}) as bigint) as n_{c}, round(sum({c}), 4) + 0.0 as {c}" for c in _TOLD) + " from raw group by 1", _TOLD)


def _told(spark: SparkSession, folder: str) -> DataFrame:
    rows = read_table(spark, folder, "features_raw").groupBy("year")
    return shown(rows.agg(F.count(F.lit(1)).alias("rows"), *(x for c in _TOLD for x in (F.count(c).alias(f"n_{c}"), F.sum(c).alias(c)))), 4)


@query(_PL3_SQL)
def pl3_monthly_append(spark, sf_dir):
    """Panel and features up to three months before the end, then the last months appended: equal to a full build."""
    at = _folders(spark)
    t = relations(spark, sf_dir, WRITTEN)
    since = targets.months_of(t["crsp"])[-3]
    _interim(t, at["interim"], str(since))
    pipelines.build_panel(spark, at["interim"], at["processed"], at["reports"])
    master, annual = read_table(spark, at["processed"], "master_panel").drop("year"), read_table(spark, at["interim"], "compustat_fundamentals_annual")
    write_table(features.raw_features(master, annual), at["processed"], "features_raw", "MthCalDt")
    _interim(t, at["interim"])
    pipelines.append_months(spark, at["interim"], at["processed"], since)
    return _told(spark, at["processed"])


@query(O.raw_sql("""select model, kind, round(avg(r) * 12, 6) + 0.0 as annualized_return, round(stddev_samp(r) * sqrt(12), 6) + 0.0 as annualized_vol, cast(count(*) as bigint) as n_periods
from (select MthCalDt, model, 'gross' as kind, gross_return as r from rets union all select MthCalDt, model, 'net', net_return from rets) group by 1, 2""", ["mom_12_1"],
    f"{_T},{_F},{_P.replace('preds as (', 'momentum as (')}, preds as (select PERMNO, MthCalDt, 'equal_weight' as model, fold_id, target_raw, target_demeaned as y_true, 0.0 as y_pred from usable join folds on MthCalDt between test_start and test_end),{_W},{_R}"))
def pl3_to_pl5_jobs(spark, sf_dir):
    """Features with all checks, folds and predictions of a baseline, backtest: each job reads what the one before has written."""
    at = _folders(spark)
    _interim(relations(spark, sf_dir, WRITTEN), at["interim"])
    pipelines.build_panel(spark, at["interim"], at["processed"], at["reports"])
    pipelines.build_features(spark, at["processed"], at["interim"], at["reports"], entities=10, months=1)
    pipelines.run_models(spark, at["processed"], at["reports"], ["mom_12_1"], CONFIG, {"equal_weight": models.equal_weight})
    out = pipelines.run_backtest(spark, at["processed"], at["reports"])
    return shown(out["performance"].select("model", "kind", "annualized_return", "annualized_vol", "n_periods"))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Momentum and volatility, rank-scaled by month, top and bottom decile of their sum, gross returns by month."""
    master, t = _master(spark, sf_dir)
    raw = features.raw_features(master, t["compustat_fundamentals_annual"], ("momentum", "volatility"))
    ready = crosssection.model_ready(raw, list(features.KEYS), ["mom_6_1", "vol_12m"])
    scores = ready.withColumn("y_pred", F.col("mom_6_1") - F.col("vol_12m")).withColumn("model", F.lit("momentum_low_vol"))
    held = portfolio.weights(scores.select("PERMNO", "MthCalDt", "model", "y_pred"), deciles=4)
    return portfolio.portfolio_returns(held, targets.targets(panel.investable(master)))

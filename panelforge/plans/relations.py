"""The panel's input tables derived from the supplied ones. The text is common to Spark SQL and other engines; sums are of decimals, so they are exact in any order. The two aggregations over the large tables Spark does in whole cents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from panelforge.sources.shared import materialize

_AMOUNT = "cast(o_totalprice as decimal(18,2))"


def _sum(condition: str) -> str:
    return f"cast(sum(case when {condition} then {_AMOUNT} end) as double)"


#: Annual items from sums of orders: all, by status (f, o, p), by priority (1 to 5).
ITEMS = {
    "revt": "s_all", "ni": "s_f - s_p * 0.9", "seq": "case when GVKEY % 7 = 3 then -s_1 else s_1 + s_2 end", "lt": "s_3", "pstk": "case when GVKEY % 4 = 0 then s_1 * 0.01 end",
    "txditc": "case when GVKEY % 3 = 0 then s_2 * 0.02 end", "dlc": "s_4 * 0.3", "dltt": "s_5 * 0.6", "che": "s_o * 0.1", "oancf": "s_f * 0.7 - s_o * 0.2", "ebitda": "s_f * 0.5",
    "ebit": "s_f * 0.4 - s_4 * 0.1", "xint": "case when GVKEY % 5 <> 0 then s_5 * 0.05 end", "act": "s_o * 0.6", "lct": "case when GVKEY % 6 = 0 then 0.0 else s_4 * 0.5 end",
    "gp": "s_all * 0.3 - s_p * 0.1", "cogs": "case when GVKEY % 8 <> 0 then s_all * 0.55 end", "xsga": "s_2 * 0.3", "capx": "s_1 * 0.2", "invt": "s_3 * 0.4", "rect": "s_4 * 0.35", "ppent": "s_5 * 0.8",
}

#: A row for each security and month, and for each GVKEY and year.
MONTHLY = """select l_suppkey as PERMNO, last_day(cast(l_shipdate as date)) as MthCalDt,
  cast(sum(cast(l_extendedprice as decimal(18,2))) as double) / cast(sum(cast(l_quantity as decimal(18,2))) as double) as MthPrc,
  cast(sum(cast(l_quantity as decimal(18,2))) as double) as MthVol,
  cast(sum(case when l_discount <= 0.05 then cast(l_extendedprice as decimal(18,2)) end) as double) as MthCap, count(*) as ShrOut
  from {lineitem} group by 1, 2"""
ANNUAL = f"""select cast(c_nationkey as bigint) as GVKEY, cast(year(o_orderdate) as int) as yr, {_sum("true")} as s_all,
  {", ".join(f"{_sum(f"o_orderstatus = '{s.upper()}'")} as s_{s}" for s in "fop")}, {", ".join(f"{_sum(f"o_orderpriority like '{k}-%'")} as s_{k}" for k in range(1, 6))}
  from {{orders}} join {{customer}} on o_custkey = c_custkey group by 1, 2"""
#: Each relation may use those before it.
RELATIONS = {
    "crsp": f"""
select PERMNO, MthCalDt, MthPrc, MthVol, MthCap, ShrOut, case when ShrOut % 11 = 0 then 'NT' when ShrOut % 13 <> 0 then 'R' end as MthRetFlg,
  cast(3000 + (PERMNO * 37) % 4000 as bigint) as SICCD, MthPrc / lag(MthPrc) over (partition by PERMNO order by MthCalDt) - 1 as MthRet
from ({MONTHLY}) as monthly""",
    "fund": f"""
select GVKEY, last_day(make_date(yr, 12, 1)) as datadate, {", ".join(f"cast({e} as double) as {c}" for c, e in ITEMS.items())}
from ({ANNUAL}) as annual""",
    "links": """
select s_suppkey as LPERMNO, cast(s_nationkey as bigint) as gvkey, '01' as LIID, 'P' as LINKPRIM, date '1995-01-01' as LINKDT, case when s_suppkey % 3 = 0 then date '1998-06-30' end as LINKENDDT from {supplier}
union all select s_suppkey, cast((s_nationkey + 1) % 25 as bigint), '02', case when s_suppkey % 2 = 0 then 'C' else 'J' end, date '1997-01-01', case when s_suppkey % 4 = 0 then date '1999-12-31' end from {supplier} where s_suppkey % 5 = 0
union all select s_suppkey, cast((s_nationkey + 2) % 25 as bigint), '02', 'N', date '1997-01-01', cast(null as date) from {supplier} where s_suppkey % 10 = 0
union all select s_suppkey + 1000000, cast(s_nationkey + 40 as bigint), '01', 'P', date '1990-01-01', case when s_suppkey % 2 = 0 then date '1993-12-31' end from {supplier} where s_suppkey % 8 = 0""",
    "delist": """
select PERMNO, max(MthCalDt) as DelistingDt, case when PERMNO % 3 = 0 then PERMNO + 1 when PERMNO % 17 = 0 then 9999999 else 0 end as DelPERMNO,
  case when PERMNO % 7 <> 0 then -cast(PERMNO % 10 as double) / 20 end as DelRet
from {crsp} where PERMNO % 9 <> 4 group by PERMNO having max(MthCalDt) < (select max(MthCalDt) from {crsp})
union all select cast(8888888 as bigint), date '1996-05-31', cast(0 as bigint), -0.5""",
    "factors": """
select MthCalDt as dateff, round(avg(MthRet), 8) as mktrf, round(avg(case when MthVol < 100 then MthRet end) - avg(case when MthVol >= 100 then MthRet end), 8) as smb,
  round(avg(case when PERMNO % 2 = 0 then MthRet end) - avg(case when PERMNO % 2 = 1 then MthRet end), 8) as hml, round(avg(case when PERMNO % 3 = 0 then MthRet end) - avg(MthRet), 8) as rmw,
  round(avg(case when PERMNO % 5 = 0 then MthRet end) - avg(MthRet), 8) as cma, cast(0.001 as double) as rf, round(avg(case when MthPrc > 1500 then MthRet end) - avg(MthRet), 8) as umd
from {crsp} where MthRet is not null and MthCalDt <> date '1997-03-31' group by MthCalDt""",
}
#: Bytes of a generated method from which the JVM no longer compiles it: the panel's wide rows would be interpreted.
HOT_METHOD = "8000"
_TABLES = ("lineitem", "orders", "customer", "supplier")


def _cents(x: str) -> str:
    """cast(x as decimal(18,2)) in cents. The cast goes by way of text; only values near half a cent and large ones need it."""
    return f"case when abs({x}) < 1e8 and abs({x} * 100 - rint({x} * 100)) < 0.4 then cast(rint({x} * 100) as bigint) else cast(cast({x} as decimal(18,2)) * 100 as bigint) end"


def _total(cents: str, condition: str = "true") -> str:
    """The sum of cents as a double, as by decimals: upper and lower 32 bits are summed apart, so no number of rows overflows."""
    high, low = (f"sum(case when {condition} then {part} end)" for part in (f"shiftright({cents}, 32)", f"{cents} & 4294967295"))
    return f"case when abs({high}) < 524288 and {low} < 2251799813685248 then ({high} * 4294967296 + {low}) / 100D else cast((cast({high} as decimal(20,0)) * 4294967296 + {low}) * 0.01BD as double) end"


_MONTHLY_IN_CENTS = f"""
select PERMNO, MthCalDt, {_total("price")} / {_total("quantity")} as MthPrc, {_total("quantity")} as MthVol, {_total("price", "l_discount <= 0.05")} as MthCap, count(*) as ShrOut
from (select l_suppkey as PERMNO, last_day(cast(l_shipdate as date)) as MthCalDt, l_discount, {_cents("l_extendedprice")} as price, {_cents("l_quantity")} as quantity from {{lineitem}}) group by 1, 2"""
_ANNUAL_IN_CENTS = f"""
select GVKEY, yr, {_total("amount")} as s_all, {", ".join(f"{_total('amount', f"o_orderstatus = '{s.upper()}'")} as s_{s}" for s in "fop")},
  {", ".join(f"{_total('amount', f"o_orderpriority like '{k}-%'")} as s_{k}" for k in range(1, 6))}
from (select cast(c_nationkey as bigint) as GVKEY, cast(year(o_orderdate) as int) as yr, o_orderstatus, o_orderpriority, {_cents("o_totalprice")} as amount
  from {{orders}} join {{customer}} on o_custkey = c_custkey) group by 1, 2"""


def relations(spark: SparkSession, sf_dir: str, written: tuple[str, ...] = ()) -> dict[str, DataFrame]:
    """The derived tables over the Parquet files of a folder; those of `written` are computed once and read back by all that follows."""
    spark.conf.set("spark.sql.codegen.hugeMethodLimit", HOT_METHOD)
    known = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in _TABLES}
    known |= {"monthly": spark.sql(_MONTHLY_IN_CENTS, lineitem=known["lineitem"]), "annual": spark.sql(_ANNUAL_IN_CENTS, orders=known["orders"], customer=known["customer"])}
    out: dict[str, DataFrame] = {}
    for name, text in RELATIONS.items():
        text = text.replace(f"({MONTHLY})", "{monthly}").replace(f"({ANNUAL})", "{annual}")
        used = {k: v for k, v in (known | out).items() if "{" + k + "}" in text}
        made = spark.sql(text, **used)
        out[name] = materialize(made, name) if name in written else made
    return out


def by_raw_name(t: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """The same tables under the names of the raw datasets."""
    names = {"crsp": "crsp_monthly_stock", "fund": "compustat_fundamentals_annual", "links": "ccm_link_table", "delist": "crsp_delisting", "factors": "fama_french_5f_momentum_monthly"}
    return {names[k]: v for k, v in t.items()}


def ctes(*names: str) -> str:
    """'crsp as (...), ...' for other engines."""
    plain = {t: t for t in (*_TABLES, *RELATIONS)}
    return ",\n".join(f"{n} as ({RELATIONS[n].format(**plain)})" for n in names)

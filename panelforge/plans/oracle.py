"""The same results in plain SQL for another engine: the panel as common table expressions, the features as expressions."""

from __future__ import annotations

from panelforge.plans.relations import ITEMS, RELATIONS, ctes

_ITEMS = tuple(ITEMS)
_GROWTH = ("at_proxy", "revt", "capx", "invt", "rect", "ppent", "seq")
_LABELS = ("asset", "sales", "capx", "inventory", "receivables", "ppent", "equity")
_AGE = "(year(p.MthCalDt) - year(a.available)) * 12 + month(p.MthCalDt) - month(a.available)"

LINKED = """
lk as (select * from (select *, row_number() over (partition by LPERMNO, LINKDT order by case LINKPRIM when 'P' then 1 when 'C' then 2 when 'J' then 3 when 'N' then 4 else 5 end, gvkey) as rn from links) where rn = 1),
linked as (select c.*, case when k.LINKENDDT is null or c.MthCalDt <= k.LINKENDDT then k.gvkey end as gvkey
  from crsp c asof left join lk k on c.PERMNO = k.LPERMNO and c.MthCalDt >= k.LINKDT)"""

ATTACHED = f"""
av as (select *, cast(datadate + interval 6 month as date) as available from fund),
attached as (select p.*, a.available as cst_available_date, {_AGE} as cst_age_months, coalesce({_AGE} > 12, false) as cst_expired,
  {", ".join(f"case when not coalesce({_AGE} > 12, false) then a.{c} end as cst_{c}" for c in _ITEMS)}
  from linked p asof left join av a on p.gvkey = a.GVKEY and p.MthCalDt >= a.available)"""

MASTER = """
delisted as (select p.*, d.DelRet, p.MthCalDt = max(p.MthCalDt) over (partition by p.PERMNO) as is_last_obs,
  p.MthCalDt = max(p.MthCalDt) over (partition by p.PERMNO) and d.PERMNO is not null as is_delisted from attached p left join delist d on p.PERMNO = d.PERMNO),
master as (select d.*, is_delisted and DelRet is null as delisting_return_missing,
  case when is_delisted and DelRet is not null then (1 + coalesce(MthRet, 0)) * (1 + DelRet) - 1 else MthRet end as ret_adj,
  f.mktrf as ff_mktrf, f.smb as ff_smb, f.hml as ff_hml, f.rmw as ff_rmw, f.cma as ff_cma, f.rf as ff_rf, f.umd as ff_umd
  from delisted d left join factors f on date_trunc('month', d.MthCalDt) = date_trunc('month', f.dateff))"""

_LAG = "lag({c}) over (partition by GVKEY order by datadate)"
GROWTH = f"""
grown as (select GVKEY, datadate, available, {", ".join(f"({c} - {_LAG.format(c=c)}) / case when {_LAG.format(c=c)} > 0 then abs({_LAG.format(c=c)}) end as {c}_growth" for c in _GROWTH)}
  from (select *, lt + seq as at_proxy from av))"""

READY = f"""
ready as (select *, coalesce(MthPrc >= 1 and MthCap > 0 and MthRetFlg <> 'NT', false) as is_investable, cst_available_date is not null and not cst_expired as has_fundamentals,
  mktcap_millions + total_debt + coalesce(cst_pstk, 0) - cst_che as enterprise_value, total_debt - cst_che as net_debt
  from (select p.*, p.MthCap / 1000 as mktcap_millions, p.MthPrc * p.MthVol / 1e6 as dollar_volume_millions, p.ShrOut * 1000 as shares_outstanding_actual, p.cst_lt + p.cst_seq as at_proxy,
    p.cst_seq - coalesce(p.cst_pstk, 0) + coalesce(p.cst_txditc, 0) as book_equity, p.cst_dlc + p.cst_dltt as total_debt,
    {", ".join(f"case when not coalesce({_AGE} > 12, false) then a.{c}_growth end as cst_{c}_growth" for c in _GROWTH)}
    from master p asof left join grown a on p.gvkey = a.GVKEY and p.MthCalDt >= a.available))"""


def _ratio(num: str, den: str) -> str:
    return f"{num} / case when {den} > 0 then {den} end"


def _roll(expr: str, count: str, n: int, least: int, first: int | None = None, last: int = 0) -> str:
    first = n - 1 if first is None else first
    frame = f"(partition by PERMNO order by MthCalDt rows between {first} preceding and {'current row' if last == 0 else f'{last} preceding'})"
    return f"case when count({count}) over {frame} >= {least} then {expr.replace('@', f'over {frame}')} end"


_LOG = "case when ret_adj > -1 then ln(1 + ret_adj) end"
_X, _Y = "ff_mktrf", "(ret_adj - ff_rf)"
_mean = lambda e: _roll(f"avg({e}) @", e, 24, 12)
_VX = f"({_mean(f'{_X} * {_X}')} - ({_mean(_X)}) * ({_mean(_X)}))"
_VY = f"({_mean(f'{_Y} * {_Y}')} - ({_mean(_Y)}) * ({_mean(_Y)}))"
_BETA = f"(({_mean(f'{_X} * {_Y}')} - ({_mean(_X)}) * ({_mean(_Y)})) / case when {_VX} > 0 then {_VX} end)"
_CAP = "case when mktcap_millions > 0 then mktcap_millions end"
_YEAR = "(partition by PERMNO order by MthCalDt rows between 11 preceding and current row)"

FEATURES = {
    "size_mktcap": _CAP, "size_log_mktcap": f"ln({_CAP})",
    "size_relative_mktcap": f"({_CAP}) / nullif(median(case when is_investable then {_CAP} end) over (partition by MthCalDt), 0)",
    "value_bm": _ratio("case when book_equity > 0 then book_equity end", "mktcap_millions"), "value_earnings_yield": _ratio("cst_ni", "mktcap_millions"),
    "value_cf_yield": _ratio("cst_oancf", "mktcap_millions"), "value_sales_to_price": _ratio("cst_revt", "mktcap_millions"),
    "value_ebitda_to_ev": _ratio("cst_ebitda", "enterprise_value"), "value_cf_to_ev": _ratio("cst_oancf", "enterprise_value"),
    "mom_1m": "ret_adj", **{f"mom_{n}m": _roll(f"exp(sum({_LOG}) @) - 1", _LOG, n, n) for n in (3, 6, 9, 12)},
    "mom_12_1": _roll(f"exp(sum({_LOG}) @) - 1", _LOG, 12, 12, 12, 1), "mom_6_1": _roll(f"exp(sum({_LOG}) @) - 1", _LOG, 6, 6, 6, 1), "reversal_1m": "ret_adj",
    "quality_roe": _ratio("cst_ni", "cst_seq"), "quality_roa": _ratio("cst_ni", "at_proxy"), "quality_gross_profitability": _ratio("cst_gp", "at_proxy"),
    "quality_operating_profitability": _ratio("(cst_revt - coalesce(cst_cogs, 0) - coalesce(cst_xsga, 0) - coalesce(cst_xint, 0))", "book_equity"),
    "quality_net_profit_margin": _ratio("cst_ni", "cst_revt"), "quality_gross_margin": _ratio("cst_gp", "cst_revt"), "quality_asset_turnover": _ratio("cst_revt", "at_proxy"),
    "quality_cf_profitability": _ratio("cst_oancf", "at_proxy"), "quality_cf_margin": _ratio("cst_oancf", "cst_revt"), "quality_accruals": _ratio("(cst_ni - cst_oancf)", "at_proxy"),
    **{f"growth_{label}": f"cst_{c}_growth" for c, label in zip(_GROWTH, _LABELS, strict=True)},
    "leverage_debt_to_assets": _ratio("total_debt", "at_proxy"), "leverage_debt_to_equity": _ratio("total_debt", "cst_seq"), "leverage_lt_debt_ratio": _ratio("cst_dltt", "at_proxy"),
    "leverage_current_ratio": _ratio("cst_act", "cst_lct"), "leverage_cash_ratio": _ratio("cst_che", "cst_lct"), "leverage_net_debt_to_assets": _ratio("net_debt", "at_proxy"),
    "leverage_interest_coverage": _ratio("cst_ebit", "cst_xint"), "liquidity_dollar_volume": "dollar_volume_millions", "liquidity_share_turnover": _ratio("MthVol", "shares_outstanding_actual"),
    "liquidity_amihud_illiq": _ratio("abs(ret_adj)", "dollar_volume_millions"),
    "vol_12m": _roll("stddev_samp(ret_adj) @", "ret_adj", 12, 6), "downside_vol_12m": _roll("stddev_samp(case when ret_adj < 0 then ret_adj end) @", "case when ret_adj < 0 then ret_adj end", 12, 6),
    "beta_24m": _BETA, "idio_vol_24m": f"sqrt(case when {_VY} - {_BETA} * {_BETA} * {_VX} is not null then greatest(0, {_VY} - {_BETA} * {_BETA} * {_VX}) end)",
    "max_ret_12m": _roll("max(ret_adj) @", "ret_adj", 12, 6), "min_ret_12m": _roll("min(ret_adj) @", "ret_adj", 12, 6), "skew_36m": _roll("skewness(ret_adj) @", "ret_adj", 36, 24),
}


def master_sql(select: str, more: str = "") -> str:
    """A query over master (and the tables below it)."""
    return f"with {ctes(*RELATIONS)},{LINKED},{ATTACHED},{MASTER}{',' + more if more else ''}\n{select}"


def ready_sql(select: str, more: str = "") -> str:
    """A query over ready: master with units, accounting, growth and flags."""
    return master_sql(select, f"{GROWTH},{READY}{',' + more if more else ''}")


def raw_sql(select: str, names: list[str], more: str = "") -> str:
    """A query over raw: keys and the named features."""
    keys = "PERMNO, MthCalDt, gvkey, is_investable, has_fundamentals"
    cols = ", ".join(f"{FEATURES[n]} as {n}" for n in names)
    return ready_sql(select, f"raw as (select {keys}, ret_adj, {cols} from ready){',' + more if more else ''}")


#: Whole numbers that may be null; both engines give them as doubles.
NULLABLE = ("gvkey", "cst_age_months", "l_partkey")

#: Quotients with more decimals than the others, so that rounding them falls on ties; they are rounded to 3 places.
COARSE = ("liquidity_dollar_volume", "dollar_volume_millions")


def shown(dates: str = "", ints: str = "", doubles: str = "", texts: str = "", digits: int = 6) -> str:
    """A select list in the form that both engines give: dates as text, counts and flags as bigint, doubles rounded."""
    out = [f"cast(cast({c} as date) as varchar) as {c}" for c in dates.split()] + [f"cast({c} as {'double' if c in NULLABLE else 'bigint'}) as {c}" for c in ints.split()]
    return ", ".join(out + [f"round({c}, {3 if c in COARSE else digits}) + 0.0 as {c}" for c in doubles.split()] + texts.split())


def least_squares(rows: str, by: str, y: str, xs: list[str]) -> str:
    """CTEs after a relation `rows`, which end in `fitted`: rows with w0 (constant), w1, ..., so that a group's sum of wi * y is the i-th coefficient, and the residual e.

    The columns are made orthogonal one after another, and the weights follow from the last to the first.
    """
    n, over = len(xs) + 1, f"over (partition by {by})"
    steps = [f"gs0 as (select *, cast(1 as double) as v0, {', '.join(f'cast({x} as double) as v{i}' for i, x in enumerate(xs, 1))} from {rows})"]
    for j in range(n):
        r = "".join(f", sum(v{k} * v{j}) {over} / sum(v{j} * v{j}) {over} as r{j}_{k}" for k in range(j + 1, n))
        less = ", ".join(f"v{k} - r{j}_{k} * v{j} as v{k}" for k in range(j + 1, n))
        steps.append(f"gs{j + 1} as (select *{f' replace ({less})' if less else ''} from (select *, sum(v{j} * v{j}) {over} as s{j}{r} from gs{j}))")
    inner = f"gs{n}"
    for k in reversed(range(n)):
        inner = f"(select *, v{k} / s{k}{''.join(f' - r{k}_{i} * w{i}' for i in range(k + 1, n))} as w{k} from {inner})"
    line = " + ".join(f"sum(w{i} * {y}) {over} * {x}" for i, x in enumerate(["1", *xs]))
    return ",\n".join([*steps, f"fitted as (select *, {y} - ({line}) as e from {inner})"])

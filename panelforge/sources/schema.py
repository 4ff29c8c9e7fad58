"""Specs of the six raw datasets: columns and types, keys, sentinels."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class DatasetSpec:
    """What is known of one raw file: its columns as DDL, its key, and by date column the texts that stand for no date."""

    name: str
    ddl: str
    key: tuple[str, ...] | None
    sentinels: dict[str, frozenset[str]]

    @property
    def filename(self) -> str:
        return f"{self.name}.csv"

    @property
    def types(self) -> dict[str, str]:
        return dict(part.split() for part in self.ddl.split(","))

    @property
    def date_columns(self) -> tuple[str, ...]:
        return tuple(c for c, kind in self.types.items() if kind == "DATE")

    @property
    def raw_ddl(self) -> str:
        """Dates are read as strings first, so that bad values can be counted."""
        return self.ddl.replace(" DATE", " STRING")


#: Names, types and keys of the raw tables; E ends a link that is still active.
DATASETS = {
    name: DatasetSpec(name, ddl, key, {"LINKENDDT": frozenset("E")} if name == "ccm_link_table" else {})
    for name, ddl, key in (
        (
            "crsp_monthly_stock",
            "PERMNO LONG, HdrCUSIP STRING, CUSIP STRING, Ticker STRING, PERMCO LONG, SICCD LONG, MthCalDt DATE, MthPrc DOUBLE, MthCap DOUBLE, MthRet DOUBLE, MthRetx DOUBLE, MthRetFlg STRING, MthVol DOUBLE, ShrOut LONG",
            ("PERMNO", "MthCalDt"),
        ),
        ("crsp_delisting", "PERMNO LONG, DelistingDt DATE, DelActionType STRING, DelReasonType STRING, DelPERMNO LONG, DelRet DOUBLE", ("PERMNO",)),
        ("crsp_names", "permno LONG, permco LONG, cusip STRING, ticker STRING, issuernm STRING, securitytype STRING, sharetype STRING, siccd LONG, primaryexch STRING", None),
        ("ccm_link_table", "gvkey LONG, tic STRING, LINKPRIM STRING, LIID STRING, LINKTYPE STRING, LPERMNO LONG, LPERMCO LONG, LINKDT DATE, LINKENDDT DATE", ("gvkey", "LIID", "LINKDT")),
        (
            "compustat_fundamentals_annual",
            "GVKEY LONG, datadate DATE, fyear LONG, indfmt STRING, consol STRING, popsrc STRING, datafmt STRING, curcd STRING, apdedate DATE, costat STRING, prcc_f DOUBLE, act DOUBLE, capx DOUBLE, ceq DOUBLE, "
            "che DOUBLE, cogs DOUBLE, csho DOUBLE, dlc DOUBLE, dltt DOUBLE, dp DOUBLE, ebit DOUBLE, ebitda DOUBLE, gp DOUBLE, ib DOUBLE, invt DOUBLE, lct DOUBLE, lt DOUBLE, ni DOUBLE, oancf DOUBLE, ppent DOUBLE, "
            "pstk DOUBLE, pstkr DOUBLE, rect DOUBLE, revt DOUBLE, sale DOUBLE, seq DOUBLE, sret DOUBLE, txdi DOUBLE, txditc DOUBLE, xint DOUBLE, xrd DOUBLE, xsga DOUBLE",
            ("GVKEY", "datadate"),
        ),
        ("fama_french_5f_momentum_monthly", "dateff DATE, mktrf DOUBLE, smb DOUBLE, hml DOUBLE, rmw DOUBLE, cma DOUBLE, rf DOUBLE, umd DOUBLE", ("dateff",)),
    )
}


def dataset(name: str) -> DatasetSpec:
    """The spec of that name; an unknown name raises KeyError."""
    if name not in DATASETS:
        raise KeyError(f"no dataset {name!r}; there are {', '.join(sorted(DATASETS))}")
    return DATASETS[name]

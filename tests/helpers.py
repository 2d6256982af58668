"""Build a Catalog from hand-written rows (missing relations are empty)."""

from __future__ import annotations

import datetime as dt
from decimal import Decimal

from blotter.sources.catalog import Catalog
from blotter.sources.schemas import SCHEMAS

SF_SMALL = "/root/testdata/sf0.001"
SF_MID = "/root/testdata/sf0.01"


def ts(y, m=1, d=1, hh=0, mm=0, ss=0):
    return dt.datetime(y, m, d, hh, mm, ss)


def money(x):
    return None if x is None else Decimal(str(x)).quantize(Decimal("0.01"))


STATUS = [("STATUS", "O", "Open - Active"), ("STATUS", "R", "Reopened"),
          ("STATUS", "C", "Closed"), ("STATUS", "N", None)]
REL = [("REL", "SU", "Suspect"), ("REL", "OF", "Offender"), ("REL", "VI", "Victim")]
CODES = {
    "offense_codes": [("OC1", "Theft one"), ("OC2", "Theft two"), ("OC3", "Other"),
                      ("OCL", "Listed")],
    "nibrs_offenses": [("OC1", "23C"), ("OC2", "23c"), ("OC3", "13B")],
    "nibrs_codes": [("23C", "Shoplifting"), ("13B", "Assault")],
    "ejs_codes": STATUS + REL,
    "role_codes": [("S", "Subject"), ("SP", "Suspect Primary"), ("V", "Victim")],
}


def make_catalog(spark, **rows) -> Catalog:
    data = dict(CODES)
    data.update(rows)
    tables = {}
    for name, schema in SCHEMAS.items():
        tables[name] = spark.createDataFrame(data.get(name, []), schema)
    return Catalog(tables)


def incident(iid, report, date, agency="TN0830400"):
    return (iid, report, agency, date)

"""Per-incident and per-report rollups.

Every rollup takes an optional ``keys`` DataFrame (cohort incident keys:
``incident_id, inc_report_number, agency_code``).  Without it the rollup covers
its whole input table, as the standalone definition does; with it the input is
first semi-joined to the cohort.  The rollups are only ever left/inner joined
back to the cohort on the same key, so the restricted and unrestricted forms
give the same report rows, while the restricted one aggregates only cohort
data.  Keys within the broadcast budget make that semi join map-side, which
keeps the input's storage partitioning: on the bucketed relations the
aggregation by incident id then adds no exchange.  Beyond the budget the semi
join shuffles on the key and the aggregation reuses that partitioning.
"""

from __future__ import annotations

import weakref

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from blotter.functions.bloom import may_match
from blotter.functions.joins import semi, within_bound, within_span
from blotter.functions.text import (
    collapse_spaces,
    flag,
    ordered_list_text,
    ordered_set_text,
    text_concat,
    upper_contains,
)
from blotter.operators.spans import filter_of, span_of
from blotter.params import CODE_SEP, DESC_SEP, LOSS_CODE, OPEN_WORD, RECOVERED_STATUS
from blotter.plans.materialize import materialize_sized
from blotter.sources.catalog import Catalog

MONEY_OUT = "decimal(38,2)"
REPORT_KEYS = ["agency_code", "inc_report_number"]


def _restrict(df: DataFrame, keys: DataFrame | None, col: str) -> DataFrame:
    if keys is None:
        return df
    df = may_match(within_span(df, col, span_of(keys)), [col], filter_of(keys, ("incident_id",)))
    ids = keys.select("incident_id")  # not renamed, so that all restrictions of a query share one broadcast
    return df.join(ids, df[col] == ids["incident_id"], "left_semi")


def _report_keys(keys: DataFrame | None) -> DataFrame | None:
    if keys is None:
        return None
    return keys.filter(F.col("inc_report_number").isNotNull()).select(*REPORT_KEYS)


def arrest_rows(cat: Catalog, keys: DataFrame | None, columns: tuple[str, ...]) -> DataFrame:
    a = cat.table("arrests", columns=columns + ("agency_code", "inc_report_number"),
                  where=lambda d: d["inc_report_number"].isNotNull()
                  & (d["inc_report_number"] != F.lit("")), nonblank=("inc_report_number",))
    rk = _report_keys(keys)
    if rk is None:
        return a
    return semi(may_match(a, REPORT_KEYS, filter_of(keys, tuple(REPORT_KEYS))), rk, REPORT_KEYS)


# -- two-hop rollups ---------------------------------------------------------
#
# Cases, addresses and roles hang off incidents through a first table (bridge,
# links, person rows).  Restricting that to the cohort is a map-side semi join.
# A single report joins the second table to it directly: stored bucketed on the
# join key, the second table is not exchanged.
#
# Several reports on one cohort (``report_set``) share the restricted first
# table: it is materialized once, its bytes observed by the write, and an id set
# within the broadcast budget also filters the second table map-side.

_SHARED_HOPS: "weakref.WeakKeyDictionary[DataFrame, dict]" = weakref.WeakKeyDictionary()


def share_first_hops(keys: DataFrame) -> None:
    """From now on first hops of the cohort ``keys`` are materialized and shared."""
    _SHARED_HOPS.setdefault(keys, {})


def first_hop(keys: DataFrame, name: str, df: DataFrame,
              restrict=None) -> DataFrame:
    """``df`` restricted to the cohort ``keys``; materialized once if they share hops."""
    rows = restrict(df, keys) if restrict else _restrict(df, keys, "incident_id")
    if keys not in _SHARED_HOPS:
        return rows
    memo = _SHARED_HOPS[keys]
    if name not in memo:
        memo[name] = materialize_sized(rows)
    return memo[name][0]


def by_first_hop(df: DataFrame, keys: DataFrame | None, name: str, col: str) -> DataFrame:
    """``df`` limited to the ids of a shared first hop that fits the budget; else ``df``."""
    hop = _SHARED_HOPS.get(keys, {}).get(name) if keys is not None else None
    if hop is None or not within_bound(hop[1].bytes):
        return df
    return semi(df, F.broadcast(hop[0].select(col)), col)


def _bridge(cat: Catalog, keys: DataFrame | None) -> DataFrame:
    bridge = cat.table("inc_case_inc_status_vw")
    return bridge if keys is None else first_hop(keys, "cases", bridge)


def _cases(cat: Catalog, keys: DataFrame | None, **kw) -> DataFrame:
    """Case rows; for a shared cohort, only those its bridge rows reach (after ``_bridge``)."""
    return by_first_hop(cat.table("incident_cases", **kw), keys, "cases", "inc_case_id")


def case_numbers(cat: Catalog, keys: DataFrame | None = None) -> DataFrame:
    """incident_id -> sorted distinct non-NULL case numbers joined by ', '."""
    bridge = _bridge(cat, keys)
    cases = _cases(cat, keys, columns=("inc_case_id", "inc_case_number"),
                   where=lambda d: d["inc_case_number"].isNotNull()
                   & (d["inc_case_number"] != F.lit("")))
    return (bridge.join(cases, "inc_case_id")
            .groupBy("incident_id")
            .agg(ordered_set_text("inc_case_number", CODE_SEP).alias("case_numbers")))


def _case_status(cat: Catalog, ic: DataFrame | None = None) -> DataFrame:
    """Cases with their status description (code table joined on two keys)."""
    if ic is None:
        ic = cat.table("incident_cases", columns=("inc_case_id", "case_status_code_type",
                                                  "case_status_code"))
    ec = cat.lookup("ejs_codes")
    return ic.join(ec, (ic["case_status_code_type"] == ec["code_type"])
                   & (ic["case_status_code"] == ec["code"]), "left").select(
        "inc_case_id", "description",
        flag(upper_contains("description", OPEN_WORD)).alias("is_open"))


def case_open_flags(cat: Catalog) -> DataFrame:
    """inc_case_id -> is_open (1 when the status description contains OPEN)."""
    return _case_status(cat).select("inc_case_id", "is_open")


_STATUS_COLS = ("inc_case_id", "case_status_code_type", "case_status_code")


def open_case_rows(cat: Catalog, keys: DataFrame | None = None) -> DataFrame:
    """incident_id -> is_open of each of its cases; dangling cases give NULL."""
    bridge = _bridge(cat, keys)
    flags = _case_status(cat, _cases(cat, keys, columns=_STATUS_COLS))
    return bridge.join(flags.select("inc_case_id", "is_open"), "inc_case_id", "left").select("incident_id", "is_open")


def incident_status(cat: Catalog, keys: DataFrame | None = None) -> DataFrame:
    """incident_id -> MAX(is_open) over its cases; dangling cases give NULL."""
    return open_case_rows(cat, keys).groupBy("incident_id").agg(F.max("is_open").alias("is_open"))


def incident_open_status(cat: Catalog, keys: DataFrame | None = None) -> DataFrame:
    """incident_id -> is_open and sorted distinct status descriptions ' | '."""
    bridge = _bridge(cat, keys)
    status = _case_status(cat, _cases(cat, keys, columns=_STATUS_COLS))
    return (bridge.join(status, "inc_case_id")
            .groupBy("incident_id")
            .agg(F.max("is_open").alias("is_open"),
                 ordered_set_text("description", DESC_SEP).alias("case_statuses")))


def case_facts(cat: Catalog, keys: DataFrame | None = None) -> DataFrame:
    """incident_id -> is_open, case_statuses and case_numbers, from one pass over its cases."""
    bridge = _bridge(cat, keys)
    ic = _cases(cat, keys, columns=(*_STATUS_COLS, "inc_case_number"))
    ec = cat.lookup("ejs_codes")
    cases = ic.join(ec, (ic["case_status_code_type"] == ec["code_type"])
                    & (ic["case_status_code"] == ec["code"]), "left")
    return (bridge.join(cases, "inc_case_id")
            .groupBy("incident_id")
            .agg(F.max(flag(upper_contains("description", OPEN_WORD))).alias("is_open"),
                 ordered_set_text("description", DESC_SEP).alias("case_statuses"),
                 ordered_set_text("inc_case_number", CODE_SEP).alias("case_numbers")))


# -- addresses --------------------------------------------------------------

def occurrence_address(a: str = "") -> F.Column:
    """One formatted address line from the address parts."""
    def c(n: str) -> F.Column:
        return F.col(a + n)
    zip4 = F.when(c("zip4").isNotNull(), F.concat(F.lit("-"), c("zip4").cast("string")))
    return collapse_spaces(text_concat(
        c("street_number"), F.lit(" "), c("dirct_cd_direction_code"), F.lit(" "),
        c("street_name"), F.lit(" "), c("street_cd_street_type_code"), F.lit(" "),
        c("sub_number"), F.lit(", "), c("city"), F.lit(", "), c("state_cd_state_code"),
        F.lit(" "), c("zip5"), zip4))


def occurrence_addresses(cat: Catalog, keys: DataFrame | None = None) -> DataFrame:
    """incident_id -> sorted distinct formatted addresses joined by ' | '."""
    ia = cat.table("incident_addresses")
    addresses = cat.table("addresses")
    if keys is not None:
        ia = first_hop(keys, "addresses", ia)
        addresses = by_first_hop(addresses, keys, "addresses", "address_id")
    return (ia.join(addresses, "address_id")
            .groupBy("incident_id")
            .agg(ordered_set_text(occurrence_address(), DESC_SEP)
                 .alias("occurrence_addresses")))


# -- arrests ----------------------------------------------------------------

def per_incident(keys: DataFrame, report_rollup: DataFrame) -> DataFrame:
    """A report-keyed rollup re-keyed to the cohort's incidents.

    An inner join on (agency, report number): NULL report numbers are dropped
    before its exchange (they never match), so they cannot pile up in one
    task; the result is then joined to cohort rows on ``incident_id``, which
    spreads evenly however many incidents share one report.
    """
    return keys.select("incident_id", *REPORT_KEYS).join(report_rollup, REPORT_KEYS) \
        .drop(*REPORT_KEYS)


def arrest_flags(cat: Catalog, keys: DataFrame | None = None) -> DataFrame:
    """(agency_code, inc_report_number) -> has_arrest = 1, one row per report."""
    return (arrest_rows(cat, keys, ()).select(*REPORT_KEYS).distinct()
            .withColumn("has_arrest", F.lit(1)))


def arrest_counts(cat: Catalog, keys: DataFrame | None = None) -> DataFrame:
    """(agency_code, inc_report_number) -> COUNT(DISTINCT arrest_id)."""
    return (arrest_rows(cat, keys, ("arrest_id",)).groupBy(*REPORT_KEYS)
            .agg(F.countDistinct("arrest_id").alias("arrest_count")))


def arrest_rollup(cat: Catalog, keys: DataFrame | None = None) -> DataFrame:
    """Report -> arrest count, ordered arrest numbers (duplicates kept), dates."""
    a = arrest_rows(cat, keys, ("arrest_id", "arrest_num", "arrest_date"))
    return a.groupBy(*REPORT_KEYS).agg(
        F.countDistinct("arrest_id").alias("arrest_count"),
        ordered_list_text("arrest_num", CODE_SEP).alias("arrest_numbers"),
        F.min("arrest_date").alias("first_arrest_date"),
        F.max("arrest_date").alias("last_arrest_date"))


# -- property ---------------------------------------------------------------

def _sum_value_if(cond: F.Column) -> F.Column:
    v = F.coalesce(F.col("value"), F.lit(0).cast("decimal(18,2)"))
    return F.sum(F.when(cond, v).otherwise(F.lit(0).cast("decimal(18,2)"))).cast(MONEY_OUT)


def property_loss(cat: Catalog, keys: DataFrame | None = None, *,
                  with_rows: bool = False) -> DataFrame:
    """incident_id -> loss (loss code) and recovered (recovered status) sums."""
    ip = _restrict(cat.table("incident_properties"), keys, "incsup_incident_id")
    aggs = [_sum_value_if(F.col("prop_loss_code") == F.lit(LOSS_CODE)).alias("total_loss_value"),
            _sum_value_if(F.col("status_code") == F.lit(RECOVERED_STATUS))
            .alias("total_recovered_value")]
    if with_rows:
        aggs.append(F.count(F.lit(1)).alias("property_rows"))
    return ip.groupBy(F.col("incsup_incident_id").alias("incident_id")).agg(*aggs)


def property_loss_rows(cat: Catalog, keys: DataFrame | None = None) -> DataFrame:
    """property_loss plus property_rows = number of property rows."""
    return property_loss(cat, keys, with_rows=True)


# -- vehicles ---------------------------------------------------------------

def vehicle_rows(cat: Catalog, keys: DataFrame | None) -> DataFrame:
    rows = cat.table("incident_vehicles")
    return rows if keys is None else first_hop(keys, "vehicles", rows)


def vehicle_counts(cat: Catalog, keys: DataFrame | None = None) -> DataFrame:
    """incident_id -> COUNT(DISTINCT vehicle_id) (NULL ids not counted)."""
    return (vehicle_rows(cat, keys).groupBy("incident_id")
            .agg(F.countDistinct("vehicle_id").alias("vehicle_count")))


def vehicle_rollup(cat: Catalog, keys: DataFrame | None = None) -> DataFrame:
    """incident_id -> vehicle count and text-sorted distinct ids ', '."""
    return (vehicle_rows(cat, keys).groupBy("incident_id")
            .agg(F.countDistinct("vehicle_id").alias("vehicle_count"),
                 ordered_set_text(F.col("vehicle_id").cast("string"), CODE_SEP)
                 .alias("vehicle_ids")))

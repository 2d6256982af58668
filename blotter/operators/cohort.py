"""Cohort selection: incident x offense rows of one agency, year and NIBRS code.

Plan shape (the point of writing it this way rather than joining in text order):

1. The code tables (bounded, broadcast) are joined into a small *code map* of
   offense codes that qualify, with their descriptions.
2. Incidents are read once, with the agency and a half-open date range pushed into
   the parquet scan (``year(col) = y`` would only push ``IsNotNull``); those left
   are written to the shared folder, and the write observes their real bytes.
3. Offense rows are matched to the code map map-side (broadcast hash join).
   Incidents within the broadcast budget are broadcast too, so offense rows meet
   them map-side and none is shuffled; more are joined on ``incident_id`` with
   the distinct (incident, code fields) rows, so an incident with a huge number of
   repeated offense rows costs only its distinct ones after the map-side combine.
4. The final DISTINCT is map-side combined (broadcast case) or runs within the
   join's partitioning (shuffle case).
"""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from blotter.functions.joins import broadcast_if_bounded, within_bound, within_span
from blotter.functions.text import any_of, upper_in
from blotter.operators.spans import filtered, span_of, spanned
from blotter.params import Params
from blotter.plans.materialize import Size, Span, materialize_spanned
from blotter.sources.catalog import Catalog

BASE_COLUMNS = ("incident_id", "inc_report_number", "agency_code", "report_date",
                "report_year", "offense_code", "offense_desc", "nibrs_code")
DESCRIBED_COLUMNS = BASE_COLUMNS + ("nibrs_desc",)
INCLUSIVE_COLUMNS = ("incident_id", "inc_report_number", "agency_code", "report_date",
                     "report_year", "offense_code", "offense_desc", "place_code",
                     "place_desc", "nibrs_code", "nibrs_desc")


def _ts(year: int) -> Column:
    return F.lit(dt.datetime(year, 1, 1).strftime("%Y-%m-%d %H:%M:%S")).cast("timestamp_ntz")


def cohort_incidents(cat: Catalog, p: Params) -> DataFrame:
    """Incidents of the agency reported in the year (filters reach the scan)."""
    y = int(p.report_year)

    def where(df: DataFrame) -> Column:
        cond = ((df["agncy_cd_agency_code"] == F.lit(p.agency))
                & (df["report_date"] >= _ts(y)) & (df["report_date"] < _ts(y + 1)))
        if p.report_number is not None:
            cond = cond & (F.upper(df["inc_report_number"]) == F.lit(p.report_number.upper()))
        return cond

    return cat.table("incidents", where=where).select(
        "incident_id", "inc_report_number",
        F.col("agncy_cd_agency_code").alias("agency_code"), "report_date")


def sized_incidents(cat: Catalog, p: Params) -> tuple[DataFrame, Size, Span | None]:
    """``cohort_incidents``, their size and the span of their ids: one scan filters, measures
    and writes them, and what follows reads the few that are left."""
    return materialize_spanned(cohort_incidents(cat, p), "incident_id")


def _nibrs_match(p: Params) -> Column:
    return F.coalesce(F.upper(F.col("nibrs_code")) == F.lit(p.nibrs.upper()), F.lit(False))


def code_map(cat: Catalog, p: Params, *, described: bool, inclusive: bool) -> DataFrame:
    """Qualifying offense codes with descriptions, built from the lookups only."""
    oc = cat.lookup("offense_codes")
    no = cat.lookup("nibrs_offenses").withColumnRenamed("offense_code", "no_offense_code")
    joined = oc.join(no, oc["offense_code"] == no["no_offense_code"],
                     "left" if inclusive else "inner")
    if described or inclusive:
        nc = cat.lookup("nibrs_codes").withColumnRenamed("nibrs_code", "nc_nibrs_code")
        joined = joined.join(nc, joined["nibrs_code"] == nc["nc_nibrs_code"], "left")
    cond = _nibrs_match(p)
    if inclusive and p.extra_offense_codes:
        cond = any_of(cond, upper_in("offense_code", tuple(p.extra_offense_codes)))
    cols = ["offense_code", "offense_desc", "nibrs_code"]
    if described or inclusive:
        cols.append("nibrs_desc")
    # The map is a join of bounded lookups; its own size is checked the same way.
    return cat.bounded(f"code_map:{p.nibrs}:{p.extra_offense_codes}:{described}:{inclusive}",
                       joined.filter(cond).select(*cols))


def _offense_rows(cat: Catalog, p: Params, *, described: bool, inclusive: bool,
                  span: Span | None) -> tuple[DataFrame, list[str]]:
    """Qualifying offense rows with their code fields, matched map-side."""
    cmap = code_map(cat, p, described=described, inclusive=inclusive)
    off_cols = ("inc_incident_id", "offns_cd_offense_code") + (
        ("place_code_type", "place_place_code") if inclusive else ())
    off = within_span(cat.table("offenses", columns=off_cols), "inc_incident_id", span)
    rows = off.join(cmap, off["offns_cd_offense_code"] == cmap["offense_code"], "inner")
    fields = list(cmap.columns)
    if inclusive:
        ep = cat.lookup("ejs_codes").select(
            F.col("code_type").alias("ep_type"), F.col("code").alias("ep_code"),
            F.col("description").alias("place_desc"))
        rows = rows.join(ep, (rows["place_code_type"] == ep["ep_type"])
                         & (rows["place_place_code"] == ep["ep_code"]), "left")
        rows = rows.withColumnRenamed("place_place_code", "place_code")
        fields += ["place_code", "place_desc"]
    return rows.select("inc_incident_id", *fields), fields


def _cohort(cat: Catalog, p: Params, cols: tuple[str, ...], *, described: bool,
            inclusive: bool) -> DataFrame:
    """Cohort rows; the join strategy follows the measured size of the incidents.

    * Within the broadcast budget they are broadcast and offense rows meet them
      map-side: no offense row is shuffled at all, only the cohort rows for
      the final DISTINCT (map-side combined).
    * Beyond it, offense rows are reduced to their distinct code fields per
      incident (map-side combined) and joined on ``incident_id``.
    """
    inc, size, span = sized_incidents(cat, p)
    rows, fields = _offense_rows(cat, p, described=described, inclusive=inclusive, span=span)
    year = F.year("report_date").alias("report_year")
    if within_bound(size.bytes):
        inc = F.broadcast(inc)
    else:
        rows = rows.distinct()
    out = rows.join(inc, rows["inc_incident_id"] == inc["incident_id"]).select(
        "incident_id", "inc_report_number", "agency_code", "report_date", year, *fields)
    return out.select(*cols).distinct()


def cohort_incident_keys(cat: Catalog, p: Params) -> DataFrame:
    """Distinct cohort incidents (id, report number, agency, report date).

    The KPI needs no code columns, so this is the incidents that have a
    qualifying offense row, by the same size-checked strategy as ``_cohort``.
    """
    inc, size, span = sized_incidents(cat, p)
    cmap = code_map(cat, p, described=False, inclusive=False)
    off = within_span(cat.table("offenses", columns=("inc_incident_id", "offns_cd_offense_code")),
                      "inc_incident_id", span)
    off = off.join(cmap.select("offense_code"),
                   off["offns_cd_offense_code"] == cmap["offense_code"], "left_semi")
    if within_bound(size.bytes):
        b = F.broadcast(inc)
        joined = off.join(b, off["inc_incident_id"] == b["incident_id"])
        return joined.select(*inc.columns).distinct()
    ids = off.select(F.col("inc_incident_id").alias("incident_id")).distinct()
    return inc.join(ids, "incident_id", "left_semi").distinct()


def cohort_base(cat: Catalog, p: Params) -> DataFrame:
    """Distinct cohort rows without the NIBRS description (the KPI cohort)."""
    return _cohort(cat, p, BASE_COLUMNS, described=False, inclusive=False)


def cohort_described(cat: Catalog, p: Params) -> DataFrame:
    """Distinct cohort rows with the NIBRS description (the proofs' cohort)."""
    return _cohort(cat, p, DESCRIBED_COLUMNS, described=True, inclusive=False)


def cohort_inclusive(cat: Catalog, p: Params) -> DataFrame:
    """NIBRS match or a listed offense code; adds place code and description."""
    return _cohort(cat, p, INCLUSIVE_COLUMNS, described=True, inclusive=True)


def cohort_keys(cohort: DataFrame, size: Size | None = None, span: Span | None = None) -> DataFrame:
    """Distinct incident keys of a (materialized) cohort, for restricting rollups.

    Broadcast-hinted when the cohort rows fit the broadcast budget, so every
    semi join restricting a rollup to the cohort filters map-side; beyond it, Bloom
    filters drop most other rows before they are shuffled.  With a ``span``, scans
    skip what lies outside it.
    """
    keys = cohort.select("incident_id", "inc_report_number", "agency_code").distinct()
    return known_keys(keys, size, span)


def known_keys(keys: DataFrame, size: Size | None, span: Span | None) -> DataFrame:
    """``keys`` with what restricts scans by them: broadcast if ``size`` (of rows that they were
    taken from) is within the budget, else Bloom filters; and the span of their ids."""
    if size is not None and not within_bound(size.bytes):
        return spanned(filtered(keys, size.rows), span)
    return spanned(broadcast_if_bounded(keys, proof=None if size is None else size.bytes), span)


def written_cohort(rows: DataFrame) -> tuple[DataFrame, DataFrame, Size]:
    """A cohort written once: its rows, its keys with the span of their ids, and its size."""
    ri, size, span = materialize_spanned(rows, "incident_id")
    return ri, cohort_keys(ri, size, span), size


@dataclass(frozen=True, eq=False)
class Cohort:
    """A materialized cohort and its (bound-checked, maybe broadcast) keys.

    Sharing one instance between reports shares the cohort, its incident ``facts``
    if they are written (and, after ``rollups.share_first_hops(keys)``, the
    first-hop tables of its keys).
    """

    rows: DataFrame
    keys: DataFrame
    size: Size
    facts: DataFrame | None = None

    @classmethod
    def of(cls, rows: DataFrame) -> "Cohort":
        """Writes the rows once."""
        return cls(*written_cohort(rows))

    def with_facts(self, facts: DataFrame) -> "Cohort":
        return replace(self, facts=facts)

    def narrowed(self, p: Params) -> "Cohort":
        """The described cohort inside an inclusive one: its rows of the NIBRS code, without places."""
        rows = self.rows.filter(_nibrs_match(p)).select(*DESCRIBED_COLUMNS).distinct()
        return Cohort(rows, cohort_keys(rows, self.size, span_of(self.keys)), self.size, self.facts)

    def incidents(self) -> DataFrame:
        """Distinct incidents (id, report number, agency, report date)."""
        return self.rows.select("incident_id", "inc_report_number", "agency_code",
                                "report_date").distinct()

"""Proof extracts: the rows behind each KPI, for auditing by eye.

Six grouped proofs (one row per report) share a head of columns; three detail
proofs list incident x offense or vehicle-link rows.  All are sorted as the
extracts are (ascending, NULLs last).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from blotter.functions.text import ordered_set_text
from blotter.operators import cohort as co
from blotter.operators import facts as fa
from blotter.operators import rollups as ro
from blotter.params import CODE_SEP, DESC_SEP, Params
from blotter.sources.catalog import Catalog

HEAD = ("report_year", "agency_code", "report_number", "incident_id", "case_numbers",
        "report_date", "offense_codes", "offense_descs", "nibrs_codes", "nibrs_descs")
EVIDENCE = ("suspect_count", "matched_role_type_rows", "matched_role_desc_rows",
            "matched_suspect_rows", "matched_offender_rows", "matched_suspus_rows",
            "matched_relation_code_rows", "excluded_arrest_rows")


#: The sort keys of each proof, ascending, NULLs last.
ORDER = {
    "proof_total_reports": ("report_date", "report_number", "incident_id", "offense_code"),
    "proof_total_reports_inclusive": ("report_date", "report_number", "incident_id", "offense_code"),
    "proof_total_vehicles_linked": ("report_date", "report_number", "vehicle_id"),
    **dict.fromkeys(("proof_reports_with_arrest", "proof_open_reports", "proof_closed_by_other_means",
                     "proof_summed_loss_value", "proof_avg_suspects", "proof_reports_with_vehicle_info"),
                    ("report_date", "report_number")),
}


def _asc(*cols: str) -> list[Column]:
    return [F.col(c).asc_nulls_last() for c in cols]


def described_cohort(cat: Catalog, p: Params) -> co.Cohort:
    """The proofs' cohort, materialized once; pass it to several proofs to share it."""
    return co.Cohort.of(co.cohort_described(cat, p))


def _cohort_with(cat: Catalog, p: Params, cohort: co.Cohort | None, *parts: str) -> DataFrame:
    """Cohort rows with the facts of ``parts``: those of the shared cohort, or computed here."""
    c = cohort or described_cohort(cat, p)
    facts = fa.incident_facts(cat, c.keys, parts) if c.facts is None else c.facts
    return c.rows.join(facts, "incident_id", "left")


def _per_report(rows: DataFrame, tail: list[Column], tail_names: tuple[str, ...]) -> DataFrame:
    """Group cohort rows by report: the common head plus the proof's tail."""
    g = rows.groupBy("agency_code", "inc_report_number").agg(
        F.min("report_year").alias("report_year"),
        F.min("incident_id").alias("incident_id"),
        F.max("case_numbers").alias("case_numbers"),
        F.min("report_date").alias("report_date"),
        ordered_set_text("offense_code", CODE_SEP).alias("offense_codes"),
        ordered_set_text("offense_desc", DESC_SEP).alias("offense_descs"),
        ordered_set_text("nibrs_code", CODE_SEP).alias("nibrs_codes"),
        ordered_set_text("nibrs_desc", DESC_SEP).alias("nibrs_descs"),
        *tail)
    g = g.withColumnRenamed("inc_report_number", "report_number")
    return g.select(*HEAD, *tail_names).orderBy(*_asc(*ORDER["proof_summed_loss_value"]))


def proof_total_reports(cat: Catalog, p: Params,
                        cohort: co.Cohort | None = None) -> DataFrame:
    """Detail rows behind total_reports: one per incident x offense."""
    rows = _cohort_with(cat, p, cohort, "case_numbers")
    return rows.select(
        "report_year", "agency_code", "incident_id",
        F.col("inc_report_number").alias("report_number"), "case_numbers", "report_date",
        "offense_code", "offense_desc", "nibrs_code", "nibrs_desc",
    ).orderBy(*_asc(*ORDER["proof_total_reports"]))


def inclusive_cohort(cat: Catalog, p: Params) -> co.Cohort:
    """The wide cohort, materialized once."""
    return co.Cohort.of(co.cohort_inclusive(cat, p))


def proof_total_reports_inclusive(cat: Catalog, p: Params, cohort: co.Cohort | None = None) -> DataFrame:
    """Wide detail rows: listed offense codes too, with address and place; ``cohort`` is an inclusive one."""
    c = cohort or inclusive_cohort(cat, p)
    addresses = ro.occurrence_addresses(cat, c.keys)
    rows = _cohort_with(cat, p, c, "case_numbers").join(addresses, "incident_id", "left")
    return rows.select(
        "report_year", "agency_code", "incident_id",
        F.col("inc_report_number").alias("report_number"), "case_numbers",
        F.col("occurrence_addresses").alias("offense_address"), "report_date",
        "offense_code", "offense_desc", "place_code", "place_desc", "nibrs_code", "nibrs_desc",
    ).orderBy(*_asc(*ORDER["proof_total_reports_inclusive"]))


def proof_reports_with_arrest(cat: Catalog, p: Params,
                              cohort: co.Cohort | None = None) -> DataFrame:
    """Reports with at least one arrest on the same report number and agency."""
    rows = _cohort_with(cat, p, cohort, "case_numbers", "arrests").filter(F.col("has_arrest") == 1)
    names = ("arrest_count", "arrest_numbers", "first_arrest_date", "last_arrest_date")
    return _per_report(rows, [F.max(c).alias(c) for c in names], names)


def proof_open_reports(cat: Catalog, p: Params,
                       cohort: co.Cohort | None = None) -> DataFrame:
    """Reports with an incident whose case status reads open."""
    rows = _cohort_with(cat, p, cohort, "cases").filter(F.col("is_open") == 1)
    return _per_report(rows, [F.max("case_statuses").alias("case_statuses")],
                       ("case_statuses",))


def proof_closed_by_other_means(cat: Catalog, p: Params,
                                cohort: co.Cohort | None = None) -> DataFrame:
    """Reports with an incident neither open nor arrested."""
    rows = _cohort_with(cat, p, cohort, "cases", "arrest_counts")
    rows = rows.filter((F.coalesce(F.col("is_open"), F.lit(0)) == 0)
                       & (F.coalesce(F.col("arrest_count"), F.lit(0)) == 0))
    return _per_report(rows, [
        F.max("case_statuses").alias("case_statuses"),
        F.coalesce(F.max("arrest_count"), F.lit(0).cast("long")).alias("arrest_count"),
    ], ("case_statuses", "arrest_count"))


def proof_summed_loss_value(cat: Catalog, p: Params,
                            cohort: co.Cohort | None = None) -> DataFrame:
    """Every cohort report with its loss, recovered value and property rows."""
    rows = _cohort_with(cat, p, cohort, "case_numbers", "loss")
    zero = F.lit(0).cast(ro.MONEY_OUT)
    return _per_report(rows, [
        F.max(F.coalesce("total_loss_value", zero)).alias("total_loss_value"),
        F.max(F.coalesce("total_recovered_value", zero)).alias("total_recovered_value"),
        F.max(F.coalesce("property_rows", F.lit(0).cast("long"))).alias("property_rows"),
    ], ("total_loss_value", "total_recovered_value", "property_rows"))


def proof_avg_suspects(cat: Catalog, p: Params,
                       cohort: co.Cohort | None = None) -> DataFrame:
    """Every cohort report with suspect count and the matched-row evidence."""
    rows = _cohort_with(cat, p, cohort, "case_numbers", "suspects")
    zero = F.lit(0).cast("long")
    return _per_report(rows, [F.max(F.coalesce(c, zero)).alias(c) for c in EVIDENCE],
                       EVIDENCE)


def proof_reports_with_vehicle_info(cat: Catalog, p: Params,
                                    cohort: co.Cohort | None = None) -> DataFrame:
    """Reports with an incident that has at least one non-NULL vehicle id."""
    rows = _cohort_with(cat, p, cohort, "case_numbers", "vehicles").filter(F.col("vehicle_count") > 0)
    return _per_report(rows, [F.max("vehicle_count").alias("vehicle_count"),
                              F.max("vehicle_ids").alias("vehicle_ids")],
                       ("vehicle_count", "vehicle_ids"))


LINK_COLUMNS = ("report_year", "agency_code", "report_number", "case_numbers", "report_date",
                "incident_id", "vehicle_id", "role_code", "status_code", "date_recovered")


def vehicle_links(cat: Catalog, p: Params, cohort: co.Cohort | None = None,
                  links: DataFrame | None = None) -> DataFrame:
    """Distinct cohort x case numbers x vehicle link rows (NULL vehicles kept).

    ``links``: the link rows of a cohort that holds this one, if they are at hand.
    """
    cohort = cohort or described_cohort(cat, p)
    rows = _cohort_with(cat, p, cohort, "case_numbers")
    iv = ro.vehicle_rows(cat, cohort.keys) if links is None else links
    return rows.join(iv, "incident_id").select(
        F.col("report_year"), F.col("agency_code"),
        F.col("inc_report_number").alias("report_number"), "incident_id", "report_date",
        "case_numbers", "vehicle_id", "role_code", "status_code", "date_recovered",
    ).distinct().select(*LINK_COLUMNS)


def proof_total_vehicles_linked(cat: Catalog, p: Params, cohort: co.Cohort | None = None,
                                links: DataFrame | None = None) -> DataFrame:
    """Vehicle link rows sorted by report date, report number, vehicle."""
    return vehicle_links(cat, p, cohort, links).orderBy(*_asc(*ORDER["proof_total_vehicles_linked"]))

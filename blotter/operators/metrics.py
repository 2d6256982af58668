"""KPI layers: incident metrics -> report metrics -> one summary row.

Grain rules kept from the definition:

* an incident's metrics do not depend on its offense rows, and a report takes
  the MAX over its incidents (not the SUM: several incidents of one report
  contribute only their largest loss, suspect count and vehicle count);
* a report number that is NULL still forms one report group;
* closed-by-other-means is decided per incident, before the MAX.

``report_metrics``/``metrics_summary`` therefore start from the cohort's
distinct *incidents* (a semi join of filtered incidents against qualifying
offense rows) rather than the incident x offense rows; the MAX per report is
the same, and the wide offense join is skipped.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from blotter.functions.joins import broadcast_if_bounded
from blotter.functions.text import flag
from blotter.operators import cohort as co
from blotter.operators import facts as fa
from blotter.operators import rollups as ro
from blotter.params import Params
from blotter.plans.materialize import materialize_spanned
from blotter.sources.catalog import Catalog

MONEY_OUT = ro.MONEY_OUT
# A row of the KPI's facts (an id and six numbers) is at most so many times as wide as
# a cohort row, which holds an id, a timestamp and two texts.
FACTS_ROW = 4
METRIC_COLUMNS = ("has_arrest", "is_open", "closed_by_other_means", "total_loss_value",
                  "total_recovered_value", "suspect_count", "vehicle_count",
                  "has_vehicle_info")


def _kpi_facts(cat: Catalog, keys: DataFrame, n_bytes: int) -> DataFrame:
    """The five rollups of the KPI; at most one narrow row per cohort incident, so the
    cohort's measured bytes (``n_bytes``) bound them."""
    return broadcast_if_bounded(fa.incident_facts(cat, keys, fa.KPI), proof=FACTS_ROW * n_bytes)


def _with_metrics(rows: DataFrame, facts: DataFrame) -> DataFrame:
    """Attach the facts to cohort rows by one join on incident_id."""
    m = rows.join(facts.select("incident_id", "has_arrest", "is_open", "total_loss_value", "total_recovered_value",
                               "suspect_count", "vehicle_count"), "incident_id", "left")
    has_arrest = F.coalesce(F.col("has_arrest"), F.lit(0))
    is_open = F.coalesce(F.col("is_open"), F.lit(0))
    zero = F.lit(0).cast(MONEY_OUT)
    vehicles = F.coalesce(F.col("vehicle_count"), F.lit(0).cast("long"))
    return m.select(
        *[c for c in rows.columns],
        has_arrest.alias("has_arrest"),
        is_open.alias("is_open"),
        flag((is_open == 0) & (has_arrest == 0)).alias("closed_by_other_means"),
        F.coalesce(F.col("total_loss_value"), zero).alias("total_loss_value"),
        F.coalesce(F.col("total_recovered_value"), zero).alias("total_recovered_value"),
        F.coalesce(F.col("suspect_count"), F.lit(0).cast("long")).alias("suspect_count"),
        vehicles.alias("vehicle_count"),
        flag(vehicles > 0).alias("has_vehicle_info"))


def incident_metrics(cat: Catalog, p: Params) -> DataFrame:
    """Cohort rows (incident x offense) with the eight per-incident metrics."""
    ri, keys, size = co.written_cohort(co.cohort_base(cat, p))
    ri = ri.select("incident_id", "inc_report_number", "report_date", "agency_code",
                   "offense_code", "offense_desc")
    return _with_metrics(ri, _kpi_facts(cat, keys, size.bytes))


def report_metrics(cat: Catalog, p: Params, cohort: co.Cohort | None = None) -> DataFrame:
    """One row per (agency, report number): MIN year and MAX of each metric.

    Standalone it starts from the cohort's distinct incidents; given a shared
    ``Cohort`` (e.g. the proofs') it reuses that one and its facts.
    """
    if cohort is None:
        inc, size, span = materialize_spanned(co.cohort_incident_keys(cat, p), "incident_id")
        facts = _kpi_facts(cat, co.known_keys(inc, size, span), size.bytes)
    else:
        inc = cohort.incidents()
        facts = _kpi_facts(cat, cohort.keys, cohort.size.bytes) if cohort.facts is None else cohort.facts
    m = _with_metrics(inc, facts)
    return m.groupBy("agency_code", "inc_report_number").agg(
        F.min(F.year("report_date")).alias("report_year"),
        *[F.max(c).alias(c) for c in METRIC_COLUMNS])


def metrics_summary(cat: Catalog, p: Params, cohort: co.Cohort | None = None) -> DataFrame:
    """The yearly KPI row (one row even for an empty cohort)."""
    r = report_metrics(cat, p, cohort)
    return r.agg(
        F.lit(int(p.report_year)).alias("report_year"),
        F.count(F.lit(1)).alias("total_reports"),
        F.sum("has_arrest").alias("reports_with_arrest"),
        F.sum("is_open").alias("open_reports"),
        F.sum("closed_by_other_means").alias("closed_by_other_means_reports"),
        F.sum("total_loss_value").cast(MONEY_OUT).alias("summed_loss_value"),
        F.sum("total_recovered_value").cast(MONEY_OUT).alias("summed_recovered_value"),
        F.avg("suspect_count").alias("avg_suspects_per_report"),
        F.sum("has_vehicle_info").alias("reports_with_vehicle_info"),
        F.sum("vehicle_count").alias("total_vehicles_linked"))

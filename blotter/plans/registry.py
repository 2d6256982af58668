"""Named queries: every data product as ``(spark, sf_dir) -> DataFrame``.

The test tables under ``sf_dir`` are TPC-H style; the 16 input relations are
derived from them by Spark and written once as parquet
(``blotter.sources.fixtures``), so every query reads its whole input and its
work grows with the scale factor.  Catalogs are cached per application and
directory so the derivation and the lookup-size checks run once.
"""

from __future__ import annotations

import threading
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from blotter.operators import cohort as co
from blotter.operators import metrics as me
from blotter.operators import proofs as pr
from blotter.operators import rollups as ro
from blotter.operators import suspects as su
from blotter.params import Params
from blotter.sources.catalog import Catalog
from blotter.sources.fixtures import fixture_catalog

_CATALOGS: dict[tuple[str, str], Catalog] = {}
_LOCK = threading.Lock()


def catalog_for(spark: SparkSession, sf_dir: str) -> Catalog:
    key = (spark.sparkContext.applicationId, sf_dir)
    with _LOCK:  # one writer of the derived relations per session and directory
        if key not in _CATALOGS:
            _CATALOGS[key] = fixture_catalog(spark, sf_dir)
        return _CATALOGS[key]


def _cohort_query(fn: Callable[[Catalog, Params], DataFrame]):
    def run(spark: SparkSession, sf_dir: str, params: Params | None = None) -> DataFrame:
        return fn(catalog_for(spark, sf_dir), params or Params())
    run.__name__ = fn.__name__
    run.__doc__ = fn.__doc__
    return run


def _table_query(fn: Callable[..., DataFrame]):
    """A rollup over its whole input (no cohort restriction)."""
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return fn(catalog_for(spark, sf_dir))
    run.__name__ = fn.__name__
    run.__doc__ = fn.__doc__
    return run


QUERIES: dict[str, Callable[..., DataFrame]] = {
    # cohorts
    "cohort_base": _cohort_query(co.cohort_base),
    "cohort_described": _cohort_query(co.cohort_described),
    "cohort_inclusive": _cohort_query(co.cohort_inclusive),
    # per-incident and per-report rollups (whole tables)
    "case_numbers": _table_query(ro.case_numbers),
    "occurrence_addresses": _table_query(ro.occurrence_addresses),
    "arrest_flags": _table_query(ro.arrest_flags),
    "arrest_counts": _table_query(ro.arrest_counts),
    "arrest_rollup": _table_query(ro.arrest_rollup),
    "case_open_flags": _table_query(ro.case_open_flags),
    "incident_status": _table_query(ro.incident_status),
    "incident_open_status": _table_query(ro.incident_open_status),
    "property_loss": _table_query(ro.property_loss),
    "property_loss_rows": _table_query(ro.property_loss_rows),
    "suspect_counts": _table_query(su.suspect_counts),
    "suspect_evidence": _table_query(su.suspect_evidence),
    "vehicle_counts": _table_query(ro.vehicle_counts),
    "vehicle_rollup": _table_query(ro.vehicle_rollup),
    "vehicle_links": _cohort_query(pr.vehicle_links),
    # metric layers
    "incident_metrics": _cohort_query(me.incident_metrics),
    "report_metrics": _cohort_query(me.report_metrics),
    "metrics_summary": _cohort_query(me.metrics_summary),
    # proof extracts
    "proof_total_reports": _cohort_query(pr.proof_total_reports),
    "proof_total_reports_inclusive": _cohort_query(pr.proof_total_reports_inclusive),
    "proof_reports_with_arrest": _cohort_query(pr.proof_reports_with_arrest),
    "proof_open_reports": _cohort_query(pr.proof_open_reports),
    "proof_closed_by_other_means": _cohort_query(pr.proof_closed_by_other_means),
    "proof_summed_loss_value": _cohort_query(pr.proof_summed_loss_value),
    "proof_avg_suspects": _cohort_query(pr.proof_avg_suspects),
    "proof_reports_with_vehicle_info": _cohort_query(pr.proof_reports_with_vehicle_info),
    "proof_total_vehicles_linked": _cohort_query(pr.proof_total_vehicles_linked),
}

FLAGSHIP = "metrics_summary"

"""Metamorphic checks."""

from helpers import SF_SMALL
from pyspark.sql import functions as F

from blotter.operators import cohort as co
from blotter.operators import metrics as me
from blotter.operators import rollups as ro
from blotter.operators import suspects as su
from blotter.params import Params
from blotter.plans.materialize import materialize
from blotter.plans.registry import catalog_for
from blotter.sources.catalog import Catalog
from blotter.sources.schemas import RELATIONS

P = Params()


def _same(a, b):
    return a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0


def _kpi(cat):
    return me.metrics_summary(cat, P).collect()[0].asDict()


def test_pruned_rollups_equal_unpruned_on_cohort(spark):
    cat = catalog_for(spark, SF_SMALL)
    ri = materialize(co.cohort_described(cat, P))
    keys = co.cohort_keys(ri)
    ids = keys.select("incident_id")
    for fn in (ro.case_numbers, ro.incident_status, ro.incident_open_status,
               ro.property_loss_rows, ro.vehicle_rollup, ro.occurrence_addresses,
               su.suspect_counts, su.suspect_evidence):
        pruned = fn(cat, keys)
        whole = fn(cat).join(ids, "incident_id", "left_semi")
        assert _same(pruned, whole.select(*pruned.columns)), fn.__name__
    rk = keys.select("agency_code", "inc_report_number")
    for fn in (ro.arrest_flags, ro.arrest_counts, ro.arrest_rollup):
        pruned = fn(cat, keys)
        whole = fn(cat).join(rk, ["agency_code", "inc_report_number"], "left_semi")
        assert _same(pruned, whole.select(*pruned.columns)), fn.__name__


def test_duplicated_bridge_and_outside_rows_leave_kpi_unchanged(spark):
    cat = catalog_for(spark, SF_SMALL)
    base = _kpi(cat)
    raw = {n: cat.raw(n) for n in RELATIONS}
    dup = dict(raw, inc_case_inc_status_vw=raw["inc_case_inc_status_vw"].unionAll(
        raw["inc_case_inc_status_vw"]))
    assert _kpi(Catalog(dup)) == base
    # incidents of another agency and year, with offenses that would qualify
    extra_inc = raw["incidents"].select(
        (F.col("incident_id") + 10_000_000).alias("incident_id"), "inc_report_number",
        F.lit("OTHER").alias("agncy_cd_agency_code"), "report_date")
    extra_off = raw["offenses"].select(
        (F.col("inc_incident_id") + 10_000_000).alias("inc_incident_id"),
        "offns_cd_offense_code", "place_code_type", "place_place_code")
    outside = dict(raw, incidents=raw["incidents"].unionByName(extra_inc),
                   offenses=raw["offenses"].unionByName(extra_off))
    assert _kpi(Catalog(outside)) == base


def test_report_set_equals_single_reports(spark):
    from blotter.operators import proofs as pr
    from blotter.operators.reports import report_set
    cat = catalog_for(spark, SF_SMALL)
    shared = report_set(cat, P)
    assert len(shared) == 10
    for name, df in shared.items():
        alone = (me.metrics_summary if name == "metrics_summary" else getattr(pr, name))(cat, P)
        assert _same(df, alone), name


def test_empty_year_runs_every_report(spark):
    """A year without data: empty materialized cohort, empty proofs, one KPI row."""
    from blotter.operators.reports import report_set
    cat = catalog_for(spark, SF_SMALL)
    out = report_set(cat, Params(report_year=1990))
    for name, df in out.items():
        n = df.count()
        assert n == (1 if name == "metrics_summary" else 0), name
    assert out["metrics_summary"].collect()[0]["total_reports"] == 0


def test_catalog_from_registered_views(spark):
    """Catalog.from_tables reads relations registered under other names."""
    cat = catalog_for(spark, SF_SMALL)
    names = {}
    for n in RELATIONS:
        view = f"src_{n}"
        cat.raw(n).createOrReplaceTempView(view)
        names[n] = view
    other = Catalog.from_tables(spark, names)
    assert _kpi(other) == _kpi(cat)

"""Plan shape checks and KPI/proof reconciliation (§5 item 3)."""

import pytest
from helpers import SF_MID
from pyspark.sql import functions as F

from blotter.operators import cohort as co
from blotter.operators import metrics as me
from blotter.operators import proofs as pr
from blotter.params import Params
from blotter.plans.inspect import operators, plan_text, pushed_filters
from blotter.plans.registry import catalog_for
from blotter.sources.catalog import Catalog
from blotter.sources.schemas import RELATIONS

P = Params()


def test_cohort_scan_pushes_agency_and_date_range(spark):
    cat = catalog_for(spark, SF_MID)
    filters = " ".join(pushed_filters(co.cohort_incidents(cat, P)))
    assert "EqualTo(agncy_cd_agency_code,TN0830400)" in filters
    assert "GreaterThanOrEqual(report_date,1998-01-01" in filters
    assert "LessThan(report_date,1999-01-01" in filters


def test_cohort_reads_only_needed_columns(spark):
    cat = catalog_for(spark, SF_MID)
    text = plan_text(co.cohort_base(cat, P))
    schemas = [s for s in text.splitlines() if "ReadSchema" in s]
    assert schemas and not any("place_place_code" in s for s in schemas)


def test_grouped_proofs_have_no_expand(spark):
    cat = catalog_for(spark, SF_MID)
    for fn in (pr.proof_reports_with_arrest, pr.proof_avg_suspects,
               pr.proof_reports_with_vehicle_info):
        ops = operators(fn(cat, P))
        assert "Expand" not in ops, fn.__name__


def test_lookups_are_broadcast(spark):
    cat = catalog_for(spark, SF_MID)
    assert "BroadcastHashJoin" in operators(co.cohort_base(cat, P))


def test_kpi_reconciles_with_proofs(spark):
    cat = catalog_for(spark, SF_MID)
    k = me.metrics_summary(cat, P).collect()[0]
    total = pr.proof_total_reports(cat, P).select("agency_code", "report_number").distinct()
    assert k["total_reports"] == total.count()
    assert k["reports_with_arrest"] == pr.proof_reports_with_arrest(cat, P).count()
    assert k["open_reports"] == pr.proof_open_reports(cat, P).count()
    assert k["closed_by_other_means_reports"] == pr.proof_closed_by_other_means(cat, P).count()
    loss = pr.proof_summed_loss_value(cat, P).agg(
        F.sum("total_loss_value").alias("l"), F.sum("total_recovered_value").alias("r")
    ).collect()[0]
    assert (loss["l"], loss["r"]) == (k["summed_loss_value"], k["summed_recovered_value"])
    avg = pr.proof_avg_suspects(cat, P).agg(F.avg("suspect_count")).collect()[0][0]
    assert abs(avg - k["avg_suspects_per_report"]) < 1e-12
    veh = pr.proof_reports_with_vehicle_info(cat, P)
    assert k["reports_with_vehicle_info"] == veh.count()
    assert k["total_vehicles_linked"] == veh.agg(F.sum("vehicle_count")).collect()[0][0]


def test_inclusive_without_extra_codes_equals_described(spark):
    cat = catalog_for(spark, SF_MID)
    plain = Params(extra_offense_codes=())
    cols = list(co.DESCRIBED_COLUMNS)
    a = co.cohort_inclusive(cat, plain).select(*cols).distinct()
    b = co.cohort_described(cat, plain)
    assert a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0


def test_two_hop_tables_filtered_map_side(spark, monkeypatch):
    """In a report set, incident_cases and person roles are semi-joined to the cohort's
    shared first hop by a broadcast (materialized, so its real size is known)."""
    import blotter.plans.materialize as ma
    from blotter.operators.reports import report_set
    cat = catalog_for(spark, SF_MID)
    write, texts = ma._write, []  # the semi joins are in the plan that writes the incident facts
    monkeypatch.setattr(ma, "_write", lambda df, *a, **k: (texts.append(plan_text(df, "simple")), write(df, *a, **k))[1])
    with report_set(cat, P) as out:
        text = plan_text(out["proof_avg_suspects"], "simple") + plan_text(out["proof_open_reports"], "simple")
    facts = next(t for t in texts if "incident_person_roles" in t)
    semis = [l for l in (facts + text).splitlines() if "LeftSemi" in l]
    assert semis and all("BroadcastHashJoin" in l for l in semis), semis


def test_bucketed_rollups_need_no_exchange(spark):
    """Incident-keyed rollups group straight off the bucketed scan."""
    from blotter.operators import rollups as ro
    cat = catalog_for(spark, SF_MID)
    for fn in (ro.property_loss, ro.vehicle_counts, ro.arrest_flags, ro.arrest_counts, ro.arrest_rollup):
        df = fn(cat)
        df.collect()
        final = plan_text(df, "simple").split("== Initial Plan ==")[0]
        assert "Exchange" not in final, fn.__name__


def test_suspects_read_people_once(spark):
    import re

    from blotter.operators import suspects as su
    cat = catalog_for(spark, SF_MID)
    for fn in (su.suspect_counts, su.suspect_evidence):
        df = fn(cat)
        df.collect()
        final = plan_text(df, "simple").split("== Initial Plan ==")[0]
        assert len(re.findall(r"FileScan parquet \S*incident_people\b", final)) == 1, fn.__name__
        assert len(re.findall(r"\bExchange (?:hash|range|Single)", final)) <= 5, fn.__name__


ORDER = {
    "proof_total_reports": ("report_date", "report_number", "incident_id", "offense_code"),
    "proof_total_reports_inclusive": ("report_date", "report_number", "incident_id", "offense_code"),
    "proof_total_vehicles_linked": ("report_date", "report_number", "vehicle_id"),
    **{n: ("report_date", "report_number") for n in (
        "proof_reports_with_arrest", "proof_open_reports", "proof_closed_by_other_means",
        "proof_summed_loss_value", "proof_avg_suspects", "proof_reports_with_vehicle_info")},
}


@pytest.mark.parametrize("name", sorted(ORDER))
def test_proof_order(spark, name):
    """Documented sort keys, ascending, NULLs last; dates made to tie, some reports and vehicles NULL."""
    cat = catalog_for(spark, SF_MID)
    raw = {n: cat.raw(n) for n in RELATIONS}
    inc = raw["incidents"]
    raw["incidents"] = inc.withColumns({
        "report_date": F.date_trunc("year", "report_date").cast("timestamp_ntz"),
        "inc_report_number": F.when(F.col("incident_id") % 5 != 0, F.col("inc_report_number"))})
    rows = getattr(pr, name)(Catalog(raw), P).collect()
    keys = [tuple((r[c] is None, "" if r[c] is None else r[c]) for c in ORDER[name]) for r in rows]
    assert keys == sorted(keys)
    assert len(keys) > 3 and len({k[0] for k in keys}) < len(keys)
    if name not in ("proof_reports_with_arrest",):  # which needs a report number
        assert any(k[1][0] for k in keys)

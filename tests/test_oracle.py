"""Every registered query equals its independent DuckDB SQL."""

import pytest

import __spark_entry__ as entry
from blotter.plans.registry import QUERIES
from helpers import SF_MID, SF_SMALL
from oracle_check import compare, duck_connect

NAMES = sorted(QUERIES)
# Multi-incident reports (MAX grain) first occur at sf0.01.
MID = ["metrics_summary", "report_metrics", "proof_avg_suspects",
       "proof_closed_by_other_means", "proof_reports_with_arrest"]


def test_every_query_has_oracle():
    assert set(NAMES) <= set(entry.queries()) & set(entry.oracle_sql())
    assert len(NAMES) == 30


@pytest.fixture(scope="module")
def duck_small():
    return duck_connect(SF_SMALL)


@pytest.fixture(scope="module")
def duck_mid():
    return duck_connect(SF_MID)


@pytest.mark.parametrize("name", NAMES)
def test_matches_oracle_sf0001(spark, duck_small, name):
    ok, msg = compare(entry.queries()[name](spark, SF_SMALL), duck_small, entry.oracle_sql()[name])
    assert ok, msg


@pytest.mark.parametrize("name", MID)
def test_matches_oracle_sf001(spark, duck_mid, name):
    ok, msg = compare(entry.queries()[name](spark, SF_MID), duck_mid, entry.oracle_sql()[name])
    assert ok, msg


def test_entry_smoke(spark):
    df = entry.entry(spark)
    rows = df.collect()
    assert len(rows) == 1
    assert df.columns == ["report_year", "total_reports", "reports_with_arrest", "open_reports",
                          "closed_by_other_means_reports", "summed_loss_value",
                          "summed_recovered_value", "avg_suspects_per_report",
                          "reports_with_vehicle_info", "total_vehicles_linked"]
    assert rows[0]["report_year"] == 1998 and rows[0]["total_reports"] == 80


COHORT_KEYS = [n for n in NAMES if n.startswith(("cohort_", "proof_")) or n in (
    "incident_metrics", "report_metrics", "metrics_summary", "vehicle_links")]


@pytest.fixture
def no_broadcast(spark, monkeypatch):
    """Budget 0, lookup bound 0 and no automatic broadcasts: every join is a shuffle join."""
    import blotter.functions.joins as joins
    from blotter.plans.registry import catalog_for
    from blotter.sources.catalog import Catalog
    monkeypatch.setattr(joins, "COHORT_BROADCAST_MAX_BYTES", 0)
    thresholds = ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold")
    before = {k: spark.conf.get(k, None) for k in thresholds}
    for k in thresholds:
        spark.conf.set(k, "-1")
    cat = catalog_for(spark, SF_MID)
    yield Catalog(cat._raw, broadcast_max_bytes=0)
    for k, v in before.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)


@pytest.mark.parametrize("name", COHORT_KEYS)
def test_shuffle_joins_match_oracle(spark, duck_mid, no_broadcast, monkeypatch, name):
    import blotter.plans.registry as registry
    from blotter.plans.inspect import plan_text
    assert len(COHORT_KEYS) == 16
    monkeypatch.setattr(registry, "catalog_for", lambda *_: no_broadcast)
    df = QUERIES[name](spark, SF_MID)
    assert "BroadcastHashJoin" not in plan_text(df, "simple")
    ok, msg = compare(df, duck_mid, entry.oracle_sql()[name])
    assert ok, msg

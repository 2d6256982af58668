"""Bloom filters: no key is lost, few others pass, fewer rows reach the exchange."""

import pytest
from helpers import SF_MID
from pyspark.sql import functions as F

from blotter.functions import bloom, joins
from blotter.operators import facts as fa
from blotter.operators import proofs as pr
from blotter.operators import rollups as ro
from blotter.params import Params
from blotter.plans.inspect import plan_text
from blotter.plans.registry import catalog_for
from blotter.sources.catalog import Catalog


@pytest.mark.parametrize("n", [1, 3000, 40_000])
def test_keys_pass_and_few_others_do(spark, n):
    keys = spark.range(n).select((F.col("id") * 7919).alias("a"), F.concat(F.lit("r"), "id").alias("b"))
    keys = keys.union(spark.createDataFrame([(None, "x"), (5, None)], "a long, b string"))
    f = bloom.key_filter(keys, ["a", "b"], n + 2)
    assert f.size % bloom.PART_BITS == 0
    own = keys.where("a IS NOT NULL AND b IS NOT NULL")
    assert bloom.may_match(own, ["a", "b"], f).count() == n
    others = spark.range(20_000).select((F.col("id") * 7919).alias("a"), F.concat(F.lit("q"), "id").alias("b"), "id")
    passed = bloom.may_match(others, ["a", "b"], f)
    assert passed.columns == others.columns and passed.count() < 1500


def test_budget_bounds_the_filter(monkeypatch):
    assert bloom.filter_bits(10_000) == -(-10_000 * 16 // 32768) * 32768
    monkeypatch.setattr(joins, "COHORT_BROADCAST_MAX_BYTES", 10 * bloom.PART_BYTES)
    assert bloom.filter_bits(50_000) == 10 * 32768
    assert bloom.filter_bits(100_000) == 0  # fewer than four bits a key
    monkeypatch.setattr(joins, "COHORT_BROADCAST_MAX_BYTES", 0)
    assert bloom.filter_bits(1) == 0


def test_cohorts_beyond_the_budget_shuffle_fewer_rows(spark, monkeypatch):
    """The budget holds the filter but not the cohort: same facts, and the tables are filtered before their exchange."""
    p = Params()
    cat = catalog_for(spark, SF_MID)
    plain = {r.incident_id: r for r in fa.incident_facts(cat, pr.described_cohort(cat, p).keys, fa.ALL).collect()}
    monkeypatch.setattr(joins, "COHORT_BROADCAST_MAX_BYTES", 2 * bloom.PART_BYTES)
    cohort = pr.described_cohort(cat, p)
    assert cohort.size.bytes > joins.COHORT_BROADCAST_MAX_BYTES
    got = {r.incident_id: r for r in fa.incident_facts(cat, cohort.keys, fa.ALL).collect()}
    assert got == plain
    for table, col in (("incident_properties", "incsup_incident_id"), ("incident_vehicles", "incident_id"),
                       ("incident_people", "inc_incident_id"), ("offenses", "inc_incident_id")):
        rows = cat.table(table)
        held = bloom.may_match(rows, [col], ro.filter_of(cohort.keys, ("incident_id",)))
        ids = cohort.keys.select(F.col("incident_id").alias(col))
        match = rows.join(ids, col, "left_semi").count()
        assert match <= held.count() <= match + 0.05 * rows.count() and held.count() < 0.6 * rows.count()
    assert "bitmap_construct_agg" not in plan_text(ro.property_loss(cat, cohort.keys), "simple")  # written once
    assert "LeftSemi" in plan_text(ro.property_loss(cat, cohort.keys), "simple")


def test_proofs_are_the_same_beyond_the_budget(spark, monkeypatch):
    p = Params()
    base = catalog_for(spark, SF_MID)
    names = ("proof_reports_with_arrest", "proof_avg_suspects", "proof_total_vehicles_linked")
    want = {n: getattr(pr, n)(base, p).collect() for n in names}
    monkeypatch.setattr(joins, "COHORT_BROADCAST_MAX_BYTES", 2 * bloom.PART_BYTES)
    cat = Catalog(base._raw)
    for n in names:
        got = getattr(pr, n)(cat, p).collect()  # rows that tie come in any order
        assert sorted(map(str, got)) == sorted(map(str, want[n])), n

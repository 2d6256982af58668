"""Incident facts: the rollups of a cohort in one table, one row per incident.

Every report joins several rollups to its cohort, all of them on the incident.
Here the rollups that a report needs are put under each other, with NULLs for
the columns that are not theirs, and gathered by one aggregation on the incident
id: MAX, as each value comes from one row or is a flag, or SUM of suspects.  The cohort is then joined
once, whatever the number of rollups, and each rollup table is scanned once:

* cases give status, status texts and case numbers in one pass;
* arrests give the flag, count, numbers and dates in one pass, re-keyed from
  reports to incidents.

``report_set`` computes all parts once, writes them and lets the KPI and the
proofs read that table (``Cohort.facts``).
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from blotter.functions.joins import broadcast_if_bounded
from blotter.operators import rollups as ro
from blotter.operators.suspects import suspect_evidence, suspect_rows
from blotter.plans.materialize import materialize_sized
from blotter.sources.catalog import Catalog


def _arrests(cat: Catalog, keys: DataFrame, rollup: Callable[..., DataFrame]) -> DataFrame:
    return ro.per_incident(keys, rollup(cat, keys).withColumn("has_arrest", F.lit(1)))


#: The tables of each part.  Those ending in ``_rows`` have several rows an incident,
#: which only the common aggregation gathers (no exchange of their own).
PARTS: dict[str, Callable[[Catalog, DataFrame], DataFrame]] = {
    "cases": ro.case_facts,
    "case_numbers": ro.case_numbers,
    "open_rows": ro.open_case_rows,
    "arrests": lambda cat, keys: _arrests(cat, keys, ro.arrest_rollup),
    "arrest_counts": lambda cat, keys: _arrests(cat, keys, ro.arrest_counts),
    "arrest_flag": lambda cat, keys: _arrests(cat, keys, ro.arrest_flags),
    "loss": ro.property_loss_rows,
    "loss_sum": ro.property_loss,
    "suspects": suspect_evidence,
    "suspect_rows": suspect_rows,
    "vehicles": ro.vehicle_rollup,
    "vehicle_count": ro.vehicle_counts,
}
KPI = ("open_rows", "loss_sum", "suspect_rows", "vehicle_count", "arrest_flag")
#: Columns that add up over the rows of an incident; of the others the greatest value counts.
SUMS = ("suspect_count",)
ALL = ("cases", "arrests", "loss", "suspects", "vehicles")


def incident_facts(cat: Catalog, keys: DataFrame, parts: tuple[str, ...]) -> DataFrame:
    """One row per incident of ``keys`` that any of ``parts`` has rows for, with all their columns."""
    tables = [PARTS[p](cat, keys) for p in parts]
    if len(tables) == 1:
        return tables[0]
    kinds = {f.name: f.dataType for t in tables for f in t.schema.fields if f.name != "incident_id"}

    def widened(t: DataFrame) -> DataFrame:
        own = set(t.columns)
        return t.select("incident_id", *[(F.col(n) if n in own else F.lit(None)).cast(k).alias(n)
                                         for n, k in kinds.items()])

    rows = reduce(DataFrame.unionByName, [widened(t) for t in tables])
    return rows.groupBy("incident_id").agg(*[(F.sum if n in SUMS else F.max)(n).alias(n) for n in kinds])


def written_facts(cat: Catalog, keys: DataFrame, parts: tuple[str, ...] = ALL) -> DataFrame:
    """``incident_facts`` written once; broadcast where the bytes that the write saw are bounded."""
    facts, size = materialize_sized(incident_facts(cat, keys, parts))
    return broadcast_if_bounded(facts, proof=size.bytes)

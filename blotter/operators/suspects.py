"""Suspect counts per incident, and the evidence counts behind them.

The definition is over the row set

    person (in incident) x its role rows x matching arrest rows

(left joins, so a person with no roles or no arrests still gives one row with
NULLs).  A row passes the suspect test when any of nine conditions holds; the
evidence columns count passing *rows*, fan-out included, and the suspect count
is the number of distinct persons with a passing row whose arrest side is
NULL.

Materializing that product is needless: one hot person or report could
multiply it without bound.  Instead both fan-out sides are pre-aggregated on
their join keys (map-side combine, then one row per key):

* role rows per ``inc_per_id``: how many, how many pass on the role alone,
  how many match the role-type list, how many match the role words;
* arrest rows per (report, agency, person): how many, how many with an id.

Per person row the counts then follow by arithmetic.  Every evidence term is
itself one of the nine test conditions, so a row meeting it always passes:

* a role-side term (type list, role words) counts ``n_roles_term * n_arrests``;
* a person-side term (relation words, relation code, suspect-using code)
  counts ``n_roles * n_arrests`` when true;
* passing rows are ``n_roles`` when a person-side condition holds, otherwise
  those role rows that pass on their own; ``excluded_arrest_rows`` is that
  times the arrests with an id.

Here ``n_roles`` and ``n_arrests`` count the NULL row of an empty side as one.

None of the nine conditions looks at arrests, so person rows that cannot pass
are dropped before the arrests are joined.  Each side is read once.
"""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from blotter.functions.bloom import may_match
from blotter.functions.joins import within_span
from blotter.functions.text import any_of, upper_contains, upper_contains_any, upper_in
from blotter.operators.rollups import arrest_rows, by_first_hop, first_hop
from blotter.operators.spans import filter_of, span_of
from blotter.params import (
    OFFENDER_WORD,
    RELATION_CODE_FRAGMENTS,
    SUSPECT_RELATION_CODES,
    SUSPECT_ROLE_TYPES,
    SUSPECT_WORD,
)
from blotter.sources.catalog import Catalog

WORDS = (SUSPECT_WORD, OFFENDER_WORD)


def _with_incident(ip: DataFrame, inc: DataFrame) -> DataFrame:
    return ip.join(inc, ip["inc_incident_id"] == inc["incident_id"]).drop("inc_incident_id")


def _people(cat: Catalog, keys: DataFrame | None) -> DataFrame:
    """Person rows with their incident's report number and agency."""
    ip = cat.table("incident_people")
    if keys is None:
        inc = cat.table("incidents").select(
            "incident_id", "inc_report_number",
            F.col("agncy_cd_agency_code").alias("agency_code"))
        return _with_incident(ip, inc)
    ip = may_match(within_span(ip, "inc_incident_id", span_of(keys)), ["inc_incident_id"],
                   filter_of(keys, ("incident_id",)))
    return first_hop(keys, "people", ip, lambda df, k: _with_incident(
        df, k.select("incident_id", "inc_report_number", "agency_code")))


def _dealt(df: DataFrame, n: int | None, *cols: str) -> DataFrame:
    """``df`` dealt to ``n`` tasks by ``cols``; as the planner deals it if ``n`` is None."""
    return df.repartition(n, *cols) if n else df


def _tasks(cat: Catalog, keys: DataFrame | None) -> int | None:
    """Tasks for the rows of all people, or None: the rows of a cohort, or few enough for the session's."""
    return cat.tasks("incident_people") if keys is None else None


def _role_counts(cat: Catalog, keys: DataFrame | None) -> DataFrame:
    roles = by_first_hop(cat.table("incident_person_roles"), keys, "people", "inc_per_id")
    rc = cat.lookup("role_codes").withColumnRenamed("role_type", "rc_role_type")
    rows = roles.join(rc, roles["role_type"] == rc["rc_role_type"], "left")
    is_type = upper_in("role_type", SUSPECT_ROLE_TYPES)
    is_word = upper_contains_any("role_desc", WORDS)
    return rows.groupBy("inc_per_id").agg(
        F.count(F.lit(1)).alias("n_roles"),
        F.count(F.when(is_type | is_word, 1)).alias("n_role_pass"),
        F.count(F.when(is_type, 1)).alias("n_role_type"),
        F.count(F.when(is_word, 1)).alias("n_role_word"))


def _arrest_counts(cat: Catalog, keys: DataFrame | None) -> DataFrame:
    a = arrest_rows(cat, keys, ("arrest_id", "person_id")).filter(
        F.col("agency_code").isNotNull() & F.col("person_id").isNotNull())
    return a.groupBy(F.col("inc_report_number").alias("a_report"),
                     F.col("agency_code").alias("a_agency"),
                     F.col("person_id").alias("a_person")).agg(
        F.count(F.lit(1)).alias("n_arrest_rows"),
        F.count("arrest_id").alias("n_arrest_ids"))


def person_rows(cat: Catalog, keys: DataFrame | None = None) -> DataFrame:
    """One row per passing (person row x relation code row) with its fan-out arithmetic.

    Role counts attach on ``inc_per_id``.  Rows that pass then meet the
    pre-aggregated arrests on (report, agency, person id).  Rows with a NULL among
    these never match; their report number is replaced by a text of their own
    that no report has, so they spread over all tasks instead of piling up in
    one.  The tasks of that join follow from the bytes of the people where the
    session has fewer, so a task's rows stay the same at any size; otherwise the
    planner's exchange stays, and AQE splits a hot report or person.
    """
    base = _people(cat, keys)
    rel = cat.lookup("ejs_codes")  # not renamed: its broadcast is the same as that of the case statuses
    people = base.join(rel, (base["relation_code_type"] == rel["code_type"])
                       & (base["reltn_relation_code"] == rel["code"]), "left")
    people = people.join(_role_counts(cat, keys), "inc_per_id", "left")

    code = F.col("reltn_relation_code")
    desc_suspect = upper_contains("description", SUSPECT_WORD)
    desc_offender = upper_contains("description", OFFENDER_WORD)
    code_hit = any_of(upper_in(code, SUSPECT_RELATION_CODES),
                      upper_contains_any(code, RELATION_CODE_FRAGMENTS))
    suspus = F.col("suspus_using_code").isNotNull()
    person_hit = desc_suspect | desc_offender | code_hit | suspus

    n_roles = F.greatest(F.coalesce(F.col("n_roles"), F.lit(0)), F.lit(1))
    n_pass = F.when(person_hit, n_roles).otherwise(F.coalesce(F.col("n_role_pass"), F.lit(0)))
    person = ("inc_report_number", "agency_code", "per_person_id")
    whole = reduce(and_, [F.col(c).isNotNull() for c in person])
    passing = people.select(
        "incident_id", "inc_per_id", "agency_code", "per_person_id",
        F.when(whole, F.col("inc_report_number")).otherwise(
            F.concat(F.lit("\u0000"), F.coalesce(F.col("inc_per_id").cast("string"), F.lit("")),
                     F.lit("/"), F.coalesce(F.col("incident_id").cast("string"), F.lit(""))))
        .alias("report_key"),
        n_pass.alias("n_pass"), n_roles.alias("n_roles"),
        F.coalesce(F.col("n_role_type"), F.lit(0)).alias("n_role_type"),
        F.coalesce(F.col("n_role_word"), F.lit(0)).alias("n_role_word"),
        desc_suspect.alias("desc_suspect"), desc_offender.alias("desc_offender"),
        suspus.alias("suspus"), code_hit.alias("code_hit")).filter(F.col("n_pass") > 0)
    n = _tasks(cat, keys)
    passing = _dealt(passing, n, "report_key", "agency_code", "per_person_id")
    arrests = _dealt(_arrest_counts(cat, keys), n, "a_report", "a_agency", "a_person")
    rows = passing.join(arrests, (passing["report_key"] == arrests["a_report"])
                        & (passing["agency_code"] == arrests["a_agency"])
                        & (passing["per_person_id"] == arrests["a_person"]), "left")
    n_pass, n_roles = F.col("n_pass"), F.col("n_roles")
    arrest_rows = F.coalesce(F.col("n_arrest_rows"), F.lit(0))
    arrest_ids = F.coalesce(F.col("n_arrest_ids"), F.lit(0))
    n_arrests = F.greatest(arrest_rows, F.lit(1))

    def rows_if(name: str) -> Column:
        return F.when(F.col(name), n_roles * n_arrests).otherwise(F.lit(0))

    return rows.select(
        F.col("incident_id"), F.col("inc_per_id"),
        # some passing row has a NULL arrest side: no arrest, or one without id
        ((arrest_rows == 0) | (arrest_rows > arrest_ids)).alias("is_suspect"),
        (F.col("n_role_type") * n_arrests).alias("role_type_rows"),
        (F.col("n_role_word") * n_arrests).alias("role_desc_rows"),
        rows_if("desc_suspect").alias("suspect_rows"),
        rows_if("desc_offender").alias("offender_rows"),
        rows_if("suspus").alias("suspus_rows"),
        rows_if("code_hit").alias("relation_code_rows"),
        (n_pass * arrest_ids).alias("excluded_rows"))


def suspect_rows(cat: Catalog, keys: DataFrame | None = None) -> DataFrame:
    """incident_id -> one row with suspect_count 1 for each distinct suspect (people with an id)."""
    return (person_rows(cat, keys).filter(F.col("is_suspect") & F.col("inc_per_id").isNotNull())
            .select("incident_id", "inc_per_id").distinct()
            .select("incident_id", F.lit(1).cast("long").alias("suspect_count")))


def suspect_counts(cat: Catalog, keys: DataFrame | None = None) -> DataFrame:
    """incident_id -> distinct suspects not arrested on the same report.

    Only incidents with at least one such person appear.
    """
    rows = person_rows(cat, keys).filter(F.col("is_suspect")).select("incident_id", "inc_per_id")
    return (_dealt(rows, _tasks(cat, keys), "incident_id", "inc_per_id")
            .groupBy("incident_id")
            .agg(F.countDistinct("inc_per_id").alias("suspect_count")))


def suspect_evidence(cat: Catalog, keys: DataFrame | None = None) -> DataFrame:
    """incident_id -> suspect count and the row counts behind it.

    Incidents with at least one passing row appear (suspect_count may be 0).
    """
    rows = person_rows(cat, keys)
    s = lambda c: F.sum(F.col(c).cast("long"))
    sums = [c for c in rows.columns if c.endswith("_rows")]
    persons = _dealt(rows, _tasks(cat, keys), "incident_id", "inc_per_id").groupBy("incident_id", "inc_per_id").agg(
        F.bool_or("is_suspect").alias("is_suspect"), *[s(c).alias(c) for c in sums])
    return persons.groupBy("incident_id").agg(
        F.count(F.when(F.col("is_suspect"), F.col("inc_per_id"))).alias("suspect_count"),
        s("role_type_rows").alias("matched_role_type_rows"),
        s("role_desc_rows").alias("matched_role_desc_rows"),
        s("suspect_rows").alias("matched_suspect_rows"),
        s("offender_rows").alias("matched_offender_rows"),
        s("suspus_rows").alias("matched_suspus_rows"),
        s("relation_code_rows").alias("matched_relation_code_rows"),
        s("excluded_rows").alias("excluded_arrest_rows"))

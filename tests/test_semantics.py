"""Hand-made edge rows for the semantic rules of SURVEY §1.4 (S-numbers)."""

from decimal import Decimal

from helpers import incident, make_catalog, money, ts
from pyspark.sql import functions as F

from blotter.operators import cohort as co
from blotter.operators import metrics as me
from blotter.operators import proofs as pr
from blotter.operators import rollups as ro
from blotter.params import Params

P = Params(report_year=1998, extra_offense_codes=("OCL",))


def rows(df, *cols):
    return sorted(tuple(r[c] for c in cols) for r in df.collect())


def test_year_boundary_agency_and_case_insensitive_code(spark):
    cat = make_catalog(spark, incidents=[
        incident(1, "R1", ts(1997, 12, 31, 23, 59, 59)),
        incident(2, "R2", ts(1998, 1, 1)),
        incident(3, "R3", ts(1998, 12, 31, 23, 59, 59)),
        incident(4, "R4", ts(1999, 1, 1)),
        incident(5, "R5", ts(1998, 6, 1), agency="TN0830500"),
        incident(6, "R6", None),
    ], offenses=[(i, "OC1", "PLACE", None) for i in range(1, 7)]
              + [(2, "OC2", "PLACE", None), (2, "OC3", "PLACE", None)])
    got = rows(co.cohort_described(cat, P), "incident_id", "offense_code", "nibrs_code",
               "nibrs_desc", "report_year")
    # S6 half-open year; S7 '23c' passes, its description join is case-sensitive.
    assert got == [(2, "OC1", "23C", "Shoplifting", 1998), (2, "OC2", "23c", None, 1998),
                   (3, "OC1", "23C", "Shoplifting", 1998)]


def test_blank_and_null_report_numbers_form_one_report(spark):
    cat = make_catalog(spark, incidents=[
        incident(10, None, ts(1998, 3, 1)), incident(11, "", ts(1998, 3, 2)),
        incident(12, "R12", ts(1998, 3, 3)), incident(13, "R12", ts(1998, 3, 4)),
    ], offenses=[(i, "OC1", "PLACE", None) for i in (10, 11, 12, 13)],
        arrests=[(1, "A1", "TN0830400", None, ts(1998, 3, 5), 7),
                 (2, "A2", "TN0830400", "", ts(1998, 3, 5), 7)])
    s = me.metrics_summary(cat, P).collect()[0]
    # S1 blank is NULL; S8 NULL reports are one group and never match arrests.
    assert s["total_reports"] == 2 and s["reports_with_arrest"] == 0


def test_report_takes_max_not_sum_and_open_with_closed(spark):
    cat = make_catalog(
        spark,
        incidents=[incident(20, "R20", ts(1998, 5, 1)), incident(21, "R20", ts(1998, 5, 2))],
        offenses=[(20, "OC1", "PLACE", None), (21, "OC1", "PLACE", None)],
        incident_properties=[(20, money(100), "7", "5"), (20, money(30), "7", "0"),
                             (21, money(50), "7", "5"), (21, None, "7", "5")],
        incident_cases=[(900, "C1", "STATUS", "O"), (901, "C2", "STATUS", "C")],
        inc_case_inc_status_vw=[(20, 900), (21, 901)])
    s = me.metrics_summary(cat, P).collect()[0]
    # S9: incident 20 loss 130 > incident 21 loss 50; S19: one row counts in both.
    assert s["summed_loss_value"] == Decimal("130.00")
    assert s["summed_recovered_value"] == Decimal("100.00")
    # S11: one report is open (incident 20) and closed by other means (21).
    assert s["open_reports"] == 1 and s["closed_by_other_means_reports"] == 1
    assert rows(pr.proof_open_reports(cat, P), "report_number", "case_statuses") == [
        ("R20", "Open - Active")]


def test_no_case_or_dangling_case_is_not_open(spark):
    cat = make_catalog(
        spark,
        incidents=[incident(40, "R40", ts(1998, 2, 1)), incident(41, "R41", ts(1998, 2, 1))],
        offenses=[(40, "OC1", "PLACE", None), (41, "OC1", "PLACE", None)],
        inc_case_inc_status_vw=[(41, 999)])
    got = rows(me.incident_metrics(cat, P), "incident_id", "is_open", "closed_by_other_means")
    assert got == [(40, 0, 1), (41, 0, 1)]  # S12


def test_empty_cohort_gives_one_row(spark):
    s = me.metrics_summary(make_catalog(spark), P).collect()
    assert len(s) == 1  # S20
    r = s[0]
    assert r["report_year"] == 1998 and r["total_reports"] == 0
    assert r["summed_loss_value"] is None and r["avg_suspects_per_report"] is None


def test_vehicle_ids_text_order_and_null_not_counted(spark):
    cat = make_catalog(spark, incident_vehicles=[
        (70, 2, "R", "1", None), (70, 10, "R", "1", None), (70, 1, "R", "1", None),
        (70, None, "R", "1", None), (70, 2, "X", "2", None)])
    got = rows(ro.vehicle_rollup(cat), "incident_id", "vehicle_count", "vehicle_ids")
    assert got == [(70, 3, "1, 10, 2")]  # S21, S22


def test_arrest_numbers_keep_duplicates(spark):
    cat = make_catalog(spark, arrests=[
        (1, "A1", "TN0830400", "R60", ts(1998, 1, 2), 1),
        (2, "A1", "TN0830400", "R60", ts(1998, 1, 9), 2),
        (3, "A0", "TN0830400", "R60", ts(1998, 1, 5), 3),
        (4, None, "TN0830400", "R60", ts(1998, 1, 1), 4)])
    r = ro.arrest_rollup(cat).collect()[0]
    assert r["arrest_numbers"] == "A0, A1, A1" and r["arrest_count"] == 4  # S23
    assert r["first_arrest_date"] == ts(1998, 1, 1)


def test_case_list_skips_blank_and_null(spark):
    cat = make_catalog(spark, incident_cases=[
        (1, "C2", "STATUS", "O"), (2, "", "STATUS", "O"), (3, None, "STATUS", "O"),
        (4, "C1", "STATUS", "O")],
        inc_case_inc_status_vw=[(80, 1), (80, 4), (80, 1), (81, 2), (81, 3)])
    # S1/S3: incident 81 has only blank/NULL numbers, so it has no list row.
    assert rows(ro.case_numbers(cat), "incident_id", "case_numbers") == [(80, "C1, C2")]


def test_address_format(spark):
    cat = make_catalog(spark, incident_addresses=[(90, 1), (90, 2), (91, 3)], addresses=[
        (1, "12", "N", "MAIN", "ST", None, "CITY", "TN", "37000", 1234),
        (2, "12", None, "MAIN", None, "APT 4", "CITY", "TN", "37000", None),
        (3, None, None, None, None, None, None, None, None, None)])
    got = dict(rows(ro.occurrence_addresses(cat), "incident_id", "occurrence_addresses"))
    # S24: a space stays before the comma when sub_number is NULL; all-NULL gives ', ,'.
    assert got[90] == "12 MAIN APT 4, CITY, TN 37000 | 12 N MAIN ST , CITY, TN 37000-1234"
    assert got[91] == ", ,"


def test_inclusive_cohort_keeps_listed_codes_without_mapping(spark):
    cat = make_catalog(spark, incidents=[incident(95, "R95", ts(1998, 7, 1))],
                       offenses=[(95, "OCL", "PLACE", "0"), (95, "OC3", "PLACE", None)],
                       ejs_codes=[("PLACE", "0", "Store")])
    got = rows(co.cohort_inclusive(cat, P), "offense_code", "nibrs_code", "place_code",
               "place_desc")
    assert got == [("OCL", None, "0", "Store")]  # S25


def test_suspects_exclude_arrested_person(spark):
    cat = make_catalog(
        spark,
        incidents=[incident(50, "R50", ts(1998, 4, 1))],
        offenses=[(50, "OC1", "PLACE", None)],
        incident_people=[(1, 50, 100, "REL", "SU", None), (2, 50, 101, "REL", "VI", None),
                         (3, 50, 102, "REL", "VI", None), (4, 50, None, "REL", "OF", None),
                         (5, 50, 103, "REL", "SU", None)],
        incident_person_roles=[(1, "V"), (1, "SP"), (2, "s")],
        arrests=[(1, "A1", "TN0830400", "R50", ts(1998, 4, 2), 100),
                 (2, "A2", "TN0830400", "R50", ts(1998, 4, 2), 100),
                 (None, "A3", "TN0830400", "R50", ts(1998, 4, 2), 103),
                 (4, "A4", "TN0830400", "R50", ts(1998, 4, 2), 103)])
    r = pr.proof_avg_suspects(cat, P).collect()[0]
    # person 100 arrested (S16); 101 by role 's'; NULL person stays; 103 has an
    # arrest row without id, so a NULL arrest side survives for it.
    assert r["suspect_count"] == 3
    assert (r["matched_role_type_rows"], r["matched_role_desc_rows"]) == (1, 2)
    assert (r["matched_suspect_rows"], r["matched_offender_rows"]) == (6, 1)
    assert r["excluded_arrest_rows"] == 5  # S17: 2 roles x 2 arrests + 1
    s = me.metrics_summary(cat, P).collect()[0]
    assert s["avg_suspects_per_report"] == 3.0


def test_optional_report_number_filter(spark):
    cat = make_catalog(spark, incidents=[incident(1, "R1", ts(1998, 2, 1)),
                                         incident(2, "r2", ts(1998, 2, 1))],
                       offenses=[(1, "OC1", "PLACE", None), (2, "OC1", "PLACE", None)])
    one = Params(report_year=1998, report_number="R2")
    assert rows(co.cohort_base(cat, one), "incident_id") == [(2,)]
    assert me.metrics_summary(cat, one).collect()[0]["total_reports"] == 1


def test_sort_puts_null_report_numbers_last(spark):
    # S4/S5: ascending sort with NULLs last, on the proof's output columns.
    d = ts(1998, 5, 5)
    cat = make_catalog(spark, incidents=[incident(1, None, d), incident(2, "R2", d),
                                         incident(3, "R1", d)],
                       offenses=[(i, "OC1", "PLACE", None) for i in (1, 2, 3)])
    got = [r["report_number"] for r in pr.proof_total_reports(cat, P).collect()]
    assert got == ["R1", "R2", None]


def test_report_case_numbers_are_the_largest_string(spark):
    # S10: MAX over the incidents' case lists, not their union.
    cat = make_catalog(
        spark, incidents=[incident(1, "R1", ts(1998, 1, 2)), incident(2, "R1", ts(1998, 1, 3))],
        offenses=[(1, "OC1", "PLACE", None), (2, "OC1", "PLACE", None)],
        incident_cases=[(10, "C9", "STATUS", "C"), (11, "C10", "STATUS", "C"),
                        (12, "C2", "STATUS", "C")],
        inc_case_inc_status_vw=[(1, 10), (2, 11), (2, 12)])
    r = pr.proof_summed_loss_value(cat, P).collect()[0]
    assert r["case_numbers"] == "C9"  # 'C9' > 'C10, C2' as text


def test_reopened_counts_as_open(spark):
    # S13: substring OPEN in the upper-cased description.
    cat = make_catalog(spark, incident_cases=[(1, "C1", "STATUS", "R"), (2, "C2", "STATUS", "C"),
                                               (3, "C3", "STATUS", "N")])
    assert rows(ro.case_open_flags(cat), "inc_case_id", "is_open") == [(1, 1), (2, 0), (3, 0)]


def test_relation_code_substrings_and_repeated_offenses(spark):
    # S14: 'OFFICER' contains OFF, so it counts; S26: repeated offense rows collapse.
    cat = make_catalog(
        spark, incidents=[incident(7, "R7", ts(1998, 8, 1))],
        offenses=[(7, "OC1", "PLACE", None)] * 3,
        incident_people=[(1, 7, 5, "REL", "OFFICER", None), (2, 7, 6, "REL", "VI", None)])
    assert co.cohort_base(cat, P).count() == 1
    r = pr.proof_avg_suspects(cat, P).collect()[0]
    assert r["suspect_count"] == 1 and r["matched_relation_code_rows"] == 1


def test_arrest_without_id_closed_proof_vs_kpi(spark):
    # SURVEY §1.5: the KPI flags a report arrested if any arrest row exists; the
    # closed proof requires COUNT(DISTINCT arrest_id) = 0.  An arrest row with a
    # NULL id therefore keeps the report in the closed proof but not in the KPI.
    cat = make_catalog(
        spark, incidents=[incident(9, "R9", ts(1998, 9, 9))],
        offenses=[(9, "OC1", "PLACE", None)],
        arrests=[(None, "A9", "TN0830400", "R9", ts(1998, 9, 10), 1)])
    k = me.metrics_summary(cat, P).collect()[0]
    assert k["reports_with_arrest"] == 1 and k["closed_by_other_means_reports"] == 0
    closed = pr.proof_closed_by_other_means(cat, P).collect()
    assert [(r["report_number"], r["arrest_count"]) for r in closed] == [("R9", 0)]


def test_catalog_and_params_validate_early(spark):
    import pytest

    from blotter.sources.catalog import Catalog
    from blotter.sources.schemas import SCHEMAS
    tables = {n: spark.createDataFrame([], s) for n, s in SCHEMAS.items()}
    tables["arrests"] = tables["arrests"].drop("person_id")
    with pytest.raises(KeyError, match="person_id"):
        Catalog(tables)
    with pytest.raises(ValueError):
        Params(agency="")
    with pytest.raises(ValueError):
        Params(nibrs="")

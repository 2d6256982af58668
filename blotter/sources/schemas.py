"""Logical schemas of the 16 input relations.

Only the columns the reports read are declared; extra columns on an input are
ignored (and pruned away by Catalyst before the scan), a missing one is an
error raised before any job runs.
"""

from __future__ import annotations

from pyspark.sql.types import (
    DecimalType,
    LongType,
    StringType,
    StructField,
    StructType,
    TimestampNTZType,
)

_S, _L, _T = StringType(), LongType(), TimestampNTZType()
MONEY = DecimalType(18, 2)


def _schema(*cols: tuple[str, object]) -> StructType:
    return StructType([StructField(n, t, True) for n, t in cols])


SCHEMAS: dict[str, StructType] = {
    "incidents": _schema(
        ("incident_id", _L), ("inc_report_number", _S),
        ("agncy_cd_agency_code", _S), ("report_date", _T)),
    "offenses": _schema(
        ("inc_incident_id", _L), ("offns_cd_offense_code", _S),
        ("place_code_type", _S), ("place_place_code", _S)),
    "offense_codes": _schema(("offense_code", _S), ("offense_desc", _S)),
    "nibrs_offenses": _schema(("offense_code", _S), ("nibrs_code", _S)),
    "nibrs_codes": _schema(("nibrs_code", _S), ("nibrs_desc", _S)),
    "ejs_codes": _schema(("code_type", _S), ("code", _S), ("description", _S)),
    "incident_cases": _schema(
        ("inc_case_id", _L), ("inc_case_number", _S),
        ("case_status_code_type", _S), ("case_status_code", _S)),
    "inc_case_inc_status_vw": _schema(("incident_id", _L), ("inc_case_id", _L)),
    "arrests": _schema(
        ("arrest_id", _L), ("arrest_num", _S), ("agency_code", _S),
        ("inc_report_number", _S), ("arrest_date", _T), ("person_id", _L)),
    "incident_people": _schema(
        ("inc_per_id", _L), ("inc_incident_id", _L), ("per_person_id", _L),
        ("relation_code_type", _S), ("reltn_relation_code", _S),
        ("suspus_using_code", _S)),
    "incident_person_roles": _schema(("inc_per_id", _L), ("role_type", _S)),
    "role_codes": _schema(("role_type", _S), ("role_desc", _S)),
    "incident_properties": _schema(
        ("incsup_incident_id", _L), ("value", MONEY),
        ("prop_loss_code", _S), ("status_code", _S)),
    "incident_vehicles": _schema(
        ("incident_id", _L), ("vehicle_id", _L), ("role_code", _S),
        ("status_code", _S), ("date_recovered", _T)),
    "incident_addresses": _schema(("incident_id", _L), ("address_id", _L)),
    "addresses": _schema(
        ("address_id", _L), ("street_number", _S),
        ("dirct_cd_direction_code", _S), ("street_name", _S),
        ("street_cd_street_type_code", _S), ("sub_number", _S), ("city", _S),
        ("state_cd_state_code", _S), ("zip5", _S), ("zip4", _L)),
}

# Code/lookup tables: small dimension relations, candidates for broadcast
# (only after their size is checked, see Catalog.lookup).
LOOKUPS = ("offense_codes", "nibrs_offenses", "nibrs_codes", "ejs_codes", "role_codes")

RELATIONS = tuple(SCHEMAS)

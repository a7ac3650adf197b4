"""Declared schemas: the hospital star, its load history, and the driver's tables."""

from __future__ import annotations

from pyspark.sql import types as T

_L, _I, _S = T.LongType(), T.IntegerType(), T.StringType()
_TS, _D, _B, _F = T.TimestampNTZType(), T.DateType(), T.BooleanType(), T.DoubleType()


def _schema(*fields: tuple) -> T.StructType:
    """``(name, type)`` is required, ``(name, type, True)`` may be NULL."""
    return T.StructType([T.StructField(f[0], f[1], len(f) > 2 and f[2]) for f in fields])


DIM_PATIENTS = _schema(
    ("patient_key", _L), ("patient_id", _S), ("first_name", _S), ("last_name", _S),
    ("date_of_birth", _D), ("gender", _S), ("address", _S, True), ("city", _S, True),
    ("state", _S, True), ("zip_code", _S, True), ("phone_number", _S, True),
    ("insurance_type", _S), ("valid_from", _TS), ("valid_to", _TS), ("is_current", _B),
    ("record_version", _I), ("created_at", _TS), ("updated_at", _TS),
)
DIM_DEPARTMENTS = _schema(
    ("department_key", _L), ("department_id", _S), ("department_name", _S),
    ("bed_capacity", _I), ("created_at", _TS),
)
DIM_PHYSICIANS = _schema(
    ("physician_key", _L), ("physician_id", _S), ("first_name", _S), ("last_name", _S),
    ("specialty", _S), ("department_key", _L, True), ("created_at", _TS),
)
FACT_ENCOUNTERS = _schema(
    ("encounter_key", _L), ("encounter_id", _S), ("patient_key", _L, True),
    ("patient_id", _S, True), ("department_key", _L, True), ("physician_key", _L, True),
    ("admission_date", _TS), ("discharge_date", _TS, True), ("admission_type", _S),
    ("chief_complaint", _S, True), ("created_at", _TS),
)
FACT_BED_EVENTS = _schema(
    ("bed_event_key", _L), ("encounter_key", _L, True), ("department_key", _L, True),
    ("bed_number", _I), ("event_type", _S), ("event_timestamp", _TS), ("created_at", _TS),
)
LOAD_HISTORY = _schema(
    ("load_id", _L), ("table_name", _S), ("records_loaded", _L), ("start_time", _TS),
    ("end_time", _TS), ("duration_seconds", T.DecimalType(10, 2), True), ("created_at", _TS),
)
REQUEST_LOG = _schema(
    ("timestamp", _TS), ("severity", _S), ("method", _S), ("path", _S),
    ("status_code", _I), ("duration_seconds", _F),
)

STAR = {
    "dim_patients": DIM_PATIENTS,
    "dim_departments": DIM_DEPARTMENTS,
    "dim_physicians": DIM_PHYSICIANS,
    "fact_encounters": FACT_ENCOUNTERS,
    "fact_bed_events": FACT_BED_EVENTS,
    "load_history": LOAD_HISTORY,
}

# The driver's tables, read with these schemas so that no footer has to be opened to plan a query.
SOURCE = {
    "nation": _schema(("n_nationkey", _I, True), ("n_name", _S, True), ("n_regionkey", _I, True)),
    "customer": _schema(
        ("c_custkey", _L, True), ("c_name", _S, True), ("c_nationkey", _I, True),
        ("c_acctbal", _F, True), ("c_mktsegment", _S, True),
    ),
    "supplier": _schema(
        ("s_suppkey", _L, True), ("s_name", _S, True), ("s_nationkey", _I, True), ("s_acctbal", _F, True),
    ),
    "orders": _schema(
        ("o_orderkey", _L, True), ("o_custkey", _L, True), ("o_orderstatus", _S, True),
        ("o_totalprice", _F, True), ("o_orderdate", _TS, True), ("o_orderpriority", _S, True),
    ),
    "events": _schema(
        ("event_id", _L, True), ("ts", _TS, True), ("user_id", _L, True),
        ("event_type", _S, True), ("value", _F, True), ("props", _S, True),
    ),
}

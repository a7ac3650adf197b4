"""Record lookups and lists: patients by state in time, encounter lists, search."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardline.functions import exprs as X
from wardline.operators.selection import page, top_k

PATIENT_CARD = [
    "patient_id", "first_name", "last_name", "date_of_birth", "gender", "insurance_type", "city", "state",
]


def current_patients(patients: DataFrame, n: int | None = 20) -> DataFrame:
    rows = patients.where("is_current").select(
        "patient_id", "first_name", "last_name", "address", "city", "state", "zip_code", "insurance_type",
        "valid_from", "valid_to", "record_version",
    )
    return rows if n is None else top_k(rows, ["last_name", "first_name", "patient_id"], n)


def patients_as_of(patients: DataFrame, at: str) -> DataFrame:
    """Versions valid at a moment: begun by then and not yet ended."""
    return patients.where((F.col("valid_from") <= X.ts(at)) & (F.col("valid_to") > X.ts(at))).select(
        "patient_id", "first_name", "last_name", "address", "city", "state", "insurance_type", "valid_from",
        "valid_to", "record_version",
    )


def patients_as_of_relation(patients: DataFrame, moments: DataFrame) -> DataFrame:
    """The same against a one-row relation ``query_date`` instead of a literal."""
    at = moments.select("query_date").scalar()
    return patients.where((F.col("valid_from") <= at) & (F.col("valid_to") > at)).select(
        "patient_id", "record_version", "valid_from", "valid_to"
    )


def patient_history(patients: DataFrame, patient_id: str) -> DataFrame:
    return (
        patients.where(F.col("patient_id") == patient_id)
        .select(
            "patient_key", "patient_id", "address", "city", "state", "zip_code", "insurance_type", "valid_from",
            "valid_to", "is_current", "record_version",
            (F.timestamp_diff("SECOND", F.col("valid_from"), F.col("valid_to")) / F.lit(86400)).alias("days_active"),
        )
        .orderBy(F.desc("valid_from"))
    )


def get_current(patients: DataFrame, patient_id: str) -> DataFrame:
    return patients.where((F.col("patient_id") == patient_id) & F.col("is_current")).select(*PATIENT_CARD)


def list_patients(patients: DataFrame, limit: int = 100, offset: int = 0) -> DataFrame:
    return page(patients.where("is_current").select(*PATIENT_CARD), ["patient_id"], limit, offset)


def list_encounters(
    encounters: DataFrame, departments: DataFrame, patient_id: str | None = None, limit: int | None = 100
) -> DataFrame:
    """Newest first. Visits made under older patient versions stay in the list."""
    rows = encounters if patient_id is None else encounters.where(F.col("patient_id") == patient_id)
    out = rows.join(departments.select("department_key", "department_name"), "department_key").select(
        "encounter_key", "patient_id", "admission_date", "discharge_date", "admission_type", "department_name",
        "chief_complaint",
    )
    return out if limit is None else top_k(out, ["-admission_date", "encounter_key"], limit)


def list_departments(departments: DataFrame) -> DataFrame:
    return departments.select("department_key", "department_name", "bed_capacity").orderBy("department_name")


def search_patients(patients: DataFrame, term: str, as_of: str, n: int = 50) -> DataFrame:
    found = patients.where(
        F.col("is_current") & (X.contains_ci("first_name", term) | X.contains_ci("last_name", term))
    )
    top = top_k(found, ["last_name", "first_name", "patient_id"], n)
    return top.select(
        "patient_id", X.full_name("first_name", "last_name").alias("name"),
        X.age_years("date_of_birth", as_of).alias("age"), "gender", "insurance_type",
        F.concat("city", F.lit(", "), "state").alias("location"),
    )


def patient_encounters(encounters: DataFrame, departments: DataFrame, patient_id: str) -> DataFrame:
    return (
        encounters.where(F.col("patient_id") == patient_id)
        .join(departments.select("department_key", "department_name"), "department_key")
        .select(
            "admission_date", "discharge_date", "department_name", "admission_type", "chief_complaint",
            F.round(X.los_days(), 1).alias("los_days"),
        )
        .orderBy(F.desc("admission_date"))
    )


def trailing(df: DataFrame, time_col: str, days: int, as_of: str) -> DataFrame:
    """Rows of the last ``days`` days; the bound is a literal and reaches the file scan."""
    return df.where(F.col(time_col) >= X.shift(X.ts(as_of), days=-days))


def since(days: int, as_of: str) -> str:
    """Start of a trailing period as timestamp text."""
    from datetime import datetime, timedelta

    return str(datetime.fromisoformat(as_of) - timedelta(days=days))


def patient_by_first_key(patients: DataFrame) -> DataFrame:
    """Current record of the patient whose id comes first, the id found by a scalar subquery."""
    first = patients.agg(F.min("patient_id")).scalar()
    return patients.where(F.col("is_current") & (F.col("patient_id") == first)).select(*PATIENT_CARD)


def los_values(
    encounters: DataFrame, departments: DataFrame | None = None, department: str | None = None, cap: float = 30
) -> DataFrame:
    rows = encounters.withColumn("los_days", X.los_days()).where(F.col("los_days") <= cap)
    if department is not None:
        name = departments.where(F.col("department_name") == department).select("department_key")
        rows = rows.join(name, "department_key", "left_semi")
    return rows.select("encounter_key", "los_days")


def has_encounters(encounters: DataFrame, patient_id: str) -> DataFrame:
    """One row telling whether a patient has any encounter; the scan may stop at the first hit."""
    hit = encounters.where(F.col("patient_id") == patient_id).limit(1).agg(F.count("*").alias("n"))
    return hit.select((F.col("n") > 0).alias("has_encounters"))
